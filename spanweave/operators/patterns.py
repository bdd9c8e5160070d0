"""Positions of matches as a table function, and what follows from them: the stretches between matches, such as speeches.

Spark has no built-in for the offsets of matches or for groups by name. `find_all(text, pattern)` gives them, a row a match, in a lateral
join or, registered, in SQL. Offsets are half-open and count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A speaker at the beginning of a line, up to a colon: title, name, party or constituency in brackets, role.
SPEAKER = r"(?m)^[^\w\n]*(?P<title>(?:Dr\.|Prof\.)\s)?\s*(?P<name>[A-ZÄÖÜ][\wäöüß-]+(?: [A-ZÄÖÜ][\wäöüß-]+){0,2})\s*(?:\((?P<party>[^)\n]{1,40})\))?\s*,?\s*(?P<role>[^:\n]{0,100}?)\s*:"
ROW = "n int, begin int, end int, text string, groups map<string,string>"


@lru_cache(64)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


class FindAll:
    """The table function's body: (n, begin, end, text, groups by name that took part) of each match of a pattern; none in a null text."""

    def eval(self, text: str | None, pattern: str) -> Iterator[tuple]:
        if text is not None:
            for n, m in enumerate(_compiled(pattern).finditer(text)):
                yield n, m.start(), m.end(), m[0], {k: v for k, v in m.groupdict().items() if v is not None}


def find_all():
    """The table function, for lateralJoin."""
    from spanweave.session import ship_package

    ship_package(SparkSession.getActiveSession())
    return F.udtf(FindAll, returnType=ROW)


def register(spark: SparkSession, name: str = "find_all") -> None:
    """`SELECT ... FROM docs, LATERAL find_all(text, 'pattern')`."""
    spark.udtf.register(name, find_all())


def positions(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """docs' columns with (n, begin, end, match, groups) of each match; texts without one have no row."""
    re.compile(pattern)  # a wrong pattern fails here and not in a task
    found = docs.lateralJoin(find_all()(F.col(text_col).outer(), F.lit(pattern)).toDF("n", "begin", "end", "match", "groups"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], "n", "begin", "end", "match", "groups")


def stretches(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, begin, end, match, groups): from the end of each match to the next one, or to the end of the text."""
    found = positions(docs.select(id_col, text_col, F.char_length(text_col).alias("length")), pattern, text_col)
    after = F.lead("begin").over(W.partitionBy(id_col).orderBy("n"))
    return found.select(id_col, "n", F.col("end").alias("begin"), F.coalesce(after, F.col("length")).alias("end"), "match", "groups")


def speeches(docs: DataFrame, pattern: str = SPEAKER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, begin, end, label, title, name, party, role) of each speech: the text behind a speaker up to the next speaker. Groups that the pattern
    lacks or that are blank are null; the label is `name, role`, or the name."""
    clean = lambda k: F.nullif(F.btrim(F.regexp_replace(F.col("groups")[k], r"\s+", " ")), F.lit(""))
    found = stretches(docs, pattern, id_col, text_col).select(id_col, "n", "begin", "end", *[clean(k).alias(k) for k in ("title", "name", "party", "role")])
    return found.select(id_col, "n", "begin", "end", F.concat_ws(", ", "name", "role").alias("label"), "title", "name", "party", "role")
