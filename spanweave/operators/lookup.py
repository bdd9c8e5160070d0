"""Left lookups of word-like keys in tables of any size: broadcast below a counted bound, dealt over salted keys beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is sent to every executor, counted first; larger ones are shuffled.
BOUND = 100_000
#: Tasks that the rows of one key are dealt over in a shuffled lookup, so that a key of a third of all rows is no single task.
SALT = 16


def lookup(rows: DataFrame, table: DataFrame, key: str, bound: int = BOUND, salt: int = SALT) -> DataFrame:
    """rows with the table's columns, null where the key is null or not found. The table has its key once; its other columns don't clash with rows'."""
    if table.limit(bound + 1).count() <= bound:
        return rows.join(F.broadcast(table), key, "left")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salt)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")


def most_frequent(words: DataFrame, bound: int = BOUND) -> tuple[DataFrame, DataFrame]:
    """words (word, f) in two: the most frequent, at most `bound`, and the others. The line between them is one of a few steps of f, so no rows are ordered."""
    step = F.floor(F.log2(F.greatest("f", F.lit(1.0))) * 8)
    least, held = None, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        held += r.words
        if held > bound:
            break
        least = r.step
    return (words.where(F.lit(False)), words) if least is None else (words.where(step >= least), words.where(step < least))
