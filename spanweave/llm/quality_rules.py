"""Quality rules with adaptive thresholds. DataFrame operations only.

Every document is measured; each language and source gets a mergeable quantile sketch of each measure: counts of values by logarithmic
buckets, whose borders are powers of GAMMA, so a quantile is within a thousandth of a measured value. Counts merge by adding, a language's
sources into the language's and those into the table's, and a group with too few documents takes the thresholds of the wider one. The same
documents give the same thresholds, whatever the order or the partitions; they are written once before anything is judged by them. A document fails a rule if its measure lies beyond median +- `spread` times the group's
half-interquartile range (or the rule's least scale, so that a group without variation is not cut at its median). The
thresholds are then joined to the documents.

Defined results: a null or empty text has no words and fails the base rule; a null language or source counts as an empty
one; repeated rows are judged each; very long texts are measured whole, at some 40 bytes a word; an empty table gives an empty result; other
columns, a null id among them, are passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanweave.llm.support import Workspace, spare_name

SPACE = r"\x20\x09-\x0D"
WINDOW = 8
#: measure: (least scale, low side counts, high side counts)
RULES = {
    "mean_word": (0.6, True, True),
    "symbols_per_word": (0.02, False, True),
    "repeated_words": (0.05, False, True),
    "duplicate_lines": (0.05, False, True),
}
SPREAD = 6.0
LEAST_DOCS = 100
#: Ratio of a bucket's borders.
GAMMA = 1.002
QUARTILES = (0.25, 0.5, 0.75)


def _repeat_words(hashes: Column) -> Column:
    """Words inside WINDOW-word windows whose hash occurs twice or more in the text."""
    n = F.size(hashes) - (WINDOW - 1)
    windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(windows)


def measured(docs: DataFrame, text_col: str, carried: Column) -> DataFrame:
    """(r, m): the struct carried, and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    df = docs.select(carried.alias("r"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    df = df.select(
        "r",
        F.filter(F.split("t", f"[{SPACE}]+"), lambda w: w != "").alias("w"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
    )
    df = df.select("r", "n_symbols", "n_dup_lines", F.size("w").alias("n_words"), F.char_length(F.array_join("w", "")).alias("word_chars"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    df = df.select("*", _repeat_words(F.col("h")).alias("v")).drop("h")
    # few texts repeat a window: sort the bare hashes first, and pairs of hash and place only where two are equal
    df = df.select("*", F.sort_array("v").alias("s"))
    doubled = F.exists(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.col("s")[i] == F.col("s")[i - 1])
    df = df.select("r", "n_symbols", "n_dup_lines", "n_words", "word_chars", "v", F.when(F.size("s") < 2, False).otherwise(doubled).alias("again")).withColumn(
        "o", F.when(F.col("again"), F.sort_array(F.transform("v", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    at = F.filter("o", lambda p, i: ((i > 0) & (F.get("o", i - 1)["x"] == p["x"])) | F.coalesce(F.get("o", i + 1)["x"] == p["x"], F.lit(False)))
    df = df.drop("v").withColumn("p", F.when(F.col("again"), F.sort_array(F.transform(at, lambda p: p["i"])))).drop("o")
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    longs = {c: F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")}
    return df.select("r", F.struct(*longs.values(), F.coalesce(F.when(F.col("again"), covered), F.lit(0)).cast("long").alias("n_repeat_words")).alias("m"))


def _rates() -> dict[str, Column]:
    words = F.greatest(F.col("m.n_words"), F.lit(1)).cast("double")
    return {
        "mean_word": F.col("m.word_chars") / words,
        "symbols_per_word": F.col("m.n_symbols") / words,
        "repeated_words": F.col("m.n_repeat_words") / words,
        "duplicate_lines": F.col("m.n_dup_lines") / words * 10,
    }


def sketches(rates: DataFrame) -> DataFrame:
    """(level, lang, source, rule, bucket, n) of (lang, source, measures): level 0 is a source of a language, 1 a language, 2 the table. A bucket holds
    the values over GAMMA ** (bucket - 1) up to GAMMA ** bucket, the null bucket those of zero."""
    each = rates.select("lang", "source", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in RULES])))
    bucket = F.when(F.col("x") > 0, F.ceil(F.log("x") / F.log(F.lit(GAMMA)))).alias("bucket")
    counts = each.groupBy("lang", "source", "rule", bucket).agg(F.count("*").alias("n"))
    levels = F.array(*[F.struct(F.lit(i).alias("level"), lang.alias("lang"), source.alias("source")) for i, (lang, source) in enumerate(((F.col("lang"), F.col("source")), (F.col("lang"), F.lit("")), (F.lit(""), F.lit(""))))])
    return counts.select(F.explode(levels).alias("g"), "rule", "bucket", "n").groupBy("g.level", "g.lang", "g.source", "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(counts: DataFrame) -> DataFrame:
    """(level, lang, source, rule, n, q): the quartiles of each sketch, by the middle of the bucket they lie in."""
    group = ["level", "lang", "source", "rule"]
    # as many rows a group as buckets, a few thousand at most
    up = W.partitionBy(*group).orderBy(F.asc_nulls_first("bucket"))
    at = counts.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(W.partitionBy(*group)))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) * 2 / (1 + GAMMA))
    q = F.array(*[F.min(F.when(F.col("upto") >= p * F.col("all"), value)) for p in QUARTILES])
    return at.groupBy(*group).agg(F.max("all").alias("n"), q.alias("q"))


def thresholds(rates: DataFrame, spread: float = SPREAD, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, measure columns {rule}_low and {rule}_high) from rows of (lang, source, measures)."""
    of = lambda rule: F.max(F.when(F.col("rule") == rule, F.col("q"))).alias(rule)
    found = quartiles(sketches(rates)).groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *map(of, RULES))
    own = found.where("level = 0").drop("level")
    wide = found.where("level = 1").select("lang", F.struct("n", *RULES).alias("wide"))
    whole = found.where("level = 2").select(F.struct("n", *RULES).alias("whole"))
    df = own.join(wide, "lang").join(F.broadcast(whole))  # one row
    out = ["lang", "source"]
    for rule, (least, low, high) in RULES.items():
        q = F.when(F.col("n") >= least_docs, F.col(rule)).when(F.col("wide.n") >= least_docs, F.col(f"wide.{rule}")).otherwise(F.col(f"whole.{rule}"))
        q1, q2, q3 = (q[i] for i in range(3))
        scale = F.greatest(q3 - q2, q2 - q1, F.lit(least))
        out += [(q2 - spread * scale if low else F.lit(float("-inf"))).alias(f"{rule}_low"), (q2 + spread * scale if high else F.lit(float("inf"))).alias(f"{rule}_high")]
    return df.select(*out)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spread: float = SPREAD, columns: list[str] | None = None) -> DataFrame:
    """docs' columns (those named, or all) without rows dropped, plus struct `quality` (with underscores behind it where docs has such a
    column): the measures, base_failed, failed (names of rules) and kept. The measures are written once: both the thresholds and the
    result read them; the thresholds are written too, so that a task that runs again judges by the same."""
    names = docs.columns if columns is None else columns
    keys = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))]
    # the columns of docs lie in a struct of their own, by number, and can't clash with ours
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]) if names else F.struct(F.lit(0))
    m = measured(docs, text_col, F.struct(F.struct(*keys).alias("group"), own.alias("own")))
    space = Workspace(docs.sparkSession, "rules")
    m = space.write(m.select("r.group", "r.own", "m"), "measures")
    words, repeats = F.col("m.n_words"), F.col("m.n_repeat_words")
    rates = m.where(words > 0).select("group.lang", "group.source", *[c.alias(k) for k, c in _rates().items()])
    cuts = space.write(thresholds(rates, spread), "thresholds")
    cuts = cuts.select(F.struct("lang", "source").alias("group"), F.struct(*[c for c in cuts.columns if c not in ("lang", "source")]).alias("cuts"))
    joined = m.withColumn("base_failed", (words < 20) | (100 * repeats > 30 * words)).join(cuts, "group", "left")
    failed = F.array_compact(F.array(*[F.when((c < F.col(f"cuts.{r}_low")) | (c > F.col(f"cuts.{r}_high")), F.lit(r)) for r, c in _rates().items()]))
    verdict = F.struct("m.*", "base_failed", failed.alias("failed"), (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"))
    return joined.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(names)], verdict.alias(spare_name(docs, "quality")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = quality_rules(docs, columns=["doc_id"])
    return out.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")])
