"""Line dedup by levelled sorted runs of line hashes.

A run holds (hash, owner): the 128-bit hash of each line key first seen in some batch and the smallest document that
holds it. Batches come by ascending document id. A batch merge-anti-joins the runs, so a key lies in one run only, and
adds its new keys as a run of level 0; when a level holds `fanout` runs they are merged into one run a level higher, so
there are O(log batches) runs of doubling size. DataFrame operations only.

Defined results: null or empty text is one empty line; empty tables give empty results; a null id sorts before all
others and all rows with one id count as one document, so repeated rows keep the same lines; columns beside the two named
are passed through, whatever their names; very long texts are split whole, a row of the index a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.support import ASCII_SPACE, Workspace, ascii_lower, spare_name

NULL_ID = -(2**63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


class LineRuns:
    """The levelled runs."""

    def __init__(self, space: Workspace, fanout: int = 2):
        self.space, self.fanout = space, fanout
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        out = runs[0] if runs else None
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def _sorted(self, run: DataFrame, name: str) -> DataFrame:
        return self.space.write(run.sortWithinPartitions("h"), name)

    def add(self, keys: DataFrame) -> None:
        """keys: (h, owner), one row a hash, none of which lies in a run."""
        level, run = 0, self._sorted(keys, "run0")
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionByName(other)
            compacted = self._sorted(merged.repartition("h"), f"run{level + 1}")
            self.space.drop(*self.levels[level])
            self.levels[level], run, level = [], compacted, level + 1


def mark_lines(space: Workspace, lines: DataFrame, batches: int, fanout: int = 2) -> DataFrame:
    """lines: a written table (doc, row, pos, h) -> the (doc, row, pos) that go."""
    cuts = lines.agg(F.percentile_approx("doc", [(i + 1) / batches for i in range(batches - 1)], 1000)).first()[0] or [] if batches > 1 else []
    cuts = sorted(set(cuts))
    runs, gone = LineRuns(space, fanout), []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("doc") > low)
        if high is not None:
            batch = batch.where(F.col("doc") <= high)
        keys = batch.groupBy("h").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
        seen = runs.all()
        if seen is None:
            state = keys.select("h", "owner", "last", F.lit(True).alias("new"))
        else:
            state = keys.join(seen.select("h", F.col("owner").alias("prior")), "h", "left").select("h", F.coalesce("prior", "owner").alias("owner"), "last", F.col("prior").isNull().alias("new"))
        state = space.write(state, "state")
        doubled = state.where("last > owner").select("h", "owner")
        gone.append(space.write(batch.join(doubled, "h").where("doc > owner").select("doc", "row", "pos"), "gone"))
        if high is not None:  # no batch comes after the last
            runs.add(state.where("new").select("h", "owner"))
        space.drop(state)
    out = gone[0]
    for more in gone[1:]:
        out = out.unionByName(more)
    return out


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 3, fanout: int = 2) -> DataFrame:
    """docs with text_col cut down to the lines that stay, plus n_lines and n_dropped in struct `line_dedup` (with underscores behind it
    where docs has such a column)."""
    space = Workspace(spark, "lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.xxhash64(text)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    lines = docs.select(doc.alias("doc"), row.alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    lines = space.write(lines.select("doc", "row", "pos", F.unhex(F.md5("key")).alias("h")), "lines")
    gone = mark_lines(space, lines, batches, fanout).groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    named = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    joined = docs.select(named.alias("doc_row"), doc.alias("doc"), row.alias("row"), text.alias("whole")).join(gone, ["doc", "row"], "left")
    parts, cut = F.split("whole", "\n"), F.coalesce("gone", F.array().cast("array<int>"))
    bounds = F.concat(F.array(F.lit(-1)), cut, F.array(F.size(parts)))
    joined = joined.select("doc_row", parts.alias("parts"), F.size(cut).alias("n_dropped"), bounds.alias("bounds"))
    stay = F.flatten(F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), lambda k: F.slice(F.col("parts"), F.col("bounds")[k - 1] + 2, F.col("bounds")[k] - F.col("bounds")[k - 1] - 1)))
    kept = F.when(F.col("n_dropped") == 0, F.col("parts")).otherwise(stay)
    joined = joined.select("doc_row", F.array_join(kept, "\n").alias("kept"), F.size("parts").alias("n_lines"), "n_dropped")
    fields = [(F.col("kept") if c == text_col else F.col(f"doc_row.`{c}`")).alias(c) for c in docs.columns]
    return joined.select(*fields, F.struct(F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped")).alias(spare_name(docs, "line_dedup")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(spark, docs)
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT doc_id, pos, line, (owner IS NOT NULL AND owner < doc_id) AS gone FROM keyed LEFT JOIN owners USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
