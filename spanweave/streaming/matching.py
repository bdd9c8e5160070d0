"""Two-phase matching of entities: documents of a pipeline are stored as they come, and a finalising event matches all of them.

The stored entities are a list in the stream's state store, a pipeline a key. Finalising reads the list as a stream and emits its
rows; the matching itself is a join of those rows, dealt over the cluster, in the batch that follows. A pipeline keeps to the selection (the
class of annotation) that it began with.

Events (pipeline_id, seq, event, selection, entities array<struct<entity_id, text>>, clear): `process` stores a document, `finalize` emits, and
clears if `clear` is true. Events of one batch are taken in the order of seq.

Defined results: null entities are none; an entity without a text matches nothing; a null clear clears; another selection, an unknown event,
and finalising a pipeline that holds nothing are rows with a message, and the stream goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanweave.operators.matching import near_pairs
from spanweave.session import ship_package

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows emitted at once.
CHUNK = 5000
OUT = "pipeline_id string, seq bigint, kind string, doc_index bigint, entity_id bigint, text string, message string"
_NAMES = ["pipeline_id", "seq", "kind", "doc_index", "entity_id", "text", "message"]


class Store(StatefulProcessor):
    """Rows out: `stored` (a document's index and, in entity_id, its number of entities), `entity` for each one of a finalised pipeline, `error`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "selection string, documents bigint")
        self.entities = handle.getListState("entities", "doc_index bigint, entity_id bigint, text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out: list[tuple] = []
        for e in events.itertuples():
            if e.event == "process":
                out.append(self._process(key[0], e))
            elif e.event == "finalize":
                for row in self._finalize(key[0], e):
                    out.append(row)
                    if len(out) >= CHUNK:
                        yield _frame(out)
                        out = []
            else:
                out.append((key[0], e.seq, "error", None, None, None, f"unknown event {e.event}"))
        yield _frame(out)

    def _process(self, pipeline: str, e: tuple) -> tuple:
        held = self.head.get() if self.head.exists() else None
        selection, n = held or (e.selection, 0)
        if selection != e.selection:
            return pipeline, e.seq, "error", None, None, None, f"selection mismatch: expected {selection}, got {e.selection}"
        items = [] if e.entities is None else list(e.entities)
        if items:
            self.entities.appendList([(n, _field(x, "entity_id"), _field(x, "text")) for x in items])
        self.head.update((selection, n + 1))
        return pipeline, e.seq, "stored", n, len(items), None, None

    def _finalize(self, pipeline: str, e: tuple) -> Iterator[tuple]:
        if not self.head.exists():
            yield pipeline, e.seq, "error", None, None, None, "pipeline not found"
            return
        if self.entities.exists():
            for doc_index, entity_id, text in self.entities.get():
                yield pipeline, e.seq, "entity", doc_index, entity_id, text, None
        if e.clear is None or pd.isna(e.clear) or e.clear:
            self.entities.clear()
            self.head.clear()

    def close(self) -> None:
        pass


def _field(row: object, name: str) -> object:
    return row[name] if isinstance(row, dict) else getattr(row, name)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    return out.astype({"seq": "Int64", "doc_index": "Int64", "entity_id": "Int64"})


def stored(events: DataFrame) -> DataFrame:
    """The rows of Store over a stream of events."""
    ship_package(events.sparkSession)
    picked = events.select("pipeline_id", "seq", "event", "selection", "entities", "clear")
    return picked.groupBy("pipeline_id").transformWithStateInPandas(Store(), OUT, "Append", "None")


def stored_batch(events: DataFrame) -> DataFrame:
    """What a stream of these events emits as `entity` rows if each pipeline has one finalising event and one selection: a plain query. Documents are
    numbered as they stream by in their order; no pipeline is gathered."""
    last = events.where("event = 'finalize'").groupBy("pipeline_id").agg(F.min("seq").alias("last"))
    docs = events.where("event = 'process'").select("pipeline_id", "seq", "entities").join(last, "pipeline_id").where("seq < last")
    docs = docs.withColumn("doc_index", F.row_number().over(W.partitionBy("pipeline_id").orderBy("seq", "entities")).cast("long") - 1)
    return docs.select("pipeline_id", F.col("last").alias("seq"), "doc_index", F.inline("entities"))


def places(entities: DataFrame) -> DataFrame:
    """(pipeline_id, seq, text, at): the distinct texts of each pipeline in lower case, with the documents and numbers of their entities. Null and empty texts match nothing."""
    named = entities.where("text <> ''").select("pipeline_id", "seq", F.lower("text").alias("text"), F.struct("doc_index", "entity_id").alias("at"))
    return named.groupBy("pipeline_id", "seq", "text").agg(F.collect_list("at").alias("at"))


def matches(entities: DataFrame, threshold: float) -> DataFrame:
    """(pipeline_id, seq, doc_a, doc_b, entity_a, entity_b, similarity) of entities (pipeline_id, seq, doc_index, entity_id, text) of different documents of
    one pipeline, doc_a < doc_b, with 1 - edit distance / longer length >= threshold > 0, ignoring case. No pair is lost: near texts
    are found among the distinct ones, then told for every pair of their entities. A text's places lie in one row, so pairs of equal texts, the most by
    far, are told out of it without a join."""
    return place_matches(places(entities), threshold)


def place_matches(held: DataFrame, threshold: float) -> DataFrame:
    """matches of texts with their places, which several joins read."""
    keys = ["pipeline_id", "seq"]
    near = near_pairs(held.select(F.struct(*keys).alias("group"), "text"), threshold).select("group.*", "a", "b", "similarity")
    side = lambda k: held.select(*keys, F.col("text").alias(k), F.col("at").alias(f"at_{k}"))
    apart = near.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    equal = held.where("size(at) > 1").select(*keys, F.lit(1.0).alias("similarity"), F.explode("at").alias("x"), F.col("at").alias("others"))
    equal = equal.select(*keys, "similarity", "x", F.explode("others").alias("y")).where("x.doc_index < y.doc_index")
    apart = apart.select(*keys, "similarity", F.explode("at_a").alias("x"), "at_b").select(*keys, "similarity", "x", F.explode("at_b").alias("y")).where("x.doc_index <> y.doc_index")
    apart = apart.select(*keys, "similarity", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    told = {"doc_a": "x.doc_index", "doc_b": "y.doc_index", "entity_a": "x.entity_id", "entity_b": "y.entity_id"}
    return equal.unionByName(apart).select(*keys, *[F.col(v).alias(k) for k, v in told.items()], "similarity")


def start(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, threshold: float, available_now: bool = True):
    """Run the stream: each batch's told rows go to out/rows and its matches to out/matches, in a folder a batch, written over when a
    batch is run again. Returns the query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def batch(df: DataFrame, number: int) -> None:
        rows = f"{out}/rows/batch={number}"
        df.write.mode("overwrite").parquet(rows)
        told = df.sparkSession.read.schema(OUT).parquet(rows)
        matches(told.where("kind = 'entity'"), threshold).write.mode("overwrite").parquet(f"{out}/matches/batch={number}")

    writer = stored(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
