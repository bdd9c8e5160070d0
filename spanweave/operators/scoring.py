"""The scorer interface: a model is a factory, called once a task, of a function from texts to label scores."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[list[str]], list[dict[str, float]]]


@dataclass(frozen=True)
class Annotator:
    """What a component declares: who it is, what it takes, and how to load it."""

    name: str
    version: str
    load: Callable[[], Scorer]
    languages: tuple[str, ...] = ()
    deterministic: bool = True


class LoadedModels:
    """At most `most` models held by one worker; the one that was used longest ago goes first."""

    def __init__(self, most: int = 2):
        if most < 1:
            raise ValueError("most must be 1 or more")
        self.most = most
        self.held: OrderedDict[Hashable, Scorer] = OrderedDict()

    def get(self, key: Hashable, load: Callable[[], Scorer]) -> Scorer:
        if key not in self.held:
            while len(self.held) >= self.most:
                self.held.popitem(last=False)
            self.held[key] = load()
        self.held.move_to_end(key)
        return self.held[key]


#: The models of this worker process.
_LOADED = LoadedModels()


def loaded(annotator: Annotator) -> Scorer:
    """The annotator's model: the one that this worker holds, or a new one in place of the one used longest ago."""
    return _LOADED.get((annotator.name, annotator.version), annotator.load)


def annotate(spans: DataFrame, annotator: Annotator, text_col: str = "text") -> DataFrame:
    """spans plus scores map<string,double>, the top label and provenance; languages that aren't supported get an error."""
    known = F.lit(True) if not annotator.languages else F.coalesce(F.col("lang").isin(*annotator.languages), F.lit(False))
    df = spans.withColumn("_ok", known)
    fields = spans.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = loaded(annotator)
        for pdf in batches:
            pdf["scores"] = None
            ok = pdf.index[pdf["_ok"]]
            if len(ok):
                pdf.loc[ok, "scores"] = pd.Series(score(pdf.loc[ok, text_col].fillna("").tolist()), index=ok, dtype=object)
            yield pdf

    out = df.mapInPandas(run, f"struct<{fields},_ok:boolean,scores:map<string,double>>")
    best = F.array_sort(F.map_entries("scores"), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(F.when(a["key"] < b["key"], -1).otherwise(1)))
    return out.select(*spans.columns, "scores", F.get(best, F.lit(0))["key"].alias("label"), F.when(~F.col("_ok"), F.lit("unsupported language")).alias("error"), F.struct(F.lit(annotator.name).alias("annotator"), F.lit(annotator.version).alias("version")).alias("provenance"))
