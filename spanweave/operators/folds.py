"""Ordered folds: a group's rows pass through one worker in their order, as a stream, with a state that the fold keeps small."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Fold(Protocol):
    """The state of one group."""

    def take(self, *values: Any) -> list[tuple]:
        """Rows that a row of the group completes."""

    def end(self) -> list[tuple]:
        """Rows that the group's end completes."""


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Fold], out: StructType, batch: int = 8192) -> DataFrame:
    """keys and the rows that start() gives for each group: its rows' columns are taken in the order, nulls first. Rows of a group are never held
    together: partitions are sorted, and a group ends where the keys change. Null keys are a group like any other; groups of no rows are none."""
    schema = StructType([*[rows.schema[k] for k in keys], *out.fields])
    arrow = to_arrow_schema(schema)
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, done = None, None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in [*keys, *columns]], strict=True):
                key = row[:at]
                if state is None or key != held:
                    if state is not None:
                        done += [(*held, *r) for r in state.end()]
                    state, held = start(), key
                done += [(*key, *r) for r in state.take(*row[at:])]
                if len(done) >= batch:
                    yield made()
                    done.clear()
        if state is not None:
            done += [(*held, *r) for r in state.end()]
        if done:
            yield made()

    needed = list(dict.fromkeys([*keys, *order, *columns]))
    return rows.select(*needed).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
