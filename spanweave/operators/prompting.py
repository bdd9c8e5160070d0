"""Prompts whose messages use what earlier messages have said.

Messages (prompt_id, position, role, content, fillable, context_name, args map<string,string>) are taken in order of position. A template's `{name}`
stands for the prompt's args or for a message that was named so before; `{{` and `}}` are braces. An empty fillable message is
filled by the scorer, a function from the messages so far, (role, text) pairs, to a text. Each prompt is an ordered fold in one task, as its messages
depend on each other; prompts are dealt over the cluster.

Defined results: a null content is empty; a null position comes first; a name that nothing has given, and an error of the scorer, end in a
row with an error, and later messages of the prompt that need no such name go on; a name that is given again is written over; the args of a
prompt are those of its first message that has any.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spanweave.operators.semantics import ordered
from spanweave.session import ship_package

Scorer = Callable[[list[tuple[str, str]]], str]
_PART = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def rendered(template: str, context: dict[str, str]) -> str:
    """The template with its names replaced; KeyError names one that is missing."""

    def part(m: re.Match) -> str:
        return context[m[1]] if m[1] else m[0][0]

    return _PART.sub(part, template)


def answered(messages: DataFrame, load: Callable[[], Scorer]) -> DataFrame:
    """(prompt_id, position, role, text, filled, error): every message as it is sent or as it was filled. load makes the scorer, once a task."""
    ship_package(messages.sparkSession)
    types = dict(messages.dtypes)
    ddl = f"prompt_id {types['prompt_id']}, position {types['position']}, role string, text string, filled boolean, error string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, started, held, said, context = load(), False, None, [], {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not started or r["prompt_id"] != held:
                    started, held, said, context = True, r["prompt_id"], [], {}
                for k, v in r["args"] or []:
                    context.setdefault(k, v)
                text, error, fill = r["content"] or "", None, bool(r["fillable"]) and not r["content"]
                try:
                    text = score(list(said)) if fill else rendered(text, context)
                except KeyError as e:
                    text, error = None, f"unknown name {e.args[0]}" if not fill else f"scorer: {e!r}"
                except Exception as e:  # the scorer is the caller's
                    text, error = None, f"scorer: {e!r}"
                if text is not None:
                    said.append((r["role"], text))
                    if r["context_name"]:
                        context[r["context_name"]] = text
                out.append({"prompt_id": held, "position": r["position"], "role": r["role"], "text": text, "filled": fill, "error": error})
            yield pa.RecordBatch.from_pylist(out, schema)

    columns = ["prompt_id", "position", "role", "content", "fillable", "context_name", "args"]
    return ordered(messages.select(*columns), ["prompt_id"], ["position"]).mapInArrow(run, ddl)
