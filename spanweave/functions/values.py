"""Scalar rules: parameters, labels, tags, JSON bodies and model statistics."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the published decision threshold of the two-model detector.
TWO_MODEL_LIMIT = 0.9015310749276843


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase in an array of words."""
    n = len(phrase)
    places = F.sequence(F.lit(1), F.size(words) - n + 1)
    hits = F.filter(places, lambda i: F.slice(words, i, F.lit(n)) == F.array(*[F.lit(w) for w in phrase]))
    return F.when(F.size(words) >= n, F.size(hits)).otherwise(F.lit(0))


def clean_markup(text: Column) -> Column:
    """Without end marks, angle brackets and line breaks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "</s>|[<>]", ""), "[\\r\\n]+", " "))


def named_groups(text: Column, pattern: str, names: list[str]) -> Column:
    """A struct of a pattern's groups in order; null where the pattern is not found."""
    return F.when(text.rlike(pattern), F.struct(*[F.regexp_extract(text, pattern, i + 1).alias(k) for i, k in enumerate(names)]))


def tag_list(tags: Column) -> Column:
    """Tags between semicolons, commas and colons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(tags, "[;,:]"), lambda x: F.trim(x)), lambda x: x != "")


def zipped(labels: Column, scores: Column) -> Column:
    """Two parallel arrays as one of structs."""
    return F.zip_with(labels, scores, lambda k, v: F.struct(k.alias("label"), v.alias("score")))


def positive_scores(scores: Column) -> Column:
    return F.map_filter(scores, lambda _, v: v > 0)


def remapped(scores: Column, names: dict[str, str]) -> Column:
    """A map's labels through another; those that it lacks stay."""
    from spanweave.operators.filters import mapped

    return F.transform_keys(scores, lambda k, _: mapped(k, names))


def sign_label(label: Column) -> Column:
    """A sentiment label as -1, 0 or 1; null for others."""
    low = F.lower(label)
    return F.when(low.rlike("pos|^5|^4"), 1).when(low.rlike("neg|^1|^2"), -1).when(low.rlike("neu|^3"), 0)


def json_tag(value: Column, error: Column) -> Column:
    """A value or an error as JSON."""
    return F.to_json(F.struct(F.when(error.isNull(), value).alias("score"), error.alias("error")))


def tolerant_json(body: Column, schema: str) -> Column:
    """A JSON object, or one that is written as a string within JSON."""
    inner = F.from_json(F.concat(F.lit('{"s":'), body, F.lit("}")), "s string")["s"]
    return F.from_json(F.when(F.trim(body).startswith('"'), inner).otherwise(body), schema)


def stamped(now: Column | None = None) -> Column:
    """Seconds since 1970 of a modification."""
    return F.unix_timestamp(now) if now is not None else F.unix_timestamp()


def cross_entropy(log_probs: Column) -> Column:
    n = F.size(log_probs)
    return F.when(n > 0, -F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x) / n)


def machine_written(perplexity: Column, cross: Column) -> Column:
    """Whether the ratio of perplexity to cross perplexity lies under the limit."""
    return F.coalesce(perplexity / F.nullif(cross, F.lit(0.0)) < TWO_MODEL_LIMIT, F.lit(False))


def spanning_length(points: np.ndarray, power: float = 1.0) -> float:
    """The sum of the edges (to a power) of a least spanning tree, grown from one point."""
    if len(points) < 2:
        return 0.0
    near, left, total = np.linalg.norm(points - points[0], axis=1), np.ones(len(points), bool), 0.0
    left[0] = False
    for _ in range(len(points) - 1):
        k = int(np.where(left, near, np.inf).argmin())
        total += float(near[k]) ** power
        left[k] = False
        near = np.minimum(near, np.linalg.norm(points - points[k], axis=1))
    return total


def homology_dimension(points: np.ndarray, sizes: list[int], tries: int = 7, seed: int = 0) -> float | None:
    """1 / (1 - slope) of the log of tree lengths over the log of sample sizes; null with too few points."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for n in sizes:
        if n <= len(points):
            xs.append(np.log(n))
            ys.append(np.log(np.median([spanning_length(points[rng.choice(len(points), n, replace=False)]) for _ in range(tries)]) + 1e-12))
    if len(xs) < 2:
        return None
    slope = np.polyfit(xs, ys, 1)[0]
    return float(1 / (1 - slope)) if slope < 1 else None


@dataclass
class Parameters:
    """Named parameters of a call, and the errors found in them, which are returned beside the result."""

    given: dict
    errors: list[str] = field(default_factory=list)

    def text(self, *names: str, default: str | None = None) -> str | None:
        """The first of several names that is given."""
        return next((str(self.given[n]) for n in names if self.given.get(n) not in (None, "")), default)

    def number(self, name: str, default: float | None = None, least: float | None = None, most: float | None = None) -> float | None:
        """A number between bounds; null without a default where it is missing, an error where it is none or lies outside."""
        raw = self.given.get(name)
        if raw in (None, ""):
            return default
        try:
            value = float(raw)
        except (TypeError, ValueError):
            self.errors.append(f"{name} is no number")
            return default
        if (least is not None and value < least) or (most is not None and value > most):
            self.errors.append(f"{name} lies outside of its bounds")
            return default
        return value

    def reference_time(self) -> tuple[str | None, str]:
        return self.text("document_creation_time", "reference_time"), self.text("timezone", default="Europe/Berlin")

    def as_json(self) -> str:
        return json.dumps(self.errors)


def known_type(name: Column, known: list[str], base: str) -> Column:
    return F.when(name.isin(*known), name).otherwise(F.lit(base))
