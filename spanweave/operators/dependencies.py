"""Dependency arcs: heads, dependents, child tests and closures. Words: (doc_id, sent, id, head, upos, deprel)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["doc_id", "sent"]


def with_heads(words: DataFrame) -> DataFrame:
    """Every word with its head's id, part of speech and relation (null at a root)."""
    heads = words.select(*KEYS, F.col("id").alias("head"), F.col("upos").alias("head_upos"), F.col("deprel").alias("head_deprel"))
    return words.join(heads, [*KEYS, "head"], "left")


def having_child(words: DataFrame, relations: list[str]) -> DataFrame:
    """Words with any child in one of the relations."""
    children = words.where(F.col("deprel").isin(relations)).select(*KEYS, F.col("head").alias("id"))
    return words.join(children, [*KEYS, "id"], "left_semi")


def n_dependents(words: DataFrame) -> DataFrame:
    """Every word with its number of dependents, 0 at leaves."""
    counts = words.groupBy(*KEYS, F.col("head").alias("id")).agg(F.count("*").alias("n_dependents"))
    return words.join(counts, [*KEYS, "id"], "left").withColumn("n_dependents", F.coalesce("n_dependents", F.lit(0)))


def closures(words: DataFrame, stop_upos: str = "VERB", stop_deprel: str | None = None) -> DataFrame:
    """(doc_id, sent, root, id): what each word reaches downwards. A reached word of part of speech stop_upos or relation
    stop_deprel is left out with all below it. A sentence is one group, so groups stay small; cycles end."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        below: dict[int, list[int]] = {}
        stop = {i for i, u, d in zip(group["id"], group["upos"], group["deprel"], strict=True) if u == stop_upos or (stop_deprel is not None and d == stop_deprel)}
        for i, h in zip(group["id"], group["head"], strict=True):
            below.setdefault(h, []).append(i)
        rows = []
        for root in group["id"].drop_duplicates():
            seen, todo = {root}, [root]
            while todo:
                for child in below.get(todo.pop(), []):
                    if child not in seen and child not in stop:
                        seen.add(child)
                        todo.append(child)
            rows += [(group["doc_id"].iloc[0], group["sent"].iloc[0], root, i) for i in sorted(seen)]
        return pd.DataFrame(rows, columns=["doc_id", "sent", "root", "id"])

    return words.select(*KEYS, "id", "head", "upos", "deprel").groupBy(*KEYS).applyInPandas(run, "doc_id bigint, sent bigint, root bigint, id bigint")


CLAUSES = ("advcl", "ccomp", "acl", "xcomp")
MODIFIERS = ("amod", "nmod", "compound", "poss", "acl", "appos")


def syntactic_complexity(words: DataFrame) -> DataFrame:
    """The 14 ratios of second-language syntactic complexity of words (doc_id, sent, id, head, upos, feats, deprel): (doc_id, label,
    value), 0 over a zero count. Children are found by one semi-join a kind, on the sentence and the head; in sentence rows (doc_id, sent, ws array of
    structs of the other fields), which are taken where they are, among the sentence's own words."""
    if "ws" in words.columns:
        heads = lambda kinds: F.transform(F.filter("ws", lambda w: w["deprel"].isin(*kinds)), lambda w: w["head"])
        # the heads are made in a step of their own, once a sentence; its words come as rows after it, so that they are counted in compiled code
        listed = words.select("doc_id", "ws", heads(CLAUSES).alias("clauses"), heads(MODIFIERS).alias("modifiers"))
        each = listed.select("doc_id", "clauses", "modifiers", F.posexplode_outer("ws").alias("place", "w"))
        of = {k: F.col(f"w.{k}") for k in ("id", "upos", "feats", "deprel")}
        counts = _kinds(of["upos"], of["feats"], of["deprel"], F.array_contains("clauses", of["id"]), F.array_contains("modifiers", of["id"]))
        # a sentence without words counts as one
        return _ratios(each, {k: F.count_if(c) for k, c in ({"S": F.coalesce("place", F.lit(0)) == 0} | counts).items()})
    child = lambda kinds, flag: words.where(F.col("deprel").isin(*kinds)).select(*KEYS, F.col("head").alias("id")).distinct().withColumn(flag, F.lit(1))
    w = words.join(child(CLAUSES, "clause"), [*KEYS, "id"], "left").join(child(MODIFIERS, "modified"), [*KEYS, "id"], "left")
    counts = _kinds(F.col("upos"), F.col("feats"), F.col("deprel"), F.col("clause").isNotNull(), F.col("modified").isNotNull())
    sents = w.groupBy(*KEYS).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()])
    return _ratios(sents, {"S": F.count("*")} | {k: F.sum(k) for k in counts})


def _kinds(upos: Column, feats: Column, rel: Column, clause: Column, modified: Column) -> dict[str, Column]:
    """Which words each count is of."""
    verb, root = upos == "VERB", rel == "root"
    return {
        "W": upos != "PUNCT",
        "VP": verb & F.coalesce(feats, F.lit("")).contains("VerbForm=Fin"),
        "C": verb & rel.isin("root", *CLAUSES),
        "DC": verb & rel.isin(*CLAUSES),
        "T": root,
        "CT": root & clause,
        "CP": rel.isin("cc", "conj"),
        "CN": (upos == "NOUN") & modified,
    }


def _ratios(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """counts: the aggregate of each count."""
    d = rows.groupBy("doc_id").agg(*[c.alias(k) for k, c in counts.items()])
    ratios = {"MLC": ("W", "C"), "MLS": ("W", "S"), "MLT": ("W", "T")} | {f"{a}/{b}": (a, b) for a, b in (("C", "S"), ("C", "T"), ("CT", "T"), ("DC", "C"), ("DC", "T"), ("CP", "C"), ("CP", "T"), ("T", "S"), ("CN", "C"), ("CN", "T"), ("VP", "T"))}
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).alias("value")) for k, (a, b) in ratios.items()])
    return d.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def arc_nodes(arcs: DataFrame, tokens: DataFrame, node: str = "dependent") -> DataFrame:
    """Each arc with the token that its column `node` (governor or dependent) refers to by id: columns node_* of the token, null for an arc that refers to
    none, as a root's governor does."""
    met = tokens.select(*[F.col(c).alias(c if c in KEYS else node if c == "id" else f"node_{c}") for c in tokens.columns])
    return arcs.join(met, [*KEYS, node], "left")


def sentence_governors(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent, deprel, governor): each arc with its governor's text, null for an arc from outside the sentence. sentences (doc_id, sent, ws), whose words
    are in the order of their ids, 1 and on: a governor is looked up in its sentence, without a join."""
    arcs = F.transform("ws", lambda w: F.struct(w["deprel"].alias("deprel"), F.get("ws", w["head"] - 1)["text"].alias("governor")))
    return sentences.select(*KEYS, F.inline(arcs))
