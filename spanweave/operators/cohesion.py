"""Coh-Metrix indices from token rows (doc_id, para, sent, pos, text, lemma, pos_coarse, tag, dep_type, is_punct, tense), as
rows (doc_id, label, value, error). An index that a document gives no number for is null with an error, and removes no other.

Tokens are first gathered a sentence (one shuffle by document, whose sentences then lie together); what compares
neighbours streams through a worker. Texts without a pair of neighbours or paragraphs, and without a root, have SYNMED*, SYNSTRUT* and SYNLE 0. All-pairs indices count the pairs
of sentences that share a word, over word numbers, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanweave.functions.metrics import syllables
from spanweave.operators.edits import edit_distances
from spanweave.operators.lookup import BOUND, most_frequent
from spanweave.operators.matching import phrases
from spanweave.operators.sentence_pairs import HELD, TOKENS, Pairs, Tokens, distinct, neighbours, stretches
from spanweave.session import ship_package
from spanweave.workspace import dealt

NOUNS, CONTENT = ("NOUN", "PROPN"), ("NOUN", "VERB", "ADJ", "ADV")
ROOTS = ("--", "ROOT", "root")
#: Words of letters alone.
ALPHA = r"^\p{L}+$"
#: Pronouns by person and number, English and German.
PERSONS = {
    "WRDPRP1s": ("i", "me", "my", "mine", "myself", "ich", "mich", "mir"),
    "WRDPRP1p": ("we", "us", "our", "ours", "ourselves", "wir", "uns"),
    "WRDPRP2": ("you", "your", "yours", "yourself", "yourselves", "du", "dich", "dir", "ihr", "euch"),
    "WRDPRP3s": ("he", "him", "his", "she", "her", "hers", "it", "its", "er", "ihn", "ihm", "es"),
    "WRDPRP3p": ("they", "them", "their", "theirs", "sie", "ihnen"),
}
#: Labels that have no computation: they are given as null with this error.
NOT_COMPUTED = [f"PC{c}{k}" for c in ("NAR", "SYN", "CNC", "REF", "DC", "VERB", "CONN", "TEMP") for k in "zp"] + ["WRDFRQc", "WRDFRQa", "WRDFRQmc"]


def rows_of(values: DataFrame, labels: list[str]) -> DataFrame:
    """One row a label of wide (doc_id, label columns)."""
    each = F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).cast("double").alias("value")) for k in labels])
    out = values.select("doc_id", F.explode(each).alias("r")).select("doc_id", "r.*")
    bad = F.col("value").isNull() | F.isnan("value")
    return out.select("doc_id", "label", F.when(~bad, F.col("value")).alias("value"), F.when(bad, F.lit("no value")).alias("error"))


def not_computed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array(*[F.lit(k) for k in NOT_COMPUTED])).alias("label")).select("doc_id", "label", F.lit(None).cast("double").alias("value"), F.lit("not implemented").alias("error"))


def gathered(tokens: DataFrame) -> DataFrame:
    """A row a sentence: (doc_id, para, sent, toks array of structs in order, n number of the sentence in its document from 1). Sentence rows, as a tagger
    makes them out of a document's row, are taken as they are, without a shuffle."""
    if "toks" in tokens.columns:
        return tokens
    fields = [c for c in ("pos", "text", "lemma", "pos_coarse", "tag", "dep_type", "is_punct", "tense") if c in tokens.columns]
    each = tokens.groupBy("doc_id", "para", "sent").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("toks"))
    return each.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("para", "sent")))


def _pick(field: str, *coarse: str) -> Column:
    """The distinct values of a field among tokens of some parts of speech."""
    return F.array_distinct(F.transform(F.filter("toks", lambda t: t["pos_coarse"].isin(*coarse)), lambda t: t[field]))


def _nodes() -> Column:
    """The distinct pairs of dependency and part of speech of the words."""
    return F.array_distinct(F.transform(F.filter("toks", lambda t: ~t["is_punct"]), lambda t: F.concat_ws(" ", t["dep_type"], t["pos_coarse"])))


def _field(name: str) -> Column:
    return F.transform("toks", lambda t: t[name])


def descriptive(tokens: DataFrame) -> DataFrame:
    """Sums of whole numbers a sentence: tokens of one part of the rows are added up before anything is shuffled."""
    word = ~F.col("is_punct")
    letters, sylls = F.char_length(F.regexp_replace("text", r"[^\p{L}]", "")), syllables(F.col("text"))
    each = tokens.select("doc_id", "para", "sent", word.cast("int").alias("w"), F.when(word, letters).otherwise(0).alias("l"), F.when(word, sylls).otherwise(0).alias("y"))
    sums = [F.sum(c).cast("double").alias(k) for k, c in {"l": F.col("l"), "l2": F.col("l") * F.col("l"), "y": F.col("y"), "y2": F.col("y") * F.col("y")}.items()]
    s = each.groupBy("doc_id", "para", "sent").agg(F.sum("w").alias("w"), *sums)
    p = s.groupBy("doc_id", "para").agg(F.count("*").alias("k"), *[F.sum(c).alias(c) for c in ("w", "l", "l2", "y", "y2")], F.sum(F.col("w") * F.col("w")).alias("w2"))
    d = p.groupBy("doc_id").agg(F.count("*").alias("DESPC"), F.sum("k").alias("DESSC"), F.sum("w").alias("DESWC"), F.avg("k").alias("DESPL"), F.stddev_pop("k").alias("DESPLd"), *[F.sum(c).alias(c) for c in ("l", "l2", "y", "y2", "w2")])

    def mean_sd(total: str, squares: str, n: str) -> tuple[Column, Column]:
        m = F.col(total) / F.nullif(F.col(n), F.lit(0))
        return m, F.sqrt(F.greatest(F.col(squares) / F.nullif(F.col(n), F.lit(0)) - m * m, F.lit(0.0)))

    for label, c, n in (("DESSL", "w", "DESSC"), ("DESWLsy", "y", "DESWC"), ("DESWLlt", "l", "DESWC")):
        mean, sd = mean_sd("DESWC" if c == "w" else c, f"{c}2", n)
        d = d.withColumns({label: mean, f"{label}d": sd})
    return rows_of(d, ["DESPC", "DESSC", "DESWC", "DESPL", "DESPLd", "DESSL", "DESSLd", "DESWLsy", "DESWLsyd", "DESWLlt", "DESWLltd"])


def _each_token(tokens: DataFrame) -> DataFrame:
    """Token rows of either form, in the partitions of sentence rows."""
    return tokens.select("doc_id", F.inline("toks")) if "toks" in tokens.columns else tokens


def word_information(tokens: DataFrame) -> DataFrame:
    """WRD incidences a 1000 words, type-token ratios, and the share of the most frequent tense. Tokens are counted once, a row a document, kind and
    word, so that distinct counts need no sets; sentence rows that are dealt by document stay where they are."""
    word, alpha, pos, low = ~F.col("is_punct"), F.col("text").rlike(ALPHA), F.col("pos_coarse"), F.lower("text")
    coarse = {"WRDNOUN": NOUNS, "WRDVERB": ("VERB",), "WRDADJ": ("ADJ",), "WRDADV": ("ADV",), "WRDPRO": ("PRON",)}
    kinds = {
        "word": F.when(word, F.lit("")), "pos": pos, "pronoun": F.when(pos == "PRON", low), "type": F.when(alpha, low), "tense": F.col("tense"),
        "lemma": F.when(alpha & pos.isin(*CONTENT), F.lower(F.coalesce(F.nullif("lemma", F.lit("")), "text"))),
    }
    each = _each_token(tokens).select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("of")) for k, v in kinds.items()])).alias("x"))
    # a document of no counted token keeps its row
    counted = each.groupBy("doc_id", "x.kind", "x.of").agg(F.count("*").alias("n"))
    of = lambda kind, told=F.lit(True): F.when((F.col("kind") == kind) & F.col("of").isNotNull() & told, F.col("n"))
    per = lambda c: 1000 * F.coalesce(F.sum(c), F.lit(0)) / F.sum(of("word"))
    values = [per(of("pos", F.col("of").isin(*v))).alias(k) for k, v in coarse.items()] + [per(of("pronoun", F.col("of").isin(*v))).alias(k) for k, v in PERSONS.items()]
    ratio = lambda kind: F.count(of(kind)) / F.sum(of(kind))
    values += [ratio("type").alias("LDTTRa"), ratio("lemma").alias("LDTTRc"), (F.max(of("tense")) / F.sum(of("tense"))).alias("SMTEMP")]
    return rows_of(counted.groupBy("doc_id").agg(*values), [*coarse, *PERSONS, "LDTTRa", "LDTTRc", "SMTEMP"])


def densities(tokens: DataFrame, lang: str = "en") -> DataFrame:
    """DR incidences a 1000 words. A noun phrase ends at a noun that no noun follows; an infinitive follows `to` or `zu`, or a modal verb at one or two
    words' distance. A German passive is werden or sein with a participle in the sentence."""
    after = W.partitionBy("doc_id", "para", "sent").orderBy("pos")
    ahead = lambda k: (F.coalesce(F.lead("tag", k).over(after) == "VVINF", F.lit(False)) & (F.lead("pos_coarse", k).over(after) == "VERB"))
    t = tokens.select("*", F.lead("pos_coarse").over(after).alias("next"), F.lead("tag").over(after).alias("next_tag"), F.lag("pos").over(after).isNotNull().alias("inner"), (ahead(1) | ahead(2)).alias("infinitive"))
    noun = F.col("pos_coarse").isin(*NOUNS)
    auxiliary = F.upper("dep_type").isin("AUXPASS", "NSUBJPASS") if lang != "de" else F.lower("lemma").isin("werden", "sein")
    participle = F.col("tag") == "VVPP" if lang == "de" else F.lit(True)
    found = {
        "DRNP": noun & ~F.coalesce(F.col("next").isin(*NOUNS), F.lit(False)),
        "DRVP": F.col("pos_coarse") == "VERB",
        "DRAP": F.col("pos_coarse") == "ADV",
        "DRPP": F.col("pos_coarse") == "ADP",
        "DRNEG": F.col("dep_type").isin("NEG", "NG"),
        "DRGERUND": (F.col("tag") == "VBG") & F.lit(lang != "de"),
        "DRINF": F.lower("text").isin("to", "zu") & F.col("inner") & F.col("next_tag").isin("VB", "VVINF") & (F.col("next") == "VERB"),
        "modal": (F.col("tag") == "VM") & (F.col("pos_coarse") == "VERB") & F.col("inner") & F.col("infinitive"),
    }
    s = t.groupBy("doc_id", "para", "sent").agg(*[F.count_if(c).alias(k) for k, c in found.items()], (F.max(auxiliary) & F.max(participle)).cast("int").alias("DRPVAL"), F.count_if(~F.col("is_punct")).alias("w"))
    s = s.withColumn("DRINF", F.col("DRINF") + F.col("modal"))
    labels = [*[k for k in found if k != "modal"], "DRPVAL"]
    d = s.groupBy("doc_id").agg(*[(1000 * F.sum(k) / F.nullif(F.sum("w"), F.lit(0))).alias(k) for k in labels])
    return rows_of(d, labels)


#: Phrases up to which a lexicon is sent to every task.
LISTED = 20_000


def incidences(tokens: DataFrame, lexicon: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, label, value): phrases of a lexicon (label, phrase), of at most `most` words, a 1000 words: connectives (CNC*) and causal or
    intentional verbs and particles (SM*). An equi-join on the n-gram of the words of a sentence."""
    words = F.transform(F.filter("toks", lambda t: ~t["is_punct"]), lambda t: F.lower(t["text"]))
    s = gathered(tokens).select("doc_id", F.array_join(words, " ").alias("text"), F.size(words).alias("w"))
    sizes = s.groupBy("doc_id").agg(F.sum("w").alias("w"))
    lists = lexicon.select("label", F.lower("phrase").alias("phrase")).distinct()
    # lists written by hand go to the texts, so that no n-gram is shuffled; only a longer one is met by a shuffle of the n-grams
    if lists.limit(LISTED + 1).count() <= LISTED:
        lists = F.broadcast(lists)
    found = phrases(s, most).join(lists, "phrase").groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    labels = lexicon.agg(F.sort_array(F.collect_set("label")).alias("labels"))  # one row
    every = sizes.crossJoin(F.broadcast(labels)).select("doc_id", "w", F.explode("labels").alias("label"))
    wide = every.join(found, ["doc_id", "label"], "left").select("doc_id", "label", (1000 * F.coalesce("n", F.lit(0)) / F.nullif("w", F.lit(0))).alias("value"))
    return wide.withColumn("error", F.when(F.col("value").isNull(), F.lit("no value")))


def situation(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """SMCAUSv, SMCAUSvp and SMINTEp, incidences a 1000 words, and the ratios of particles to verbs SMCAUSr and SMINTEr, 0 without a verb. lexicon (kind, word) has
    the kinds causal_verb and intentional_verb, whose words are lemmas that count for verbs alone, and causal_particle and
    intentional_particle, whose words are forms of any part of speech."""
    lists = lexicon.select("kind", F.lower("word").alias("word")).distinct()
    flags = lambda end: lists.where(F.col("kind").endswith(end)).groupBy("word").agg(*[F.max(F.col("kind") == f"{k}_{end}").alias(f"{k}_{end}") for k in ("causal", "intentional")])
    # words are counted a document before they are looked up; what is no verb has no lemma and meets no list
    def met(words: Column, end: str) -> DataFrame:
        counts = tokens.select("doc_id", words.alias("word")).where("word is not null").groupBy("doc_id", "word").agg(F.count("*").alias("n"))
        return counts.join(flags(end), "word").select("doc_id", *[F.when(F.col(f"{k}_{end}"), F.col("n")).alias(f"{k}_{end}") for k in ("causal", "intentional")])

    kinds = [f"{k}_{end}" for k in ("causal", "intentional") for end in ("verb", "particle")]
    sizes = tokens.groupBy("doc_id").agg(F.count_if(~F.col("is_punct")).alias("w"))
    rows = sizes.unionByName(met(F.when(F.col("pos_coarse") == "VERB", F.lower("lemma")), "verb"), allowMissingColumns=True).unionByName(met(F.lower("text"), "particle"), allowMissingColumns=True)
    d = rows.groupBy("doc_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("w", *kinds)])
    per = lambda n: 1000 * n / F.nullif("w", F.lit(0))
    part = lambda k: F.coalesce(F.col(f"{k}_particle") / F.nullif(f"{k}_verb", F.lit(0)), F.lit(0.0))
    wide = d.select("doc_id", per(F.col("causal_verb")).alias("SMCAUSv"), per(F.col("causal_verb") + F.col("causal_particle")).alias("SMCAUSvp"), per(F.col("intentional_verb")).alias("SMINTEp"), part("causal").alias("SMCAUSr"), part("intentional").alias("SMINTEr"))
    return rows_of(wide, ["SMCAUSv", "SMCAUSvp", "SMINTEp", "SMCAUSr", "SMINTEr"])


def ratio(found: DataFrame, label: str, over: str, under: str) -> DataFrame:
    """(doc_id, label, value, error): a ratio of two labels of incidences(), such as particles to verbs (SMCAUSr, SMINTEr)."""
    wide = found.groupBy("doc_id").agg(F.max(F.when(F.col("label") == over, F.col("value"))).alias("a"), F.max(F.when(F.col("label") == under, F.col("value"))).alias("b"))
    return rows_of(wide.select("doc_id", (F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias(label)), [label])


def word_means(tokens: DataFrame, norms: DataFrame, measures: dict[str, str], coarse: tuple[str, ...] = CONTENT) -> DataFrame:
    """Means of norms (word, measures...) over the words of some parts of speech that have a rating: age of acquisition, familiarity,
    concreteness, imagery, meaningfulness, polysemy, hypernymy. measures: label -> column."""
    counts = _each_token(tokens).where(F.col("pos_coarse").isin(*coarse)).select("doc_id", F.lower("text").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("times"))
    rated = counts.join(norms, "word")
    # words are counted a document before they are looked up
    return rows_of(rated.groupBy("doc_id").agg(*[(F.sum(F.col(c) * F.col("times")) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("times"))), F.lit(0))).alias(k) for k, c in measures.items()]), list(measures))


def frequency_means(tokens: DataFrame, frequencies: DataFrame, floor: float = 1e-5, bound: int = BOUND) -> DataFrame:
    """WRDFRQ indices over a frequency list (word, f), which has a word once; words that it lacks count 0. The most frequent words, at most `bound`, meet their
    frequencies where the sentences lie, by a broadcast, and are added up there to one row a sentence; only the others are shuffled, a row a sentence and word."""
    sent = ["doc_id", "para", "sent"]
    each = tokens.select(*sent, F.inline("toks")) if "toks" in tokens.columns else tokens
    content = F.coalesce(F.col("pos_coarse").isin(*CONTENT), F.lit(False))
    each = each.where(~F.col("is_punct")).select(*sent, content.alias("content"), F.coalesce(F.lower("text"), F.lit("")).alias("word"))
    listed = frequencies.select("word", F.coalesce(F.col("f").cast("double"), F.lit(0.0)).alias("f"))
    common, rare = most_frequent(listed, bound)
    met = each.join(F.broadcast(common), "word", "left")
    log = lambda f: F.log(f + F.lit(floor))
    # the common words of a sentence become one row, under a key of their document's, so that they are dealt over the tasks too
    told = F.col("f").isNotNull().alias("told")
    key = F.when(F.col("f").isNull(), F.col("word")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("word")
    sums = [F.sum(F.when(F.col("content"), F.col("f"))).alias("cf"), F.count_if("content").alias("cn"), F.sum(log(F.col("f"))).alias("al"), F.count("*").alias("an"), F.min(F.when(F.col("content"), log(F.col("f")))).alias("low")]
    firsts = met.groupBy(*sent, told, key).agg(*sums)
    looked = dealt(firsts).join(dealt(rare), "word", "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    own = lambda c, v: F.when(F.col("told"), F.col(c)).otherwise(v).alias(c)
    some = F.col("cn") > 0
    values = [own("cf", F.when(some, F.col("f") * F.col("cn"))), own("al", log(F.col("f")) * F.col("an")), own("low", F.when(some, log(F.col("f"))))]
    s = looked.select(*sent, "cn", "an", *values).groupBy(*sent).agg(*[F.sum(c).alias(c) for c in ("cf", "cn", "al", "an")], F.min("low").alias("low"))
    d = s.groupBy("doc_id").agg((F.sum("cf") / F.nullif(F.sum("cn"), F.lit(0))).alias("WRDFRQc_wiki10000"), (F.sum("al") / F.sum("an")).alias("WRDFRQa_wiki10000"), F.avg("low").alias("WRDFRQmc_wiki10000"))
    return rows_of(d, ["WRDFRQc_wiki10000", "WRDFRQa_wiki10000", "WRDFRQmc_wiki10000"])


def adjacent(tokens: DataFrame) -> DataFrame:
    """Indices over neighbouring sentences: overlap of nouns, arguments, stems and content words, edit distance, syntax similarity. Sentences stream through a
    worker in order, many pairs at once; only the values of a pair leave it."""
    labels = ["CRFNO1", "CRFAO1", "CRFSO1", "CRFCWO1", "SYNSTRUTa", "SYNMEDpos", "SYNMEDwrd", "SYNMEDlem"]
    ship_package(tokens.sparkSession)

    def measured(rows: pa.RecordBatch, known: int) -> list[pa.Array]:
        t, pair = Tokens(rows), rows.column("n").to_numpy() > 1
        pair[0] = False
        second = np.flatnonzero(pair)

        def share(of: np.ndarray) -> np.ndarray:
            size, common = np.bincount(of % t.rows, minlength=t.rows), neighbours(of, of, t.rows)
            return common / np.maximum(size + np.append(0, size[:-1]) - common, 1)

        def edits(field: str) -> np.ndarray:
            code, texts = t.joined(field)
            both, inverse = np.unique(code[second] * len(texts) + code[second - 1], return_inverse=True)
            left, right = both // len(texts), both % len(texts)
            found, size = edit_distances(texts, left, right)
            out = np.zeros(t.rows)
            out[second] = (found / np.maximum(np.maximum(size[left], size[right]), 1))[inverse]
            return out

        met = lambda a, b: neighbours(a, b, t.rows) > 0
        nouns, stems, prons, content = t.held("text", *NOUNS), t.held("lemma", *NOUNS), t.held("text", "PRON"), t.held("lemma", *CONTENT)
        node, _ = t.nodes()
        values = [met(nouns, nouns), met(stems, stems) | met(prons, prons), met(stems, content), share(content), share(distinct(node * t.rows + t.row[t.word]))]
        values += [edits(c) for c in ("pos_coarse", "text", "lemma")]
        place = t.roots(ROOTS)
        made = [*[pa.array(v.astype(np.float64), mask=~pair) for v in values], pa.array(place.astype(np.float64), mask=place < 0)]
        return [rows.column("doc_id").slice(known), *[v.slice(known) for v in made]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in enumerate(stretches(batches, 4 * TOKENS, False)):
            yield pa.RecordBatch.from_arrays(measured(rows, int(k > 0)), ["doc_id", *labels, "place"])

    s = gathered(tokens).select("doc_id", F.col("n").cast("long").alias("n"), "toks")
    b = s.mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, " + ", ".join(f"{k} double" for k in [*labels, "place"]))
    wide = b.groupBy("doc_id").agg(*[F.avg(k).alias(k) for k in labels], F.stddev_pop("CRFCWO1").alias("CRFCWO1d"), F.avg("place").alias("SYNLE"))
    zeros = {k: F.coalesce(k, F.lit(0.0)) for k in ("SYNSTRUTa", "SYNMEDpos", "SYNMEDwrd", "SYNMEDlem", "SYNLE")}
    return rows_of(wide.withColumns(zeros), [*labels, "CRFCWO1d", "SYNLE"])


#: Tokens of whole documents that are counted together.
DENSE = TOKENS


def all_pairs(tokens: DataFrame, block: int = HELD, dense: int = DENSE) -> DataFrame:
    """Indices over all pairs of a document's sentences, and the syntax similarity of all pairs of its paragraphs, each the union of its sentences'
    nodes. Documents are read as streams of sentence rows, whole ones together up to `dense` tokens; of their pairs with their common words `block` are held at
    once. Only pairs that share a word are looked at, and memory grows with a document's words, not with its pairs."""
    labels = ["CRFNOa", "CRFAOa", "CRFSOa", "CRFCWOa", "CRFCWOad", "SYNSTRUTt"]
    ship_package(tokens.sparkSession)

    def measured(rows: pa.RecordBatch) -> tuple[pa.Array, list[np.ndarray]]:
        t, n, para = Tokens(rows), rows.column("n").to_numpy(), rows.column("para").to_numpy()
        firsts = np.flatnonzero(n == 1)
        stems, content = t.held("lemma", *NOUNS), t.held("lemma", *CONTENT)
        either = np.append(stems, t.held("text", "PRON", base=len(t.codes("lemma")[1])))
        pairs = Pairs(firsts, t.rows, block)
        some = np.maximum(pairs.pairs, 1)
        binary = [pairs.meeting(a, b) / some for a, b in ((t.held("text", *NOUNS),) * 2, (either,) * 2, (stems, content))]
        total, squares = pairs.shares(content)
        mean = total / some
        values = [*binary, mean, np.sqrt(np.maximum(squares / some - mean**2, 0))]
        # paragraphs are rows of their own
        begins = (n == 1) | np.append(True, para[1:] != para[:-1])
        number, (node, _) = np.cumsum(begins) - 1, t.nodes()
        n_paras = int(number[-1]) + 1
        across = Pairs(number[firsts], n_paras, block)
        alike = across.shares(distinct(node * n_paras + number[t.row[t.word]]))[0] / np.maximum(across.pairs, 1)
        return rows.column("doc_id").take(pa.array(firsts)), [*[pa.array(v, mask=pairs.pairs == 0) for v in values], pa.array(alike)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches(batches, dense):
            doc, values = measured(rows)
            yield pa.RecordBatch.from_arrays([doc, *values], ["doc_id", *labels])

    s = gathered(tokens).select("doc_id", F.col("n").cast("long").alias("n"), F.col("para").cast("long").alias("para"), "toks")
    wide = s.mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, " + ", ".join(f"{k} double" for k in labels))
    return rows_of(wide, labels)


def _mtld(words: list[str], limit: float = 0.72, least: int = 10) -> float:
    factors, types, n = 0.0, set(), 0
    for w in words:
        types.add(w)
        n += 1
        if n >= least and len(types) / n < limit:
            factors, types, n = factors + 1, set(), 0
    if n:
        factors += (1 - len(types) / n) / (1 - limit)
    return len(words) / factors if factors else float(len(words))


def expected_ratios(words: list[str], sizes: np.ndarray) -> np.ndarray:
    """Expected type-token ratios of samples of some sizes without replacement: a type of c tokens is missing from a sample of s of n
    tokens with the product of (n - c - i) / (n - i) over i < s."""
    n, counts = len(words), np.unique(words, return_counts=True)[1].astype(np.float64)
    out = np.empty(len(sizes))
    for k, size in enumerate(sizes):
        steps = np.arange(int(size), dtype=np.float64)
        out[k] = (1 - np.prod(np.clip(n - counts[:, None] - steps, 0, None) / (n - steps), axis=1)).sum() / size
    return out


def _vocd(words: list[str]) -> float | None:
    """The D whose curve lies nearest to the expected type-token ratios of samples of 35 to 50 words."""
    if len(words) < 50:
        return None
    sizes = np.arange(35, 51, dtype=np.float64)
    ratios = expected_ratios(words, sizes)
    low, high = -3.0, 9.0
    for _ in range(40):
        grid = np.linspace(low, high, 9)
        d = np.exp(grid)[:, None]
        best = int((((d / sizes) * (np.sqrt(1 + 2 * sizes / d) - 1) - ratios) ** 2).sum(1).argmin())
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, 8)]
    return float(np.exp((low + high) / 2))


def ordered_diversity(tokens: DataFrame) -> DataFrame:
    """MTLD, the mean of both directions, and VOCD with the expectation of its samples in place of random ones. The words of a document are gathered in a
    worker: sentence rows lie together in the order of the document as they are, token rows are brought there by a shuffle."""
    if "toks" in tokens.columns:
        words = tokens.select("doc_id", F.expr("transform(filter(toks, t -> NOT t.is_punct), t -> lower(t.text))").alias("ws"), (F.col("n") == 1).alias("first"))
    else:
        words = tokens.where(~F.col("is_punct")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para", "sent", "pos", F.lower("text").alias("text")))).alias("t"))
        words = words.select("doc_id", F.transform("t", lambda x: x["text"]).alias("ws"), F.lit(True).alias("first"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, found = None, []
        for batch in batches:
            for doc, ws, first in zip(batch.column("doc_id").to_pylist(), batch.column("ws").to_pylist(), batch.column("first").to_pylist(), strict=True):
                if first:
                    if found:
                        yield held, found
                    held, found = doc, []
                found += ws
        if found:
            yield held, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = documents(batches)
        while some := list(islice(((doc, (_mtld(ws) + _mtld(ws[::-1])) / 2, _vocd(ws)) for doc, ws in rows), 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], ["doc_id", "LDMTLDa", "LDVOCDa"])

    kinds = [to_arrow_type(tokens.schema["doc_id"].dataType), pa.float64(), pa.float64()]
    return rows_of(words.mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, LDMTLDa double, LDVOCDa double"), ["LDMTLDa", "LDVOCDa"])


def second_language(found: DataFrame, label: str = "RDL2_synstruta", syntax: str = "SYNSTRUTa") -> DataFrame:
    """The second-language readability of rows that hold CRFCWO1, a syntax similarity and WRDFRQmc_wiki10000; null if one is."""
    of = lambda k: F.max(F.when(F.col("label") == k, F.col("value")))
    wide = found.groupBy("doc_id").agg((-45.032 + 52.230 * of("CRFCWO1") + 61.306 * of(syntax) + 22.205 * of("WRDFRQmc_wiki10000")).alias(label))
    return rows_of(wide, [label])
