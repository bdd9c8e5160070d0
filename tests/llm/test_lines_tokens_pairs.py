"""Line dedup, token counts, packing and SimHash against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from spanweave.llm import line_dedup, near_dedup, packing, simhash, token_counts
from spanweave.llm.support import Workspace, components
from spanweave.llm.tokens import PartEncoder, tokenizer_path

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def brute_lines(rows):
    owner, holders = {}, defaultdict(set)
    rank = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(SPACE).translate(LOWER)
            if len(k) >= 10:
                holders[k].add(rank(i))
    owner = {k: min(v) for k, v in holders.items()}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(x.strip(SPACE).translate(LOWER), rank(i)) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(spark, nasty, as_tables):
    folder = as_tables(documents=nasty)
    got = Counter(tuple(r) for r in line_dedup.op1_line_dedup(spark, folder).collect())
    assert got == brute_lines(texts_of(nasty))
    assert any(n for (_, _, n, _) in got)


def test_line_dedup_levels_agree(spark, nasty):
    want = None
    for batches, fanout in ((1, 2), (7, 2), (9, 3)):
        out = line_dedup.dedup_lines(spark, nasty, batches=batches, fanout=fanout)
        assert out.columns == [*nasty.columns, "line_dedup"]
        got = Counter((r.doc_id, r.text, r.id) for r in out.collect())
        want = want or got
        assert got == want


def test_empty_tables(spark, nasty, as_tables):
    folder = as_tables(documents=nasty.limit(0))
    for query in (line_dedup.op1_line_dedup, token_counts.op3_token_counts, packing.op4_packing, simhash.op5_simhash):
        assert query(spark, folder).collect() == []


def reference_tokenizer(ordinary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = ordinary
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(nasty):
    for ordinary in (False, True):
        whole, own = reference_tokenizer(ordinary), PartEncoder(tokenizer_path(), ordinary)
        for _, text in texts_of(nasty):
            assert own.encode(text)[0].tolist() == whole(text)


def test_packing(spark, nasty, as_tables):
    folder = as_tables(documents=nasty)
    rows = packing.op4_packing(spark, folder).collect()
    whole, want = reference_tokenizer(False), Counter()
    for i, t in texts_of(nasty):
        want[i, tuple([*whole(t), 1])] += 1
    total = {i: sum(len(ids) * n for (j, ids), n in want.items() if j == i) for i, _ in want}
    assert {i: sum(r.length for r in rows if r.doc_id == i) for i in total} == total
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    once = {i: ids for (i, ids), n in want.items() if n == 1 and sum(1 for j, _ in want if j == i) == 1}
    for r in rows:
        if r.doc_id in once:
            ids = once[r.doc_id]
            assert r.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def brute_best(at, pen, size):
    best = [0.0]
    for j in range(1, len(at)):
        best.append(min(best[i] + (0 if (n := at[j] - at[i]) & (n - 1) == 0 and n >= size // 8 else size - n) for i in range(j) if at[j] - at[i] <= size) + pen[j])
    return best[-1]


def test_packing_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        ends = np.unique(np.append(rng.integers(1, 900, 12), 900))
        at, pen = packing.candidates(ends, rng.integers(1, 900, 30), 900)
        cuts = packing.best_cuts(at, pen, 64)
        price = dict(zip(at.tolist(), pen.tolist(), strict=True))
        cost = sum((0 if (n := b - a) & (n - 1) == 0 and n >= 8 else 64 - n) + price[b] for a, b in zip(cuts, cuts[1:], strict=False))
        assert cuts[0] == 0 and cuts[-1] == 900 and max(np.diff(cuts)) <= 64
        assert abs(cost - brute_best(at.tolist(), pen.tolist(), 64)) < 1e-9


def test_packing_blocks_keep_every_id(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 5000)
    rng, packer, docs, got = np.random.default_rng(1), packing.Packer(256, 0), [], []
    for i in range(200):
        ids = rng.integers(2, 99, rng.integers(1, 900)).astype(np.uint32)
        docs.append(ids)
        got += [x for b in packer.add(i, ids, np.arange(20, len(ids), 20)) for x in zip(*b.values(), strict=True)]
    got += [x for b in packer.close() for x in zip(*b.values(), strict=True)]
    for i, ids in enumerate(docs):
        mine = sorted((s, d) for n, s, d, *_ in got if n == i)
        assert b"".join(d for _, d in mine) == ids.astype("<u4").tobytes()
        assert [s for s, _ in mine] == [sum(len(d) // 4 for _, d in mine[:k]) for k in range(len(mine))]
    used = Counter()
    for _, _, d, _, s, _ in got:
        used[s] += len(d) // 4
    waste = sum(0 if n & (n - 1) == 0 else 256 - n for n in used.values())
    assert waste < 0.1 * sum(used.values()) and sorted(used) == list(range(len(used)))


def test_token_counts(spark, nasty, as_tables, monkeypatch):
    whole = reference_tokenizer(True)
    want = Counter((i, len(whole(t))) for i, t in texts_of(nasty))
    assert Counter(tuple(r) for r in token_counts.op3_token_counts(spark, as_tables(documents=nasty)).collect()) == want


def test_scan_stitches_any_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP_BLOCKS", 4)
    rng = np.random.default_rng(2)
    want = []
    for f in range(3):
        lengths = rng.integers(0, 40, 30).tolist() + [2000, 0, 3]
        ids = np.concatenate([np.append(rng.integers(1, 50, n), 0) for n in lengths] + [np.arange(1, 1 + 5 * f)]).astype("<u2")
        (tmp_path / f"{f}.bin").write_bytes(ids.tobytes())
        want += [(n, True) for n in lengths] + [(5 * f, False)] * (f > 0)
    got = token_counts.count_tokens(token_counts.read_token_files(spark, str(tmp_path), 64), 0).collect()
    assert Counter((r.n_tokens, r.closed) for r in got) == Counter(want)


def test_ids_of_a_large_vocabulary_stay_whole(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {f"w{i}": i for i in range(70_000)}
    t = Tokenizer(models.WordLevel(words, unk_token="w0"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "t.json")
    t.save(path)
    assert token_counts.id_type(path, 5) == "<u4" and token_counts.id_type(tokenizer_path(), 49407) == "<u2"
    assert token_counts.id_type(tokenizer_path(), 70_000) == "<u4"


def test_line_dedup_passes_clashing_columns_through(spark):
    docs = spark.createDataFrame([(1, "a line of some length\nb", 7, "x"), (2, "A line of some length", 8, "y")], "doc_id bigint, text string, line_dedup int, doc string")
    out = line_dedup.dedup_lines(spark, docs)
    assert out.columns == [*docs.columns, "line_dedup_"]
    assert sorted(tuple(r)[:4] for r in out.collect()) == [(1, "a line of some length\nb", 7, "x"), (2, "", 8, "y")]


def brute_simhash(rows):
    prints = []
    for i, t in rows:
        w = (t or "").encode().translate(bytes.maketrans(LOWER_FROM, LOWER_TO)).split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    label = list(range(len(rows)))
    for _ in rows:
        new = [min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {g: min((rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None), default=None) for g in label}
    return Counter((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, label, strict=True))


LOWER_FROM, LOWER_TO = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def test_simhash(spark, nasty, as_tables):
    got = Counter(tuple(r) for r in simhash.op5_simhash(spark, as_tables(documents=nasty)).collect())
    assert got == brute_simhash(texts_of(nasty))


def test_near_links_find_every_component(spark):
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    for base in fps[:20]:
        for _ in range(4):
            x = base & (2**64 - 1)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.append(x - 2**64 if x >= 2**63 else x)
    fps = sorted(set(fps))
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    table = spark.createDataFrame([(f, [f]) for f in fps], "node bigint, fp array<bigint>")
    got = {(r.a, r.b) for r in simhash.near_links(Workspace(spark, "t"), table, 1, 2, 3).collect()}
    assert got <= want and least_reached(fps, got) == least_reached(fps, want)


def least_reached(nodes, links):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = np.random.default_rng(6)
    links = [(i, i + 1) for i in range(60)] + [(100, int(x)) for x in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (120, 2))] + [(7, 7)]
    label = {n: n for e in links for n in e}
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.component for r in components(Workspace(spark, "t"), spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    alone = {n for n in label if all(n not in e or e[0] == e[1] for e in links)}
    assert found == {n: c for n, c in label.items() if n not in alone}


def test_near_copies_of_a_large_group(spark):
    """Copies of one text at similarities around the limit, and texts that share only a passage, against all pairs."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        found = [f"x{i}-{k}" if rng.random() < rate else w for k, w in enumerate(base)] if (rate := [0.0, 0.008, 0.015, 0.04][i % 4]) else [*base, f"y{i}"]
        rows.append((i, " ".join(found)))
    rows += [(100 + i, " ".join([f"z{i}-{k}" for k in range(40)] + base[:60])) for i in range(20)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.id: r.component for r in near_dedup.near_duplicate_groups(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == least_reached(sorted(sets), want)


def test_near_duplicate_groups(spark):
    words = [f"w{i}" for i in range(600)]
    near = words.copy()
    near[300] = "other"
    far = [w if i % 5 else "x" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words)), (5, ""), (6, None)]
    got = {r.id: r.component for r in near_dedup.near_duplicate_groups(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 3: 3, 5: 5, 6: 5}


def groups_of(spark, rows):
    return {r.id: r.component for r in near_dedup.near_duplicate_groups(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_near_copies_with_repeated_passages(spark):
    """Near copies as shingle sets, one of which repeats a passage many times."""
    rows = []
    for i in range(20):
        words = [f"w{i}-{k}" for k in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:60] * 8, *words[60:], "end"]))]
    assert groups_of(spark, rows) == {i: i - i % 2 for i in range(40)}


def test_near_copies_at_the_limit(spark):
    rows = []
    for i in range(150):
        words = [f"w{i}-{k}" for k in range(400)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:357], *[f"x{i}-{k}" for k in range(43)]]))]  # 353 of 439 shingles shared
    got = groups_of(spark, rows)
    assert sum(got[2 * i + 1] == 2 * i for i in range(150)) >= 135  # expected 0.95


def test_short_near_copies_are_all_found(spark):
    """Every pair of short sets at similarity 0.8 or just above: 4 of 5 shingles up to 24 of 30, against all pairs."""
    rows, at = [], 0
    for n in range(8, 29):
        for _ in range(12):
            words = [f"w{at}-{k}" for k in range(n)]
            rows += [(at, " ".join(words)), (at + 1, " ".join([*words, *[f"x{at}-{k}" for k in range((n - 4) // 4)]]))]
            at += 2
    got = groups_of(spark, rows)
    assert all(got[i] == i - i % 2 for i in range(at))


def test_two_large_groups_of_one_passage(spark, monkeypatch):
    """Members of two groups meet under nearly all keys; one pair links the groups, so the pairs that the first run leaves out are needed."""
    monkeypatch.setattr(near_dedup, "SOME", 2)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(200)]
    far = [*base[:172], *[f"v{k}" for k in range(28)]]  # 0.75 of base
    rows = []
    for i in range(80):
        words = (base if i < 40 else far).copy()
        words[rng.integers(0, 170)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows.append((80, " ".join([*base[:186], *far[186:]])))  # about 0.85 of either
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert groups_of(spark, rows) == least_reached(sorted(sets), want)


def test_pairs_left_out_are_marked():
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(50, np.int64)), pa.array(np.arange(50)), pa.array(np.where(np.arange(50) < 40, 0, 40))], ["key", "node", "comp"])
    (cut,) = near_dedup.key_pairs(iter([batch]), 3)
    assert cut.num_rows == 3 and all(cut.column("cut").to_pylist())
    every = pa.Table.from_batches(near_dedup.key_pairs(iter([batch.slice(0, 20), batch.slice(20)]), None))
    assert every.num_rows == 400 and not any(every.column("cut").to_pylist())


def test_variants_meet_once(spark):
    """Pairs of equal sizes within the radius of which a segment differs by at most one bit, against all pairs."""
    rng = np.random.default_rng(12)
    fps = rng.integers(0, 2**63, (30, 5)).astype(np.uint64)
    fps = np.concatenate([fps, *[fps ^ np.packbits(rng.random((30, 320)) < rate, axis=1).view("<u8") for rate in (0.01, 0.1, 0.14, 0.18)]])
    rows = [(i, fp.view(np.int64).tolist(), 100, None if i % 3 else i) for i, fp in enumerate(fps)]
    whole = [int.from_bytes(fp.tobytes(), "little") for fp in fps]
    want = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x = whole[a] ^ whole[b]
            if x.bit_count() <= simhash.radius_of(0.8, 320) and any((x >> low & (1 << 20) - 1).bit_count() <= 1 for low in range(0, 320, 20)):
                want.add((a, b))
    got = [(r.a, r.b) for r in near_dedup.met_under_variants(spark.createDataFrame(rows, "node bigint, fp array<bigint>, n bigint, comp bigint"), 5, 0.8, None).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_rows_of_one_id_are_documents_of_their_own(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words), "a"), (1, "quite another text of seven words", "b"), (2, " ".join(words), "c"), (2, "a third text that nobody else has", "d"), (3, " ".join(words[1:]), "e"), (None, " ".join(words), "f"), (4, " ".join(words), "g"), (4, " ".join(words), "g")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, same string").withColumnsRenamed({"same": "same_set"})
    kept = near_dedup.without_near_duplicates(spark, docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(r.same_set for r in kept.collect()) == ["a", "b", "d", "f"]
    assert near_dedup.without_near_duplicates(spark, docs.limit(0)).collect() == []


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint", lambda hashes, n_words=1: [0] * n_words)
    texts = [" ".join(f"w{i}-{k}" for k in range(40)) for i in range(6)]
    rows = [*enumerate(texts), (6, texts[2]), (7, texts[3] + " end")]
    assert groups_of(spark, rows) == {i: {6: 2, 7: 3}.get(i, i) for i in range(8)}


def test_every_sentence_end_is_a_candidate():
    at, penalty = packing.candidates(np.array([100]), np.array([3, 7, 9, 40, 41]), 100)
    assert at[penalty == packing.SENTENCE].tolist() == [3, 7, 9, 40, 41]


def test_simhash_sends_no_table_whole(spark, nasty, monkeypatch):
    """Tables that grow with the input are dealt over the tasks, small as they are here."""
    plans, write = [], Workspace.write
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: (plan(df), write(self, df, name))[1])
    plan(simhash.simhash_components(spark, nasty))
    assert sum("Join" in p for p in plans) > 3
    assert not [p for p in plans if "Broadcast" in p]
