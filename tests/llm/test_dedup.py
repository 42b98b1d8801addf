import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tidelog.llm import graph, simhash_trie, substring_dedup
from tidelog.llm.suffix_array import suffix_array, window_classes

from .conftest import CASES


def brute_print(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "").encode()
    words = lower.split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows, radius=2):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k or -1, f"{p:016x}", least.get(find(i)) or -1) for i, ((k, _), p) in enumerate(zip(rows, prints, strict=True)))


def near_rows(seed=1):
    rng, rows = random.Random(seed), []
    for i in range(150):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 60)) for _ in range(rng.randint(0, 120))]
        if rows and rng.random() < 0.5:
            words = (rows[rng.randrange(len(rows))][1] or "").split()
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = "Edited"
        rows.append((i * 7 + 1, " ".join(words)))
    return rows


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash_trie, "SUBTREE", 4)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_trie.near_duplicates(df).collect())
    assert got == brute_components(rows)


def brute_similar(rows, similarity=0.8, k=5):
    """Component of each row by links of an exact similarity between all pairs."""
    def bag(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        return Counter([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []))

    bags, root = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            if bags[i] == bags[j] or shared >= similarity * (sum(bags[i].values()) + sum(bags[j].values()) - shared):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def brute_keep_one(rows):
    """The (id, text) that stay: of each component the smallest id, nulls last, then the text of the smallest hash; unordered texts of one id both count."""
    groups = {}
    for (k, t), c in zip(rows, brute_similar(rows), strict=True):
        groups.setdefault(c, set()).add((k is None, k or 0, t or ""))
    return [{(k, t) for none, k, t in g if (none, k) == min(g)[:2]} for g in groups.values()]


def edited(n=240, seed=4):
    """Texts with copies of which one to ten in a hundred words are others, and some in which far more are."""
    rng, rows = random.Random(seed), []
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 400))
    for i in range(n):
        if rows and i % 3:
            words = rng.choice(rows)[1].split()
            share = rng.choice([0.005, 0.01, 0.02, 0.3])
            words = [word() if rng.random() < share else w for w in words]
        else:
            words = [word() for _ in range(rng.randint(60, 300))]
        rows.append((i * 7 + 1, " ".join(words)))
    return rows


def test_similar_texts_against_all_pairs(spark):
    rows = edited()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component"] for r in simhash_trie.similar(df).collect()}
    want = dict(zip((k for k, _ in rows), brute_similar(rows), strict=True))
    pairs = lambda of: {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    found, true = pairs(got), pairs(want)
    assert found <= true and len(found) >= 0.95 * len(true) > 100
    kept = {r["doc_id"] for r in simhash_trie.keep_one(df).collect()}
    least = {}
    for k, c in got.items():
        least[c] = min(least.get(c, k), k)
    assert kept == set(least.values())


def barely(n=150, seed=11):
    """Pairs just above and just below the similarity, pairs of repeated shingles, and a crowd that shares most of its words, of which some are linked."""
    rng, rows = random.Random(seed), []
    word = lambda: "w" + str(rng.randint(0, 100_000))
    for i in range(n):
        words = [word() for _ in range(rng.randint(70, 200))]
        rows.append(words)
        edits = (len(words) - 4) // 45 + (i % 5 == 4)  # each takes five shingles of both sides: a ninth of them may go
        places = {6 + k * (len(words) // edits) for k in range(edits)}
        rows.append([word() if k in places else w for k, w in enumerate(words)])
    rows += [["a", "b"] * k for k in range(20, 90, 9)] + [[word() for _ in range(k)] for k in range(1, 7)]
    frame = [word() for _ in range(150)]
    for _ in range(40):
        one = [w if k % 30 else word() for k, w in enumerate(frame)]
        rows += [one, [w if k % 60 != 7 else word() for k, w in enumerate(one)]]
    return [(i * 3 + 2, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("few", [False, True])
def test_similar_loses_no_link(spark, monkeypatch, few):
    if few:  # tries that propose next to nothing, in one forest, and an order and pairs in small pieces
        for name, value in {"FORESTS": 1, "BUDGET": 0, "APART": 60, "KNOWN": 50, "MET": 4096, "MEETINGS": 64}.items():
            monkeypatch.setattr(simhash_trie, name, value)
    rows = barely()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component"] for r in simhash_trie.similar(df).collect()}
    want = dict(zip((k for k, _ in rows), brute_similar(rows), strict=True))
    same = lambda of: {frozenset(k for k in of if of[k] == c) for c in set(of.values())}
    assert 100 < len(same(want)) < len(rows) - 100
    assert same(got) == same(want)


def test_passages_propose_no_pairs(spark, monkeypatch):
    """A passage that no task sees twice is as common as one that a task sees often: texts don't meet by it."""
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randint(0, 1_000_000))
    passage, rest, proposed = [word() for _ in range(60)], simhash_trie._rest, []
    rows = [(i, " ".join([*(word() for _ in range(100)), *passage])) for i in range(24)]
    rows.append((100, rows[3][1] + " more"))
    monkeypatch.setattr(simhash_trie, "_rest", lambda *a: proposed.append(rest(*a).count()) or rest(*a))
    got = {r["doc_id"]: r["component"] for r in simhash_trie.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(24)).collect()}
    assert len(set(got.values())) == 24 and got[3] == got[100]
    assert proposed == [0]


def test_counts_of_all_shingles(spark, monkeypatch):
    monkeypatch.setattr(simhash_trie, "COUNTED", 500)
    rows = edited(120)
    count = Counter(int(e) >> 32 for t in {t for _, t in rows} for e in simhash_trie._elements(simhash_trie._hashed(t)[1]))
    often = {e: n for e, n in count.items() if n >= simhash_trie.OFTEN}
    source = spark.createDataFrame(rows, "doc_id long, text string").dropDuplicates(["text"]).repartition(7)
    known, counts = simhash_trie._common(source)
    assert dict(zip(known.tolist(), counts.tolist(), strict=True)) == often and known.tolist() == sorted(often)
    monkeypatch.setattr(simhash_trie, "KNOWN", len(often) // 2)
    known, counts = simhash_trie._common(source)
    assert {e: n for e, n in often.items() if n >= 16} == dict(zip(known.tolist(), counts.tolist(), strict=True)) or 0 < len(known) <= len(often) // 2
    for values in ([], [7], [0, 0, 65535, 65535], [5, 65541, (1 << 32) - 1]):
        assert simhash_trie._ungapped(simhash_trie._gaps(np.array(values, np.uint32))).tolist() == values


@pytest.mark.parametrize("links", [1 << 20, 40])
def test_trees_of_several_tasks(spark, monkeypatch, links):
    monkeypatch.setattr(simhash_trie, "LINKS", links)
    edges = [(i, i + 1) for i in range(0, 200)] + [(-1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in simhash_trie._trees(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: -1000 for i in range(1001, 1100)}


def test_keep_one_keeps_other_texts_of_an_id(spark):
    texts = {n: " ".join(f"{n}{i}" for i in range(60)) for n in "abcde"}
    rows = [(1, texts["a"], 0), (5, texts["a"], 1), (5, texts["b"], 2), (7, texts["c"], 3), (7, texts["d"], 4), (7, texts["d"], 5), (None, texts["b"], 6), (None, texts["e"], 7), (None, None, 8), (9, "", 9)]
    kept = simhash_trie.keep_one(spark.createDataFrame(rows, "doc_id long, text string, rid int").repartition(4))
    got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    assert got == sorted([(1, texts["a"]), (5, texts["b"]), (7, texts["c"]), (7, texts["d"]), (0, texts["e"]), (9, "")])
    assert kept.columns == ["doc_id", "text", "rid"]


def test_hot_prefixes_are_cut_further(spark, monkeypatch):
    monkeypatch.setattr(simhash_trie, "SUBTREE", 8)
    rng = random.Random(5)
    base = [rng.getrandbits(40) for _ in range(120)]
    fps = sorted({b ^ (1 << rng.randrange(64) if rng.random() < 0.3 else 0) ^ (1 << rng.randrange(40) if rng.random() < 0.5 else 0) for b in base for _ in range(3)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in graph.components(simhash_trie.trie_links(prints, 8, 64, 2, 8)).collect()}
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    same = lambda of: {frozenset(x for x in of if of[x] == r) for r in set(of.values())}
    assert same({f: got.get(signed(f), signed(f)) for f in fps}) == same({f: find(f) for f in fps})


def test_near_duplicates_edge_cases(edge, none):
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"] if r["component_id"] is not None else -1) for r in simhash_trie.near_duplicates(edge).collect())
    assert got == brute_components(CASES)
    kept = simhash_trie.keep_one(edge)
    assert kept.columns == edge.columns or set(kept.columns) == set(edge.columns)
    got, want = {(r["doc_id"] or 0, r["text"] or "") for r in kept.collect()}, brute_keep_one(CASES)
    assert kept.count() == len(want) == len(got) and all(len(got & g) == 1 for g in want)
    assert simhash_trie.near_duplicates(none).count() == 0 and simhash_trie.keep_one(none).count() == 0


def test_walk_finds_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
    x = np.unique(np.concatenate([base, base[:150] ^ flip(), base[:150] ^ flip() ^ flip(), base[:150] ^ flip() ^ flip() ^ flip()]))
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 2}
    assert {p for i, j in simhash_trie.walk(x, x, 64, 2, True) for p in zip(i.tolist(), j.tolist(), strict=True)} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1100)}


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(s, int)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_window_classes():
    rng = random.Random(4)
    for _ in range(100):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        seen = {}
        for t, c in zip(texts, window_classes(texts, 4), strict=True):
            for i, k in enumerate(c.tolist()):
                assert seen.setdefault(t[i : i + 4], k) == k
        assert len(set(seen.values())) == len(seen)


def brute_cut(rows, width=50):
    first, out = {}, []
    rows = [(k if k is not None else 1 << 62, (t or "").encode()) for k, t in rows]
    for k, b in rows:
        for i in range(len(b) - width + 1):
            first[b[i : i + width]] = min(first.get(b[i : i + width], k), k)
    for k, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < k:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        spans = sum(x and (i == 0 or not gone[i - 1]) for i, x in enumerate(gone))
        out.append((k if k < 1 << 62 else -1, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed):
    rng, rows = random.Random(seed), []
    words = ["alpha", "béta", "gamma", "delta", "x", "y."]
    texts = [" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(30)) for _ in range(6)]
    for i in range(120):
        t = " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(rng.randint(0, 80)))
        if i % 3 == 0:
            p, a = rng.choice(texts), rng.randint(0, 60)
            t = t[: len(t) // 2] + p[a : a + rng.randint(40, 150)] + t[len(t) // 2 :]
        if i % 7 == 0 and rows:
            t = rng.choice(rows)[1]
        if i % 11 == 0 and rows:
            t = rng.choice(rows)[1].replace("a", "b", 2)
        if i % 17 == 0:
            t = "ha " * rng.randint(1, 60)
        rows.append((i * 3, t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [5, 6])
def test_repeats_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 4000)
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, substring_dedup.digests(df).collect())) == brute_cut(rows)


@pytest.mark.parametrize("hot", [2, 4])
def test_repeats_of_hot_minimizers(spark, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(hot)
    core = "a phrase of the collection that stands in nearly every text of it"
    rows = passages(7) + [(5000 + i, f"{rng.choice('xyz') * rng.randint(0, 40)} {core[rng.randint(0, 9):]} {rng.choice('uvw') * rng.randint(0, 40)}{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, substring_dedup.digests(df).collect())) == brute_cut(rows)


def test_large_groups_are_split():
    rng = random.Random(1)
    gram, width = b"0123456789abcdefghijklmn", 50
    lefts, rights = ([bytes(rng.choice(a) for _ in range(22)) for _ in range(5)] for a in (b"xy", b"uv"))
    strings = [rng.choice(lefts)[rng.randint(0, 10) :] + gram + rng.choice(rights)[: rng.randint(8, 22)] for _ in range(150)]
    strings = [b for b in strings if len(b) >= width]
    value = substring_dedup._short(substring_dedup.gram_hashes(np.frombuffer(gram, np.uint8))).view(np.int64)[0]
    n = len(strings)
    args = np.arange(n), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, value), strings, width, 24
    covered = lambda found: {(i, k) for i, _, a, z in found for k in range(a, z)}
    whole, split = (covered(substring_dedup._resolve(*args, together=t)) for t in (1 << 30, 60))
    first, want = {}, set()
    for i, b in enumerate(strings):
        for a in range(len(b) - width + 1):
            if first.setdefault(b[a : a + width], i) < i:
                want |= {(i, k) for k in range(a, a + width)}
    assert want and whole == split == want


def test_repeats_edge_cases(edge, none):
    got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, substring_dedup.digests(edge).collect()))
    assert got == brute_cut(CASES)
    assert substring_dedup.digests(none).count() == 0 and substring_dedup.cut_repeats(none).count() == 0


def test_cut_texts(edge):
    out = substring_dedup.cut_repeats(edge).select(*edge.columns)
    assert out.count() == len(CASES)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[5] == "" and texts[3] == CASES[1][1]
