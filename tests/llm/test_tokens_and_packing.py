import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import packing, token_scan, tokens

from .conftest import CASES


@pytest.fixture(scope="module")
def exact(vocabulary):
    t = Tokenizer.from_file(vocabulary["vocabulary"])
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(vocabulary, exact):
    rng = random.Random(4)
    parts = ["word", "Word's", " ", "  ", "\n", " \n", "\t", "\u00a0", "3.14", "!!", "é", "漢字", "\u2003", "\x1c", "", "😀", "<|endoftext|>", "a\r\nb", "don't", "_x"]
    encoder = tokens.Encoder(**vocabulary, most=50)
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == exact(text), repr(text)


def test_token_counts(edge, vocabulary, exact, monkeypatch):
    monkeypatch.setattr(token_scan, "SPAN", 2)
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_scan.token_counts(edge.filter("text is null or not contains(text, '<|')"), vocabulary).collect())
    assert got == sorted((k or -1, len(exact(t or ""))) for k, t in CASES if "<|" not in (t or ""))


def test_token_counts_of_texts_that_spell_the_separator(spark, edge, vocabulary, exact):
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_scan.token_counts(edge, vocabulary).collect())
    assert got == sorted((k or -1, len(exact(t or ""))) for k, t in CASES)
    rows = [(i, "<|endoftext|>" * (i % 3) + " word" * i) for i in range(20)]
    one = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # a single stream: a count too many would shift all later ones
    assert {r["doc_id"]: r["n_tokens"] for r in token_scan.token_counts(one, vocabulary).collect()} == {k: len(exact(t)) for k, t in rows}
    with pytest.raises(Exception, match="encodes to the separator"):
        token_scan.token_counts(one, vocabulary, eod=token_scan.EOD).count()


def brute_scan(ids, eod):
    out, n, start = [], 0, 0
    for i, t in enumerate(ids):
        if t == eod:
            out.append((start, n, True))
            n, start = 0, i + 1
        else:
            n += 1
    return out + ([(start, n, False)] if n else [])


@pytest.mark.parametrize("block", [1, 3, 64])
def test_scan_stitches_blocks(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(token_scan, "SPAN", 3)
    rng, want = np.random.default_rng(block), {}
    (tmp_path / "flat").mkdir()
    for i, (n, share) in enumerate([(0, 0.5), (200, 0.0), (200, 1.0), (333, 0.1), (100, 0.4)]):
        ids = np.where(rng.random(n) < share, 9, rng.integers(0, 9, n)).astype("<u2")
        (tmp_path / "flat" / f"{i}.bin").write_bytes(ids.tobytes())
        want[i] = brute_scan(ids.tolist(), 9)
    flat = token_scan.read_flat(spark, str(tmp_path / "flat"), block_tokens=block)
    got = {i: [] for i in want}
    for r in token_scan.scan_blocks(flat, eod=9).orderBy("ordinal").collect():
        got[int(r["stream"].split("/")[-1][0])].append((r["start"], r["n_tokens"], r["closed"]))
    assert got == want


def check_packing(rows, bodies, capacity):
    by_seq, by_row = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_row.setdefault(r["doc_id"], []).append(r)
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    for key, ids in bodies.items():
        pieces = sorted(by_row[key], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert all(p["length"] == capacity for p in pieces[1:]) and sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(part)


def test_packing(edge, vocabulary, exact):
    rows = packing.pack_documents(edge, vocabulary, group=5).collect()
    assert sum(r["doc_id"] == 2 for r in rows) == 3
    check_packing(rows, {k: exact(t or "") + [0] for k, t in CASES if k != 2}, 2048)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in packing.pack_documents(edge, vocabulary).collect()}) == -(-total // 2048)


def test_every_capacity_binds(spark, small, vocabulary):
    from tidelog.llm import queries

    rows = queries.op10_best_fit_packing(spark, small).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    cap = packing.ATTENTION * 2048**2
    assert all(sum(x) <= 2048 and len(x) <= packing.DOCUMENTS and (len(x) == 1 or sum(n * n for n in x) <= cap) for x in by.values())
    assert len(by) <= 1.05 * sum(map(sum, by.values())) / 2048 + 1
    words = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(300)] + [(1000 + i, "long word " * 900) for i in range(5)], "doc_id long, text string")
    for max_docs, attention, bound in ((64, 0.98, 64), (10, 0.98, 10), (64, 0.5, 64)):
        own = {}
        for r in packing.pack_documents(words, vocabulary, max_docs=max_docs, attention=attention).collect():
            own.setdefault(r["sequence_id"], []).append(r["length"])
        assert max(map(len, own.values())) == bound  # the documents are small enough to fill any number of places
        assert all(len(x) == 1 or sum(n * n for n in x) <= attention * 2048**2 for x in own.values())
        assert any(len(x) == 1 and x[0] ** 2 > attention * 2048**2 for x in own.values()) == (attention == 0.5)


def test_packing_keeps_ids(edge, vocabulary, exact):
    rows = packing.pack_documents(edge.filter("doc_id = 11"), vocabulary, keep_ids=True).collect()
    assert rows[0]["ids"] == exact(CASES[6][1]) + [0]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 500)
    bins = packing.best_fit(lengths, 100, 4, 5000.0, rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert len(own) == 1 or (own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 5000)
    loose = packing.best_fit(lengths, 100, 100, 1e9, rule)
    assert loose.max() + 1 <= 1.05 * np.ceil(lengths.sum() / 100) + 1


def test_empty(none, vocabulary):
    assert packing.pack_documents(none, vocabulary).count() == 0
    assert token_scan.token_counts(none, vocabulary).count() == 0
    assert none.select(F.lit(1)).count() == 0
