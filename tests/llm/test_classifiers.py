import random

import numpy as np
import pytest

from tidelog.llm import quality, toxicity

from .conftest import CASES

GOOD = ["river", "stone", "window", "garden", "letter", "music", "paper", "winter", "market", "silver"]
BAD = ["vileword", "nastyterm", "slurrish", "hatefulx", "grimthing"]


def corpus(n=900, seed=3):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice(GOOD) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randint(20, 120))]
        toxic, junk = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        if junk:
            words = [w.upper() + "!!" for w in words] if i % 2 else [words[0]] * len(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, column, cut", [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_held_out_accuracy(tables, module, column, cut):
    docs, labels = tables
    rows = module.classify(docs, labels).collect()
    want = {r["doc_id"]: r[column] for r in labels.filter(f"{column} is not null and doc_id is not null").collect()}
    held = [r for r in rows if r["held_out"]]
    assert 100 < len(held) < 300 and len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for r in rows)
    # Words repeated into junk lose their toxic words, so only clean-cut documents count for toxicity.
    held = [r for r in held if module is quality or r["doc_id"] % 3]
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) > 0.9


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edge_cases(tables, edge, none, module):
    _, labels = tables
    for docs in (edge, edge.filter("doc_id = 7")):
        assert module.classify(docs, labels).count() == docs.count()
    assert module.classify(none, labels).count() == 0
    assert module.classify(edge, labels.limit(0)).count() == len(CASES)
    assert not module.classify(edge, labels).filter("doc_id is null and held_out").count()


def test_drop_toxic_keeps_rows_and_columns(tables, edge):
    docs, labels = tables
    model = toxicity.fitted(docs, labels)
    kept = toxicity.drop_toxic(edge, labels, model=model)
    assert kept.columns == edge.columns and kept.count() == len(CASES)
    clean = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels, model=model).collect()}
    assert len([k for k in range(900) if k % 4 and k % 3 and k not in clean]) < 10


def test_scores_use_the_text_alone(tables):
    docs, labels = tables
    model = toxicity.fitted(docs, labels)
    assert model.score("river stone vileword nastyterm hatefulx") > model.score("river stone window garden letter")


def test_context_table_is_a_sum(spark):
    texts = ["a b c", "b c", "", "c"]
    total = np.zeros(quality.TOKENS * quality.DIM)
    quality.add_contexts(total, texts)
    again = quality.context_table(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(3))
    assert np.allclose(again, quality.unit(total.reshape(quality.TOKENS, quality.DIM)))


def test_long_texts_are_taken_in_slices(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(GOOD) for _ in range(n)) for n in (1, 2, 7, 8, 9, 30, 31)]
    table = np.random.default_rng(1).normal(size=(quality.TOKENS, quality.DIM)).astype(np.float32)

    def both():
        total = np.zeros(quality.TOKENS * quality.DIM)
        quality.add_contexts(total, texts)
        return total, np.array([quality.pooled(t, table) for t in texts])

    whole, sliced = both(), (monkeypatch.setattr(quality, "TOGETHER", 4), both())[1]
    assert np.array_equal(whole[0], sliced[0]) and np.allclose(whole[1], sliced[1], atol=1e-5)


def naive_contexts(texts):
    places, signs = quality.index_vectors()
    out = np.zeros((quality.TOKENS, quality.DIM))
    for t in texts:
        ids = [(quality._TOKENS[w] // quality.FORMS, quality.WORDS + quality._TOKENS[w] % quality.FORMS) for w in (t or "").split()]
        for i, own in enumerate(ids):
            for j in (i - 1, i + 1):
                if 0 <= j < len(ids):
                    for a in own:
                        for b in ids[j]:
                            for k in range(quality.NONZERO):
                                out[a, places[b, k]] += signs[b, k]
    return out


def test_context_table_equals_a_loop(spark):
    texts = ["The river, the STONE 12", "stone river", "", None, "a b a b a"]
    got = quality.context_table(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    assert np.allclose(got, quality.unit(naive_contexts(texts)), atol=1e-6)


def test_quality_score_equals_a_loop(tables):
    import math

    docs, labels = tables
    texts = [r["text"] for r in docs.collect()]
    contexts = quality.unit(naive_contexts(texts)).astype(float)
    some, marks, _ = quality.samples.labelled(docs, labels, "quality", by_class=False)
    net = quality.train(quality.context_table(docs), some, marks)
    places, signs = quality.index_vectors()
    w1, b1, w2, b2 = (x.tolist() for x in net.layers)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    for key, text in corpus()[0][:6]:
        ids = [(quality._TOKENS[w] // quality.FORMS, quality.WORDS + quality._TOKENS[w] % quality.FORMS) for w in text.split()]
        n, x = len(ids), []
        for side in (0, 1):
            x += [sum(contexts[i[side]][d] for i in ids) / n for d in range(quality.DIM)]
        for side in (0, 1):
            flat = [0.0] * quality.DIM
            for i in ids:
                for k in range(quality.NONZERO):
                    flat[places[i[side], k]] += signs[i[side], k] / n
            x.append(math.sqrt(sum(v * v for v in flat)))
        x += [sum(a[0] == b[0] for a, b in zip(ids, ids[1:], strict=False)) / (n - 1), math.log1p(n) / 8, len({i[0] for i in ids}) / n]
        x = [(v - m) / s for v, m, s in zip(x, net.mean.tolist(), net.scale.tolist(), strict=True)]
        hidden = [math.tanh(sum(v * w1[i][j] for i, v in enumerate(x)) + b1[j]) for j in range(quality.HIDDEN)]
        z = sum(h * w2[j][0] for j, h in enumerate(hidden)) + b2[0]
        assert got[key] == pytest.approx(1 / (1 + math.exp(-z / net.temperature)), abs=1e-4)


def test_toxicity_score_equals_a_loop(tables):
    import math

    import zstandard as z

    docs, labels = tables
    model = toxicity.fitted(docs, labels)
    keys = toxicity._keys(model.widen)
    size = lambda raw, d: len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), level=model.level, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw))
    ratios = np.frombuffer(model.ratios, np.float32)
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    for key, text in corpus()[0][:6]:
        total, words = 0.0, text.lower().split()
        for w in words:
            raw = bytes(table[c] for c in f" {w.strip(toxicity.STRIP)} ".encode() for table in keys)
            cell = [min(size(raw, d) * toxicity.CELLS // (9 * model.widen + 20), toxicity.CELLS - 1) for d in (model.ordinary, model.toxic)]
            total += max(float(ratios[cell[0] * toxicity.CELLS + cell[1]]) - toxicity.FLOOR, 0)
        x = 1.0, math.log1p(total), total / math.sqrt(len(words) + 20.0)
        assert got[key] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, x, strict=True)))), abs=1e-4)


def test_windows_of_long_runs():
    for n in (1, 64, 65, 96, 97, 500):
        body = "".join(chr(97 + i * 7 % 26) for i in range(n))
        cut = toxicity.windows(body)
        assert all(len(w) <= toxicity.WIDEST for w in cut) and cut[0] == body[: len(cut[0])] and body.endswith(cut[-1])
        assert all(any(body[i : i + 32] in w for w in cut) for i in range(max(1, n - 31)))


def test_sample_ranks_what_is_short_enough(spark):
    docs = spark.createDataFrame([(i, "x" * (50 if i % 2 else 5)) for i in range(1, 60)] + [(2, "another text")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 60)], "doc_id long, toxic int")
    texts, marks, totals = quality.samples.labelled(docs, labels, "toxic", rows=10, longest=20)
    assert len(texts) == 10 == len(marks) and max(map(len, texts)) <= 20 and sum(totals.values()) > 20
