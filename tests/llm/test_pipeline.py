"""run() against the five stages done by brute force, one after another."""

import random

import pytest
from tokenizers import Tokenizer

from tidelog.llm import toxicity

from .test_classifiers import corpus
from .test_dedup import brute_similar
from .test_filters import brute_leaks, words
from .test_tokens_and_packing import check_packing


def cut_text(rows, width=50):
    first, out = {}, []
    raw = [(k, t.encode()) for k, t in rows]
    for k, b in raw:
        for i in range(len(b) - width + 1):
            first[b[i : i + width]] = min(first.get(b[i : i + width], k), k)
    for k, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < k:
                gone[i : i + width] = b"\1" * width
        out.append((k, bytes(c for c, x in zip(b, gone, strict=True) if not x).decode("utf-8", "ignore")))
    return out


def make():
    docs, labels = corpus(420, seed=9)
    rng = random.Random(8)
    items = [(i, " ".join(f"item{rng.randint(0, 30)}" for _ in range(rng.randint(8, 20)))) for i in range(6)]
    passage = "this passage stands in a good many documents of the collection and has to go from all but the first of them"
    out = []
    for k, t in docs:
        if k % 10 == 1:
            t = t + " " + rng.choice(items)[1]
        if k % 10 == 3:
            t = t + " " + passage
        if k % 10 == 5 and k > 100:
            t = docs[k - 100][1] + (" more" if k % 20 == 5 else "")
        out.append((k, t))
    return out + [(5000, ""), (5001, None), (5002, "x " * 6000)], labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    docs, labels, items = make()
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{where}/benchmark.parquet")
    return where


def test_pipeline_equals_brute_force(spark, folder, vocabulary):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, _, items = make()
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    model = toxicity.fitted(read("documents"), read("labels"))
    rows = [(k, t) for k, t in docs if model.score(t or "") < 0.5]
    assert 200 < len(rows) < len(docs)
    least = {}
    for (k, _), c in zip(rows, groups := brute_similar(rows), strict=True):
        least[c] = min(least.get(c, k), k)
    assert len(least) < len(rows) - 15
    rows = [(k, t) for (k, t), c in zip(rows, groups, strict=True) if least[c] == k]
    rows = cut_text([(k, t or "") for k, t in rows])
    leaks = {k for k, _ in brute_leaks(rows, items)}
    assert leaks
    rows = [(k, t) for k, t in rows if k not in leaks]
    got = pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == {k for k, _ in rows}
    t = Tokenizer.from_file(vocabulary["vocabulary"])
    check_packing(got, {k: t.encode(x, add_special_tokens=False).ids + [0] for k, x in rows}, 2048)
    assert all(words(i[1]) for i in items)


def test_stages_keep_the_columns(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
