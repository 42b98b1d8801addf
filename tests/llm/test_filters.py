import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, url_filter


def words(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def brute_leaks(docs, items, k=5, cut=0.8):
    best = {}
    for key, text in docs:
        w = words(text)
        for item, body in items:
            v = words(body)
            n = len(v)
            q = min(k, n)
            if not n:
                continue
            want = Counter(tuple(v[i : i + q]) for i in range(n - q + 1))
            for s in range(max(len(w) - n + 1, 1)):
                x = w[s : s + n]
                have = Counter(tuple(x[i : i + q]) for i in range(len(x) - q + 1))
                shared = sum((have & want).values())
                sim = shared / (sum(want.values()) + sum(have.values()) - shared)
                if sim >= cut:
                    best[key, item] = max(best.get((key, item), (0, 0)), (round(sim, 6), -s))
    return best


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "x " * 20)]
    docs = []
    for i in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if i % 2:
            leak = words(rng.choice(items)[1])
            for _ in range(rng.randint(0, 2)):
                if leak:
                    leak[rng.randrange(len(leak))] = "changed"
            t[len(t) // 2 : len(t) // 2] = [x.upper() + "," for x in leak]
        docs.append((i, " ".join(t)))
    return docs + [(100, "x " * 500), (101, None), (102, ""), (100, "y")], items


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_brute_force(spark, seed):
    docs, items = make(seed)
    d = spark.createDataFrame([(k, t, 1, 1) for k, t in docs], "doc_id long, text string, item_id int, h int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["hamming"]) for r in decontaminate.find_leaks(d, b).collect()}
    want = brute_leaks(docs, items)
    assert set(got) == set(want) and all(got[k][0] == want[k][0] for k in want)
    rows = lambda keep: sorted((k, t or "") for k, t in docs if keep(k, t))
    leaking = {t for _, t in docs if brute_leaks([(0, t)], items)}
    assert sorted((r["doc_id"], r["text"] or "") for r in decontaminate.drop_leaks(d, b).collect()) == rows(lambda k, t: t not in leaking)


def test_leaks_in_documents_shorter_than_the_item(spark):
    item = [f"v{i}" for i in range(40)]
    docs = [(1, item[:-1]), (2, item[1:-1]), (3, item[:33]), (4, item[:32]), (5, item[:20] + ["changed"] + item[21:39]), (6, ["x"] * 18), (7, ["x"] * 16), (8, item[:4]), (9, []), (10, [*item[3:], "more"]), (11, item)]
    items = [(1, " ".join(item)), (2, "x " * 20)]
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in docs] + [(12, " ".join(item[:-2])), (12, "of the same id " * 30)], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], r["similarity"]) for r in decontaminate.find_leaks(d, b).collect()}
    want = {}
    for key, w in [*docs, (12, item[:-2])]:
        for i, body in items:
            have, of = (Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4)) for x in (w, words(body)))
            shared = sum((have & of).values())
            if shared and (similarity := shared / (sum(have.values()) + sum(of.values()) - shared)) >= 0.8:
                want[key, i] = (0, len(w), round(similarity, 6))
    assert got == want and {k for k, _ in want} == {1, 2, 3, 6, 10, 11, 12}
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(d, b).collect()) == [4, 5, 7, 8, 9, 12]


def test_leaks_of_empty_tables(spark, none, edge):
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(edge, b).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.find_leaks(none, some).count() == 0 and decontaminate.drop_leaks(none, some).count() == 0


def test_leaks_in_edge_cases(spark, edge):
    b = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs"), (2, "with some words of its own that nobody else")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(edge, b).collect()}
    assert got == {(3, 1), (5, 1), (9, 1), (None, 2)}
    assert None not in {r["doc_id"] for r in decontaminate.drop_leaks(edge, b).collect()}


def test_items_of_one_id_and_short_items(spark):
    b = spark.createDataFrame([(1, "one two three four five six seven eight"), (1, "other words under the same id as before them"), (2, "tiny item"), (3, "solo")], "item_id long, text string")
    docs = [(1, "x one two three four five six seven eight y"), (2, "Other words under the same id, as before them"), (3, "a tiny item here"), (4, "tiny other item"), (5, "solo"), (None, "nothing of it"), (None, "solo again")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in decontaminate.find_leaks(d, b).collect()}
    assert got == {(1, 1, 1, 1.0), (2, 1, 0, 1.0), (3, 2, 1, 1.0), (5, 3, 0, 1.0), (None, 3, 0, 1.0)}
    assert sorted(r["text"] for r in decontaminate.drop_leaks(d, b).collect()) == ["nothing of it", "tiny other item"]


def test_windows_of_usual_size_are_found_and_few_others_verified(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([40, 60])))) for i in range(30)]
    docs = []
    for i in range(300):
        v = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            v[rng.randrange(len(v))] = word()
        docs.append((i, " ".join([word() for _ in range(30)] + v + [word() for _ in range(30)])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(d, b).collect()}
    assert len(want) > 150 and set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(got[p] == want[p][0] for p in got)


def test_multi_index_guarantees_the_radius(spark):
    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for i in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), i % 40):
            b ^= 1 << bit
        rows.append((signed(a), signed(b), i % 40))
    one = F.explode(decontaminate._blocks(F.col("a"), decontaminate.BLOCKS))
    near = F.array_contains(decontaminate._blocks(F.col("b"), decontaminate.BLOCKS, decontaminate.RADIUS // decontaminate.BLOCKS), F.col("block"))
    df = spark.createDataFrame(rows, "a long, b long, apart int").withColumn("block", one).groupBy("a", "apart").agg(F.max(near).alias("meet")).collect()
    assert len(df) == 400 and all(r["meet"] for r in df if r["apart"] <= decontaminate.RADIUS)
    assert sum(r["meet"] for r in df if r["apart"] >= 30) < 60


URLS = [
    (1, "https://A.example.ORG/es/x"), (2, "http://example.org/en/12?q#f"), (3, "http://x.org"), (4, "http://x.org/"), (5, "https://b.com/fr/1"), (6, "https://b.com/de/1"),
    (7, "https://dcom/fr/1"), (8, None), (9, "no scheme"), (10, "a://b://c/d"), (10, "a://b://c/d"), (None, "http://c.net/de/1"), (11, ""), (12, "http://É.COM/fr/É"), (13, "http://" + "y" * 5000 + ".net/")
]


def test_url_rules_and_sql(spark):
    extra = [(100 + i, f"http://h{i % 7}.{'com/fr' if i % 2 else 'com/de'}/{i}") for i in range(60)] + [(200 + i, f"http://h{i}.net/{'fr' if i % 2 else 'de'}/{i}") for i in range(20)]
    rows = URLS + extra
    df = spark.createDataFrame([(k, u, 0, "x") for k, u in rows], "page_id long, url string, place int, gram string")
    got = url_filter.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert [(by[i]["host"], by[i]["path"], by[i]["rule"]) for i in (1, 2, 3, 4, 8, 10)] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("x.org", "", None), ("x.org", "/", "org/"), ("", "", None), ("b:", "//c/d", None)
    ]
    assert by[201]["verdict"] == "allow" and by[200]["verdict"] == "block"
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    want = con.execute(url_filter.judge_sql()).df()[["page_id", "host", "path", "rule", "verdict"]]
    plain = lambda rs: sorted(repr(["" if x is None or x != x else str(x).removesuffix(".0") for x in r]) for r in rs)
    assert plain(map(tuple, got)) == plain(want.astype(object).where(want.notna(), None).itertuples(index=False, name=None))


def test_urls_of_nothing(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def naive_ratio(fit, order, alphabet, text):
    """Witten-Bell by recursion, for one class."""
    counts = Counter()
    for t in fit:
        s = url_filter.START * order + t + url_filter.END
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i], s[i]] += 1
    total, kinds = Counter(), Counter()
    for (c, _), n in counts.items():
        total[c] += n
        kinds[c] += 1

    def p(c, x):
        below = p(c[1:], x) if c else 1 / alphabet
        return (counts[c, x] + kinds[c] * below) / (total[c] + kinds[c]) if total[c] else below

    s = url_filter.START * order + text + url_filter.END
    return [p(s[i - order : i], s[i]) for i in range(order, len(s))]


def test_url_scores_equal_recursion(spark):
    import math

    rows = [(i + 1 if (i + 1) % 5 else i + 500001, f"http://s{i % 9}.com/{'fr' if i % 3 else 'de'}/{i}") for i in range(40)] + [(1001, "http://t.net/fr/x"), (1002, "http://t.net/de/x")]
    got = {r["page_id"]: r["score"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    body = lambda u: u.split("://")[1]
    side = {w: [body(u) for k, u in rows[:40] if (f"/{w}/" in u) and k % 5] for w in ("fr", "de")}
    for k, u in rows[40:]:
        a, b = (naive_ratio(side[w], url_filter.ORDER, url_filter.ALPHABET, body(u)) for w in ("fr", "de"))
        assert got[k] == pytest.approx(sum(math.log(x) - math.log(y) for x, y in zip(a, b, strict=True)) / len(a), abs=1e-8)
