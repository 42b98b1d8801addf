"""URL verdicts: path rules first, then the likelihood ratio of two character models, in DataFrame functions only.

URLs that a rule allows or blocks are the accepted and rejected samples. For each of the two classes, a Markov model of orders
0 to `order` is smoothed by Witten-Bell interpolation: where a context has been seen often with few continuations it decides, else shorter ones do. A URL's
score is the mean difference of its characters' log-likelihoods; the threshold is calibrated on labelled URLs that the models
did not see.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, durable, let

#: (verdict, host/path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ORDER = 3
#: Size of the alphabet that the shortest context falls back to.
ALPHABET = 256
#: Marks outside any text's likely characters: before the first character and after the last.
START, END = "\x02", "\x03"
FOLDS = 5


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule = verdict = None
    for what, prefix in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = prefix.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, prefix) if rule is None else rule.when(fits, prefix)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _grams(text: Column, order: int) -> Column:
    """Every character with the `order` characters before it, the end mark last."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    return let(padded, lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - order), lambda i: F.substring(p, i, F.lit(order + 1))))


def gram_ratios(grams: DataFrame, order: int = ORDER, alphabet: int = ALPHABET) -> DataFrame:
    """(gram, ratio) from (gram, accepted, rejected) counts: ln of the last character's probability in the accepted model less that in the rejected one."""
    below = None
    for k in range(order + 1):
        level = grams.groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
        level = level.withColumn("context", F.expr("left(gram, char_length(gram) - 1)"))
        ctx = Window.partitionBy("context")
        if below is None:
            level = level.withColumns({"p_accepted": F.lit(1.0 / alphabet), "p_rejected": F.lit(1.0 / alphabet)})
        else:
            level = level.withColumn("shorter", F.expr(f"right(gram, {k})")).join(below.withColumnRenamed("gram", "shorter"), "shorter")
        smoothed = {}
        for c in ("accepted", "rejected"):
            types = F.sum((F.col(c) > 0).cast("int")).over(ctx)
            total = F.sum(c).over(ctx) + types
            smoothed[f"p_{c}"] = F.when(total > 0, (F.col(c) + types * F.col(f"p_{c}")) / total).otherwise(F.col(f"p_{c}"))
        below = level.select("gram", *(e.alias(n) for n, e in smoothed.items()))
    return below.select("gram", (F.ln("p_accepted") - F.ln("p_rejected")).alias("ratio"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row.

    score is the length-normalised ratio (higher: more like accepted URLs), null where a rule decides. Labelled URLs whose key mod 5 is 0 only calibrate:
    the threshold, a multiple of 0.01, has the largest true-allow less false-allow rate (ties: the lowest) and stands halfway to the next lower score. Without such URLs of
    both classes it is 0. Null URL: empty host and path, judged by the model. Null or repeated keys: a row each; null keys count as 0 in folds.
    Empty table: empty result.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    held = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(FOLDS)) == 0
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("body"), held.alias("held"))
    rows = durable(rows.withColumn("place", F.monotonically_increasing_id()), "urls")

    fit = lambda what: F.sum(((F.col("ruled") == what) & ~F.col("held")).cast("int"))
    bodies = rows.groupBy("body").agg(F.coalesce(fit("allow"), F.lit(0)).alias("accepted"), F.coalesce(fit("block"), F.lit(0)).alias("rejected"))
    grams = bodies.select(F.explode(_grams(F.col("body"), order)).alias("gram"), "accepted", "rejected")
    grams = durable(grams.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-grams")
    ratios = durable(gram_ratios(grams, order), "url-ratios")

    judged = rows.filter(F.col("ruled").isNull() | F.col("held"))
    cells = judged.select("place", F.explode(_grams(F.col("body"), order)).alias("gram")).join(broadcast_if_small(ratios), "gram")
    scores = cells.groupBy("place").agg(F.round(F.avg("ratio"), 9).alias("score"))
    scored = durable(judged.join(scores, "place"), "url-scores")
    step = F.floor(F.col("score") * 100)
    bins = scored.filter(F.col("ruled").isNotNull()).groupBy(step.alias("at")).agg(F.sum((F.col("ruled") == "allow").cast("int")).alias("a"), F.sum((F.col("ruled") == "block").cast("int")).alias("b"))
    above, every = Window.orderBy(F.col("at").desc()), Window.partitionBy()
    gain = F.sum("a").over(above) / F.sum("a").over(every) - F.sum("b").over(above) / F.sum("b").over(every)
    best = bins.filter("at is not null").withColumn("both", (F.sum("a").over(every) > 0) & (F.sum("b").over(every) > 0))
    middle = F.ceil((F.col("at") + F.coalesce(F.lag("at").over(Window.orderBy("at")), F.col("at"))) / 2)
    best = best.withColumn("middle", middle).filter("both").select("at", "middle", F.round(gain, 9).alias("gain")).orderBy(F.col("gain").desc(), "at").first()
    at = best["middle"] if best else 0
    open_ = scored.filter(F.col("ruled").isNull()).withColumn("verdict", F.when(step >= at, "allow").otherwise("block"))
    cols = ["page_id", "host", "path", "rule", "verdict", "score"]
    ruled = rows.filter(F.col("ruled").isNotNull()).withColumns({"verdict": F.col("ruled"), "score": F.lit(None).cast("double")})
    return ruled.select(*cols).unionByName(open_.select(*cols))


def judge_sql(rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER, alphabet: int = ALPHABET) -> str:
    """judge() in DuckDB SQL over `pages`, without the score."""
    fits = lambda p: f"(host = '{p.partition('/')[0]}' OR ends_with(host, '.{p.partition('/')[0]}')) AND starts_with(path, '/{p.partition('/')[2]}')"
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    case = lambda out: "CASE " + " ".join(f"WHEN {fits(p)} THEN '{out(v, p)}'" for v, p in ranked) + " END"
    levels, last = [], None
    for k in range(order + 1):
        prior = f"{1.0 / alphabet!r}::DOUBLE" if last is None else None
        pa, pr = (prior, prior) if prior else ("s.p_a", "s.p_r")
        join = "" if last is None else f" JOIN m{k - 1} s ON s.gram = right(g.gram, {k})"
        smooth = lambda c, p: f"CASE WHEN sum(g.{c}) OVER w + sum((g.{c} > 0)::int) OVER w > 0 THEN (g.{c} + (sum((g.{c} > 0)::int) OVER w) * {p}) / (sum(g.{c}) OVER w + sum((g.{c} > 0)::int) OVER w)::DOUBLE ELSE {p} END"
        levels.append(f"g{k} AS (SELECT right(gram, {k + 1}) AS gram, sum(a) AS a, sum(r) AS r FROM grams GROUP BY 1)")
        levels.append(f"m{k} AS (SELECT g.gram, {smooth('a', pa)} AS p_a, {smooth('r', pr)} AS p_r FROM g{k} g{join} WINDOW w AS (PARTITION BY g.gram[1:length(g.gram) - 1]))")
        last = k
    return f"""WITH cut AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {case(lambda v, p: p)} AS rule, {case(lambda v, p: v)} AS ruled, host || path AS body, coalesce(page_id, 0) % {FOLDS} = 0 AS held, row_number() OVER () AS place FROM cut),
cells AS (SELECT place, ruled, held, unnest(list_transform(range(1, length(body) + 2), lambda i: substring(repeat(chr(2), {order}) || body || chr(3), i, {order + 1}))) AS gram FROM ruled),
grams AS (SELECT gram, sum((coalesce(ruled, '') = 'allow' AND NOT held)::int) AS a, sum((coalesce(ruled, '') = 'block' AND NOT held)::int) AS r FROM cells GROUP BY gram),
{', '.join(levels)},
scores AS (SELECT place, round(avg(ln(p_a) - ln(p_r)), 9) AS score FROM cells JOIN m{order} USING (gram) GROUP BY place),
bins AS (SELECT floor(score * 100) AS bin_, sum((ruled = 'allow')::int) AS a, sum((ruled = 'block')::int) AS b FROM ruled JOIN scores USING (place) WHERE held AND ruled IS NOT NULL GROUP BY 1),
gains AS (SELECT bin_, ceil((bin_ + coalesce(lag(bin_) OVER (ORDER BY bin_), bin_)) / 2.0) AS middle, round(sum(a) OVER up / sum(a) OVER () - sum(b) OVER up / sum(b) OVER (), 9) AS gain, sum(a) OVER () > 0 AND sum(b) OVER () > 0 AS both_ FROM bins WINDOW up AS (ORDER BY bin_ DESC)),
best AS (SELECT coalesce((SELECT middle FROM gains WHERE both_ ORDER BY gain DESC, bin_ LIMIT 1), 0) AS bin_)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN floor(score * 100) >= (SELECT bin_ FROM best) THEN 'allow' ELSE 'block' END) AS verdict FROM ruled JOIN scores USING (place)"""
