"""Named merge operators: how the operands of a key, oldest first, and its base value fold into one value.

An operator is a function (operands, base, base_seq) -> Column over a grouped frame whose rows are one key's operands (columns seq, value) with the key's
base repeated on each. Associative ones are plain aggregates and combine before the shuffle; list-like ones collect (seq, value) pairs of one key, a list
that the result holds anyway.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Merge:
    """fold(value, seq, base): an aggregate over operand rows; `value` is null on a row that stands for a key without operands."""

    name: str
    fold: Callable[[Column, Column, Column], Column]


def _in_order(value: Column, seq: Column) -> Column:
    """Operands from oldest to newest, nulls left out."""
    pairs = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(seq.alias("s"), value.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def _sum(value: Column, seq: Column, base: Column) -> Column:
    return F.coalesce(F.first(base), F.lit(0)) + F.coalesce(F.sum(value), F.lit(0))


def _wrapping_sum(value: Column, seq: Column, base: Column) -> Column:
    big = lambda c: F.coalesce(c.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return F.pmod(big(F.first(base)) + big(F.sum(value.cast("decimal(28,0)"))), F.lit(str(1 << 64)).cast("decimal(38,0)"))


def _append(delimiter: str) -> Callable[[Column, Column, Column], Column]:
    def fold(value: Column, seq: Column, base: Column) -> Column:
        first = F.first(base)
        parts = _in_order(value.cast("string"), seq)
        # An empty base still gets the delimiter; only a missing one does not.
        return F.array_join(F.when(first.isNotNull(), F.concat(F.array(first.cast("string")), parts)).otherwise(parts), delimiter)

    return fold


def _sorted_list(value: Column, seq: Column, base: Column) -> Column:
    """Comma-separated integer lists merged in order, duplicates kept; the base is ignored."""
    numbers = F.flatten(F.collect_list(F.split(value.cast("string"), ",").cast("array<bigint>")))
    return F.array_join(F.sort_array(numbers).cast("array<string>"), ",")


REGISTRY: dict[str, Merge] = {
    m.name: m
    for m in (
        Merge("uint64add", _wrapping_sum),
        Merge("sum", _sum),
        Merge("max", lambda v, s, b: F.greatest(F.first(b), F.max(v))),
        Merge("put", lambda v, s, b: F.coalesce(F.max_by(v, F.when(v.isNotNull(), s)), F.first(b))),
        Merge("bytesxor", lambda v, s, b: F.coalesce(F.first(b), F.lit(0).cast("long")).bitwiseXOR(F.coalesce(F.bit_xor(v), F.lit(0).cast("long")))),
        Merge("stringappend", _append(",")),
        Merge("stringappendtest", _append(",")),
        Merge("sortlist", _sorted_list),
        Merge("mul", lambda v, s, b: F.aggregate(_in_order(v, s), F.coalesce(F.first(b), F.lit(1)).cast("long"), lambda a, x: a * x)),
        Merge("last3", lambda v, s, b: F.slice(F.flatten(F.reverse(_in_order(v, s))), 1, 3)),
    )
}
REGISTRY["put_v1"] = Merge("put_v1", REGISTRY["put"].fold)


def register(name: str, fold: Callable[[Column, Column, Column], Column]) -> Merge:
    REGISTRY[name] = Merge(name, fold)
    return REGISTRY[name]


def named(merge: str | Merge | None) -> Merge:
    if merge is None:
        raise ValueError("the log has merge operands, but no merge operator was given")
    if isinstance(merge, Merge):
        return merge
    if merge not in REGISTRY:
        raise ValueError(f"no merge operator named {merge!r}")
    return REGISTRY[merge]


def xor_bytes(a: bytes | None, b: bytes | None) -> bytes:
    """XOR over the common prefix; the rest of the longer operand stays."""
    a, b = a or b"", b or b""
    n = min(len(a), len(b))
    return bytes(x ^ y for x, y in zip(a[:n], b[:n], strict=True)) + (a[n:] if len(a) > n else b[n:])


def custom(operands: DataFrame, fold: Callable[[list, object], object], schema: str, keys: tuple[str, ...] = ("cf", "user_key")) -> DataFrame:
    """Any Python fold(operands oldest first, base) by key, for operators that no expression can say. Rows: keys, seq, value, base."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq", kind="stable")
        return pd.DataFrame([[*frame.iloc[0][list(keys)], fold(frame["value"].tolist(), frame["base"].iloc[0])]])

    return operands.groupBy(*keys).applyInPandas(lambda f: run(f).set_axis([x.split()[0] for x in schema.split(",")], axis=1), schema)


def bytes_xor(operands: DataFrame, keys: tuple[str, ...] = ("user_key",)) -> DataFrame:
    """(keys.., value) of binary operands (value) of any lengths; a base counts as one of them. XOR over the common prefix with the rest of the longer one kept is, place by
    place, the XOR of all that have the place: four bytes at a time, combined before the shuffle."""
    digits = F.hex("value")
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("value") / 4) - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.rpad(F.substring(digits, i * 8 + 1, F.lit(8)), 8, "0"), 16, 10).cast("long"))
    cells = operands.filter("value is not null").select(*keys, F.octet_length("value").alias("n"), F.posexplode(words).alias("at", "w"))
    each = cells.groupBy(*keys, "at").agg(F.bit_xor(F.coalesce("w", F.lit(0).cast("long"))).alias("w"), F.max("n").alias("n"))
    whole = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("l"), F.max("n").alias("n"))
    text = F.array_join(F.transform("l", lambda x: F.lpad(F.hex(x["w"]), 8, "0")), "")
    return whole.select(*keys, F.unhex(F.substring(text, F.lit(1), F.col("n") * 2)).alias("value"))


# ------------------------------------------------------------------ named functions that change in mid-stream

#: What a key folds to if one of its functions is not known.
ERROR = "kErrorFuncName"
_AGGREGATES = {
    "sum": lambda items: sum(int(x) for x in items),
    "mul": lambda items: __import__("math").prod(int(x) for x in items),
    "last3": lambda items: [e for x in reversed(items) for e in x][:3],
}


def fold_named(ops: list[tuple[str, object]], functions: dict[str, Callable[[list], object]] | None = None) -> tuple[str, object]:
    """(function, value) of operands (function, value) from oldest to newest.

    A run of one function is folded when another one follows, and its result is that run's first item. Empty names before the first
    name take it; an empty name after it, or an unknown one anywhere, gives the error name and the list of all operands. Without any name, likewise."""
    functions = functions or _AGGREGATES
    name, run = "", []
    for f, v in ops:
        if f and not name:
            name = f
        elif name and f != name:
            if name not in functions:
                return ERROR, [v for _, v in ops]
            name, run = f, [functions[name](run)]
            if not name:
                return ERROR, [v for _, v in ops]
        run.append(v)
    if name not in functions:
        return ERROR, [v for _, v in ops]
    return name, functions[name](run)


def segments_of(ops: DataFrame, key: str = "user_key", func: str = "func") -> DataFrame:
    """Adds run_func and segment, the number of the run of one function that each operand belongs to; blanks before a key's first name take it."""
    w = Window.partitionBy(key).orderBy("seq")
    name = F.when(F.col(func) != "", F.col(func))
    leading = F.count(name).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0
    first = F.first(name, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    ops = ops.withColumn("run_func", F.when(leading, F.coalesce(first, F.lit(""))).otherwise(F.col(func)))
    change = (F.col("run_func") != F.lag("run_func", 1, "").over(w)).cast("int")
    return ops.withColumn("change_", change).withColumn("segment", F.sum("change_").over(w)).drop("change_")


#: How the runs of a named function fold (over the run's items), and how a run's result goes on with the earlier one as its first item.
NUMERIC = {"sum": (F.sum, lambda a, x: a + x), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def fold_segments(ops: DataFrame, key: str = "user_key", func: str = "func", value: str = "value") -> DataFrame:
    """(key, func, value, n_items) of operands whose function may change in mid-stream: fold_named() for functions of numbers.

    Runs of one function are aggregated, which combines before the shuffle; then the runs of a key, as few as its changes, are folded in order, each result
    the first item of the next run. A key with an unknown function, or a blank one after its first name, gets the error name, no value and the number of its operands."""
    runs = segments_of(ops, key, func)
    each = runs.groupBy(key, "segment").agg(F.first("run_func").alias("f"), F.count("*").alias("n"), *[NUMERIC[n][0](value).alias(n) for n in NUMERIC], F.max_by(value, "seq").alias("last"))
    each = each.withColumn("v", F.coalesce(*[F.when(F.col("f") == n, F.col(n)) for n in NUMERIC], F.col("last")))
    whole = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("segment", "f", "v"))).alias("l"), F.sum("n").alias("n_items"), F.max((~F.col("f").isin(*NUMERIC)).cast("int")).alias("bad"))

    def step(a, x):
        out = x["v"]
        for n, (_, join) in NUMERIC.items():
            out = F.when(a.isNotNull() & (x["f"] == n), join(a, x["v"])).otherwise(out)
        return out

    total = F.aggregate("l", F.lit(None).cast(dict(each.dtypes)["v"]), step)
    return whole.select(key, F.when(F.col("bad") == 1, ERROR).otherwise(F.element_at("l", -1)["f"]).alias("func"), F.when(F.col("bad") == 0, total).alias("value"), "n_items")
