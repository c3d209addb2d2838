"""Evaluation: shares with intervals, precision and recall, detection scores, noise, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a share in per cent, rounded to whole numbers; [0, 100] for n = 0."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    lo = F.when(n == 0, 0.0).otherwise(F.round(100 * F.greatest(mid - half, F.lit(0.0)), 0))
    hi = F.when(n == 0, 100.0).otherwise(F.round(100 * F.least(mid + half, F.lit(1.0)), 0))
    return lo.alias("lo"), hi.alias("hi")


def shares(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """by, k, n, share, lo, hi."""
    out = df.groupBy(*by).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    return out.select(*by, "k", "n", F.round(F.col("k") / F.col("n"), 6).alias("share"), *wilson(F.col("k"), F.col("n")))


def prf(df: DataFrame, by: list[str], gold: str, found: str) -> DataFrame:
    """by, tp, fp, fn, tn, p, r, f from counts per item: tp = min(gold, found)."""
    g, t = F.col(gold), F.col(found)
    out = df.groupBy(*by).agg(
        F.sum(F.least(g, t)).alias("tp"), F.sum(F.greatest(t - g, F.lit(0))).alias("fp"), F.sum(F.greatest(g - t, F.lit(0))).alias("fn"), F.count_if((g == 0) & (t == 0)).alias("tn")
    )
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.select(*by, "tp", "fp", "fn", "tn", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f"))


def detection(items: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Each item (key, item, a, b, pid) with covered, iou, first_right: a finding (key, ts, te, pid)
    detects it when it covers half of it or more; the best is that of the greatest overlap."""
    j = items.join(found, key, "left")
    f = j.select(items["*"], F.col("ts"), F.col("te"), found["pid"].alias("fpid")) if "pid" in items.columns else j
    inter = F.greatest(F.least("b", "te") - F.greatest("a", "ts"), F.lit(0))
    f = f.withColumn("inter", F.coalesce(inter, F.lit(0)))
    union = F.greatest("b", "te") - F.least("a", "ts")
    return f.groupBy(key, "item", "a", "b", "pid").agg(
        (F.max("inter") * 2 >= F.max(F.col("b") - F.col("a"))).alias("covered"),
        F.round(F.max(F.coalesce(F.col("inter") / union, F.lit(0.0))), 6).alias("iou"),
        F.max_by(F.coalesce(F.col("fpid") == F.col("pid"), F.lit(False)), F.struct("inter", -F.col("fpid"))).alias("first_right"),
    )


def noisy(tokens: DataFrame, key: str, seed: int, drop: float, swap: float) -> DataFrame:
    """tokens (key, pos, tok) with a deterministic noise: dropped words, and words with one letter
    changed. What happens to a word depends on a hash of (seed, key, pos) only."""
    u = F.pmod(F.xxhash64(F.lit(seed), key, "pos"), F.lit(10_000)) / 10_000.0
    at = (F.pmod(F.xxhash64(F.lit(seed + 1), key, "pos"), F.greatest(F.length("tok"), F.lit(1)).cast("long")) + 1).cast("int")
    changed = F.concat(F.substring("tok", F.lit(1), at - 1), F.lit("x"), F.substring("tok", at + 1, F.length("tok")))
    return tokens.filter(u >= drop).withColumn("tok", F.when(u < drop + swap, changed).otherwise(F.col("tok")))


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """by, value: the order statistic at floor(share * (n - 1)), from counts per value."""
    from pyspark.sql import Window

    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    part = Window.partitionBy(*by)
    upto = F.sum("_n").over(part.orderBy(value))
    out = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(part)).filter(F.col("_upto") > F.floor(F.lit(share) * (F.col("_all") - 1)))
    return out.groupBy(*by).agg(F.min(value).alias(value))


def mode_first(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by, value: the most frequent value, the first seen if tied."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))
