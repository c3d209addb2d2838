"""Joins and folds over positions and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_pairs(a: DataFrame, b: DataFrame, key: str, size: float, more: Column | None = None) -> DataFrame:
    """Rows of a and b (columns id, s, e each) of one key whose ranges [s, e) overlap.

    Each range is put into the buckets of `size` that it meets, so that the join is an equi-join;
    a pair is given out in the bucket of its later start only, once.
    """
    slots = lambda p: F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1e-9) / size)))
    left = a.filter("e > s").withColumn("slot", slots("a")).select(key, "slot", *[F.col(c).alias(f"{c}_a") for c in ("id", "s", "e")])
    right = b.filter("e > s").withColumn("slot", slots("b")).select(key, "slot", *[F.col(c).alias(f"{c}_b") for c in ("id", "s", "e")])
    both = left.join(right, [key, "slot"]).filter((F.col("s_a") < F.col("e_b")) & (F.col("s_b") < F.col("e_a")))
    return both.filter(F.floor(F.greatest("s_a", "s_b") / size) == F.col("slot")).drop("slot")


def overlap_share(s1: str, e1: str, s2: str, e2: str) -> Column:
    """Overlap over the shorter range."""
    inter = F.least(e1, e2) - F.greatest(s1, s2)
    return inter / F.least(F.col(e1) - F.col(s1), F.col(e2) - F.col(s2))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str, most: float | None = None, after: bool = False) -> DataFrame:
    """Each left row with the last right row at or before it (or the first at or after it).

    Both sides become one ordered stream per key and a running last value; no pair is ever formed.
    """
    l2 = left.withColumn("_side", F.lit(1 if not after else 0)).withColumn("_v", F.lit(None).cast("struct<t:double,v:string>"))
    cols = left.columns
    r2 = right.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols]
                      , F.lit(0 if not after else 1).alias("_side"), F.struct(F.col(at).cast("double").alias("t"), F.col(value).cast("string").alias("v")).alias("_v"))
    by = Window.partitionBy(key).orderBy(at, "_side")
    if after:
        found = F.first("_v", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    else:
        found = F.last("_v", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = l2.unionByName(r2).withColumn("_f", found).filter(F.col("_side") == (1 if not after else 0))
    gap = F.abs(F.col(at).cast("double") - F.col("_f.t"))
    ok = F.col("_f").isNotNull() if most is None else F.col("_f").isNotNull() & (gap <= most)
    return out.select(*cols, F.when(ok, F.col("_f.v")).alias(f"{value}_found"), F.when(ok, F.round(gap, 6)).alias("gap"))


def sessions(df: DataFrame, key: str, at: Column, gap: float, order: list) -> DataFrame:
    """df with session: a new one where more than `gap` lies between neighbours."""
    by = Window.partitionBy(key).orderBy(*order)
    new = (at - F.lag(at).over(by) > gap).cast("int")
    return df.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def merge_ranges(df: DataFrame, key: str, s: str = "s", e: str = "e", touch: float = 0) -> DataFrame:
    """key, s, e, n: the union of overlapping or touching ranges, from a running maximum of ends."""
    by = Window.partitionBy(key).orderBy(s, e)
    before = F.max(e).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(s) > before + touch).cast("int"), F.lit(0))
    marked = df.withColumn("_new", new).withColumn("_g", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_g").agg(F.min(s).alias("s"), F.max(e).alias("e"), F.count("*").alias("n")).drop("_g")


def longest_silence(df: DataFrame, key: str, s: str, e: str, whole: Column) -> DataFrame:
    """key, gap, silent: the longest stretch without words, and whether it is longer than
    min(120, max(60, a fifth of the whole))."""
    by = Window.partitionBy(key).orderBy(s, e).rowsBetween(Window.unboundedPreceding, -1)
    gaps = df.withColumn("_gap", F.greatest(F.col(s) - F.coalesce(F.max(e).over(by), F.lit(0.0)), F.lit(0.0)))
    out = gaps.groupBy(key).agg(F.max("_gap").alias("gap"), F.max(e).alias("_end"), F.max(whole).alias("_whole"))
    gap = F.greatest("gap", F.col("_whole") - F.col("_end"))
    limit = F.least(F.lit(120.0), F.greatest(F.lit(60.0), 0.2 * F.col("_whole")))
    return out.select(key, F.round(gap, 6).alias("gap"), (gap > limit).alias("silent"))


def islands(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, a, b, n: maximal runs of consecutive whole numbers."""
    once = df.select(*keys, at).distinct()
    grp = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    return once.withColumn("_g", grp).groupBy(*keys, "_g").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n")).drop("_g")


def fill_back(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """value filled from the next row that has one: what a marker closes belongs to it."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(value, F.first(value, ignorenulls=True).over(by))
