"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every source s has a token target T_s. Among all document rates 0 <= r_i <= 2, the mix takes
those that stay closest (Kullback-Leibler) to rate 1 and meet sum(r_i * size_i) = T_s. The
convex dual has one multiplier per source, and its solution is an exponential tilt of the
document's size: r_i = min(2, exp(lambda_s * z_i)), z_i the size over the source's mean size.
Newton iterations find all multipliers at once, each a distributed sum over a histogram of sizes
whose number of rows does not grow with the documents. Rates become copies by diffusing the error from the largest
sizes to the smallest, so a source ends within about one small document of its target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelens.llm.common import cut

#: Words are runs of characters other than ASCII white space.
NOT_WORD = r"[\x20\x09-\x0D]+"
#: Size classes an octave; within one, sizes differ by about 1 %.
PER_OCTAVE = 64
#: Documents that one task numbers at once when a size class is dealt out.
RUN = 20_000


def word_count(text) -> F.Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "\u0001")
    return F.length(F.regexp_replace(squeezed, NOT_WORD, "")).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n, source_size, target: the water-filling of share * all words.

    Sources in order of code points, null last, have the weights in turn. A target stops at
    `most` times the source's size; what is above goes to the others by weight. With sources in
    the order of most * size / weight, the first k are full exactly if the level that the rest
    then share is above theirs, so prefix sums give the level without any iteration.
    The input is one row a source.
    """
    cap = F.lit(float(most)) * F.col("source_size")
    ranked = sizes.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w).withColumn("_cap", cap).withColumn("_at", cap / F.col("_w"))
    by = Window.orderBy("_at", "_k")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.lit(float(share)) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # the first source that stays below its cap sets the level; from there on levels only fall
    found = ranked.withColumn("_level", level).withColumn("_open", F.col("_level") <= F.col("_at"))
    theta = F.max(F.when(F.col("_open"), F.col("_level"))).over(everything)
    target = F.when(theta.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * theta))
    return found.withColumn("target", target.cast("double")).select("source", "n", "source_size", "target")


def solve_rates(hist: DataFrame, per_source: DataFrame, most: float = 2.0, steps: int = 80) -> DataFrame:
    """source, target, bin, w, z, n, rate: Newton's method on the dual, kept inside a bracket.

    hist has source, bin, n, words. Each iteration is a distributed sum: every size class adds to the
    value and the slope of its source's f(l) = sum words * min(most, exp(l * z)) - T, and a table
    of one row a source takes the step. f rises in l; a step is Newton's where it stays inside the
    bracket and halves the bracket where it does not, so the iterations cannot diverge. They end
    when every source is within 1e-9 of its target; full sources take no part.
    """
    limit = math.log(most)
    full = F.col("target") >= F.lit(float(most)) * F.col("source_size")
    state = per_source.filter("source_size > 0").select(
        F.col("source").alias("_s"), "target", "source_size", F.col("n").alias("n_all"), full.alias("full"),
        F.lit(0.0).alias("lam"), F.lit(-2048.0).alias("lo"), F.lit(2048.0).alias("hi"),
    )
    classes = hist.filter("words > 0").select("source", "bin", "n", F.col("words").cast("double").alias("w"))

    def met(now: DataFrame) -> DataFrame:
        z = (F.col("w") / F.col("n")) / (F.col("source_size") / F.col("n_all"))
        return classes.join(now, F.col("source").eqNullSafe(F.col("_s"))).withColumn("z", z)

    tilt = F.exp(F.least(F.col("lam") * F.col("z"), F.lit(limit)))
    for _ in range(steps):
        state = cut(state)
        sums = met(state).groupBy(F.col("source").alias("_t")).agg(
            F.sum(F.col("w") * tilt).alias("_f"),
            F.sum(F.when(F.col("lam") * F.col("z") < limit, F.col("w") * F.col("z") * tilt).otherwise(0.0)).alias("_g"),
        )
        f = F.col("_f") - F.col("target")
        at = cut(state.join(sums, F.col("_s").eqNullSafe(F.col("_t"))).withColumn("_f", f))
        off = at.filter(~F.col("full")).agg(F.max(F.abs("_f") / F.greatest("target", F.lit(1.0)))).first()[0]
        if off is None or off <= 1e-9:
            break
        lo = F.when(F.col("_f") < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("_f") < 0, F.col("hi")).otherwise(F.col("lam"))
        newton = F.when(F.col("_g") > 0, F.col("lam") - F.col("_f") / F.col("_g"))
        lam = F.when(newton.isNotNull() & (newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        state = at.select("_s", "target", "source_size", "n_all", "full", lam.alias("lam"), lo.alias("lo"), hi.alias("hi"))
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(tilt)
    return met(state).select("source", "target", "lam", "bin", "w", "z", "n", rate.alias("rate"))


def quotas(rates: DataFrame) -> DataFrame:
    """source, bin, base, extra: copies that every document of a class gets, and how many get one more.

    From the largest sizes to the smallest, a class gives as many further copies as bring the
    words so far nearest to the words due so far; what is left over goes on to the next class.
    """
    base = F.floor("rate")
    per = (
        rates.withColumn("base", base)
        .groupBy("source", "target")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("bin", "w", "n", "base", F.col("rate").alias("r"))), asc=False
            ).alias("b"),
            F.sum(F.col("w") * F.col("base")).alias("taken"),
        )
    )

    def give(state, x):
        mean = x["w"] / x["n"]
        due = state["left"] + x["w"] * (x["r"] - x["base"])
        k = F.greatest(F.lit(0.0), F.least(F.when(x["r"] < 2, x["n"].cast("double")).otherwise(0.0), F.round(due / mean)))
        return F.struct(
            (due - k * mean).alias("left"),
            F.concat(
                state["out"],
                F.array(F.struct(x["bin"].alias("bin"), x["base"].alias("base"), k.cast("long").alias("extra"))),
            ).alias("out"),
        )

    none = F.array().cast("array<struct<bin:int,base:bigint,extra:bigint>>")
    start = F.struct(F.lit(0.0).alias("left"), none.alias("out"))
    return per.select("source", F.explode(F.aggregate("b", start, give, lambda s: s["out"])).alias("q")).select(
        "source", "q.bin", "q.base", "q.extra"
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, rate, copies, taken.

    size counts the words of the whole text. copies is 0, 1 or 2 (with most = 2). Which documents
    of a size class get one copy more follows a hash of doc_id and text, so reruns agree, and rows
    without an id are dealt out like others; repeated rows count as documents of their own. Null or empty texts have size 0 and one copy of nothing.
    A null source is a source. An empty table gives no rows. Other columns are ignored.

    A class can hold a large part of all documents; its documents are numbered in runs of about
    RUN by hash, with the counts of the runs before added, so no task sees a whole class.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("_h"))
    sized = sized.withColumn(
        "bin",
        F.when(F.col("size") <= 0, F.lit(-1))
        .otherwise(F.floor(F.log2(F.col("size").cast("double")) * PER_OCTAVE))
        .cast("int"),
    )
    sized = cut(sized)  # words are counted once; the rest reads five narrow columns
    hist = sized.groupBy("source", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    hist = cut(hist)
    per_source = targets(
        hist.groupBy("source").agg(F.sum("n").alias("n"), F.sum("words").alias("source_size")), weights, share, most
    )
    per_source = cut(per_source)
    rates = cut(solve_rates(hist, per_source, most))
    deal = quotas(rates)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    plan = (
        hist.alias("h")
        .join(rates.alias("r"), same("h", "r") & (F.col("h.bin") == F.col("r.bin")), "left")
        .join(deal.alias("q"), same("h", "q") & (F.col("h.bin") == F.col("q.bin")), "left")
        .join(per_source.alias("p"), same("h", "p"))
        .select(
            F.col("h.source").alias("source"),
            F.col("h.bin").alias("bin"),
            F.ceil(F.col("h.n") / RUN).alias("runs"),
            F.coalesce(F.col("r.rate"), F.lit(1.0)).alias("rate"),
            F.coalesce(F.col("q.base"), F.lit(1)).alias("base"),
            F.coalesce(F.col("q.extra"), F.lit(0)).alias("extra"),
            F.col("p.source_size").alias("source_size"),
            F.col("p.target").alias("target"),
        )
    )
    plan = cut(plan)
    # one row a class: a few thousand a source, so the planner may broadcast it when it is small
    rows = (
        sized.alias("d")
        .join(plan.alias("c"), same("d", "c") & (F.col("d.bin") == F.col("c.bin")))
        .select("d.doc_id", "d.source", "d.size", "d._h", "c.bin", "c.runs", "c.rate", "c.base", "c.extra", "c.source_size", "c.target")
        .withColumn("_run", F.pmod(F.shiftright("_h", 8), F.col("runs")))
    )
    counts = rows.groupBy("source", "bin", "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source", "bin").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        F.col("source").alias("_s"), F.col("bin").alias("_b"), F.col("_run").alias("_r"), "_before"
    )
    rank = F.row_number().over(Window.partitionBy("source", "bin", "_run").orderBy("_h", "doc_id", "size"))
    ranked = rows.withColumn("_rank", rank).join(
        counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")) & (F.col("_run") == F.col("_r"))
    )
    copies = (F.col("base") + F.when(F.col("_before") + F.col("_rank") <= F.col("extra"), 1).otherwise(0)).cast("int")
    return ranked.withColumn("copies", copies).select(
        "doc_id",
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        "rate",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )
