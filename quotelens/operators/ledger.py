"""From clusters to a ledger: alignment, verdicts, grouping, agreement of two ledgers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions.align import align, diagonal_band, summarize, verdict, weight
from quotelens.operators.tokens import document_frequency, with_words

MATCH = (
    "pid long, cluster long, ts int, te int, ps int, pe int, exact int, asr int, near int, joined int, diff int, ins int, "
    "dels int, longest_run int, matched int, q double, evidence double, status string, ops string"
)
RANK = {"verbatim": 0, "partial": 1, "lead": 2, "echo": 3, "reject": 4}


def verify(clusters: DataFrame, docs: DataFrame, passages: DataFrame, n_passages: int, doc: str = "doc_id", pid: str = "item_id", margin: int = 25) -> DataFrame:
    """One aligned, judged row for each cluster that gives an alignment, near the diagonals of shared
    word pairs.

    Each cluster carries its own slice of the document and its passage, with the idf of the
    passage's words, so the kernel runs on independent rows in Arrow batches: no document and no
    group is ever gathered in one task.
    """
    dw, pw = with_words(docs, doc).withColumnRenamed("w", "_d"), with_words(passages, pid).withColumnRenamed("w", "_p")
    idf = document_frequency(passages, pid).select("tok", (F.log(F.lit(float(n_passages))) - F.log("df")).alias("idf"))
    per = pw.select(pid, "_p", F.explode(F.array_distinct("_p")).alias("tok")).join(idf, "tok")
    per = per.groupBy(pid).agg(F.first("_p").alias("_p"), F.map_from_entries(F.collect_list(F.struct("tok", "idf"))).alias("_idf"))
    lo = F.greatest(F.col("a") - margin - F.size("_p"), F.lit(0))
    hi = F.col("b") + margin + F.size("_p")
    rows = clusters.select(doc, F.col(pid), "cluster", "a", "b").join(dw, doc).join(per, pid)
    rows = rows.select(
        doc, F.col(pid).cast("long").alias("pid"), F.col("cluster").cast("long").alias("cluster"), lo.cast("int").alias("lo"),
        F.array_join(F.slice("_d", lo.cast("int") + 1, (hi - lo).cast("int")), " ").alias("said"), F.array_join("_p", " ").alias("written"), F.to_json("_idf").alias("idf"),
    )
    unknown = math.log(max(n_passages, 1))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                spoken, source, known = r.said.split(), r.written.split(), json.loads(r.idf)
                value = lambda w, known=known: known.get(w, unknown)
                band = diagonal_band(spoken, source)
                al = align(spoken, source, lambda w, value=value: weight(value(w)), band=band) if band else None
                if al is None:
                    continue
                c = summarize(al, spoken, source, value)
                status = verdict(c, whole=al.ps == 0 and al.pe == len(source))
                out.append(
                    (getattr(r, doc), r.pid, r.cluster, al.ts + r.lo, al.te + r.lo, al.ps, al.pe, c["exact"], c["asr"], c["near"], c["join"], c["diff"], c["ins"], c["del"],
                     c["longest_run"], c["matched"], round(c["q"], 6), round(c["evidence"], 6), status, " ".join(o.op for o in al.ops))
                )
            yield pd.DataFrame(out, columns=[doc, *(x.split()[0] for x in MATCH.split(", "))])

    return rows.mapInPandas(judge, f"{doc} {dict(rows.dtypes)[doc]}, {MATCH}")


def group(matches: DataFrame, doc: str = "doc_id", share: float = 0.5) -> DataFrame:
    """Ledger entries: doc, entry, ts, te, status, pid, parallels (array of pids).

    Matches of a document that are not rejected form chains of overlapping spans; within a chain,
    the best match (status, evidence, passage) is the entry and the matches that overlap it by
    `share` of the shorter span are its parallels. Only window functions per document are used.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("status"))
    m = matches.filter("status <> 'reject'").withColumn("_rank", rank)
    once = Window.partitionBy(doc, "pid", "ts", "te", "ps").orderBy("cluster")
    m = m.withColumn("_o", F.row_number().over(once)).filter("_o = 1").drop("_o")
    by = Window.partitionBy(doc).orderBy("ts", "te", "pid", "ps")
    before = F.max("te").over(by.rowsBetween(Window.unboundedPreceding, -1))
    chain = F.sum(F.coalesce((F.col("ts") >= before).cast("int"), F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("chain", chain)
    best = Window.partitionBy(doc, "chain").orderBy("_rank", F.desc("evidence"), "pid", "ts", "ps")
    m = m.withColumn("_k", F.row_number().over(best)).withColumn("_ts", F.first("ts").over(best)).withColumn("_te", F.first("te").over(best))
    inter = F.least("te", "_te") - F.greatest("ts", "_ts")
    near = inter >= share * F.least(F.col("te") - F.col("ts"), F.col("_te") - F.col("_ts"))
    pick = lambda c: F.max(F.when(F.col("_k") == 1, F.col(c)))
    out = m.groupBy(doc, "chain").agg(
        pick("ts").alias("ts"), pick("te").alias("te"), pick("status").alias("status"), pick("pid").alias("pid"), pick("evidence").alias("evidence"),
        F.array_sort(F.collect_set(F.when((F.col("_k") > 1) & near, F.col("pid")))).alias("parallels"),
    )
    entry = F.row_number().over(Window.partitionBy(doc).orderBy("ts", "te", "pid"))
    return out.withColumn("entry", entry).drop("chain")


def agreement(a: DataFrame, b: DataFrame, keys: list[str], pos: str = "pos", tok: str = "tok", truth: DataFrame | None = None) -> DataFrame:
    """keys, pos, class: how two transcriptions of one source agree at each of its positions.

    A full outer join on the position; `truth` (keys, pos, tok) is the source's own word."""
    both = a.select(*keys, pos, F.col(tok).alias("ta")).join(b.select(*keys, pos, F.col(tok).alias("tb")), [*keys, pos], "full")
    both = both.join(truth.select(*keys, pos, F.col(tok).alias("t")), [*keys, pos], "left")
    ea, eb = F.col("ta") == F.col("t"), F.col("tb") == F.col("t")
    kind = (
        F.when(F.col("ta").isNull() | F.col("tb").isNull(), "ONLY_ONE_COVERS")
        .when(ea & eb, "BOTH_EXACT")
        .when(ea | eb, "ONE_EXACT")
        .when(F.col("ta") == F.col("tb"), "BOTH_DIFFER_SAME")
        .otherwise("BOTH_DIFFER_DIFFERENT")
    )
    return both.select(*keys, pos, kind.alias("class"))


def agreement_verdict(classes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts of each class, verdict."""
    n = lambda c: F.count_if(F.col("class") == c)
    out = classes.groupBy(*keys).agg(
        n("BOTH_EXACT").alias("both_exact"), n("ONE_EXACT").alias("one_exact"), n("BOTH_DIFFER_SAME").alias("differ_same"),
        n("BOTH_DIFFER_DIFFERENT").alias("differ_different"), n("ONLY_ONE_COVERS").alias("only_one"),
    )
    said = F.when(F.col("differ_same") > 0, "differs").when((F.col("one_exact") + F.col("differ_different") + F.col("only_one")) == 0, "confirmed").when(F.col("differ_different") > 0, "unresolved").otherwise("raised")
    return out.withColumn("verdict", said)


def diff_marks(ops: DataFrame, key: str) -> DataFrame:
    """Moved words: two diffs at most 12 ops apart that mirror each other (key, i, said, written)."""
    x = ops.select(key, F.col("i").alias("i1"), F.col("said").alias("s1"), F.col("written").alias("w1"))
    y = ops.select(key, F.col("i").alias("i2"), F.col("said").alias("s2"), F.col("written").alias("w2"))
    mirrored = [F.col(key) == F.col("_key"), F.col("s1") == F.col("w2"), F.col("w1") == F.col("s2"), F.col("i2").between(F.col("i1") + 1, F.col("i1") + 12)]
    pairs = x.join(y.withColumnRenamed(key, "_key"), mirrored)
    first = Window.partitionBy(key, "i1").orderBy("i2")
    return pairs.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(key, "i1", "i2")
