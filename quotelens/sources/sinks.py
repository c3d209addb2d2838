"""Writers and exports: guarded CSV, JSON, paragraphs, subtitles, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions.text import clock, csv_guard, srt_clock


def csv_rows(df: DataFrame) -> DataFrame:
    """All columns as text, formula injection guarded, nulls empty."""
    return df.select(*[F.coalesce(csv_guard(F.col(c).cast("string")), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Always quoted, CRLF, with a header."""
    csv_rows(df).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def to_json_rows(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("json"))


def _fold_groups(words: Column, closes) -> Column:
    """Array of group numbers: closes(n, words so far in the group, x, next) says whether a group ends with x."""

    def step(s, i):
        x = F.element_at(words, i)
        nxt = F.try_element_at(words, (i + 1).cast("int"))
        n = s["n"] + 1
        start = F.when(s["n"] == 0, x["start"]).otherwise(s["start"])
        ends = F.coalesce(closes(n, start, x, nxt), F.lit(False))
        return F.struct(
            F.when(ends, 0).otherwise(n).alias("n"), F.when(ends, s["g"] + 1).otherwise(s["g"]).alias("g"), start.alias("start"), F.concat(s["out"], F.array(s["g"])).alias("out")
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("g"), F.lit(0.0).alias("start"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["out"])


def _grouped(df: DataFrame, key: str, words: str, closes) -> DataFrame:
    rows = df.select(key, F.posexplode(F.arrays_zip(F.col(words).alias("x"), _fold_groups(F.col(words), closes).alias("g"))).alias("i", "z"))
    rows = rows.select(key, "i", F.col("z.g").alias("g"), F.col("z.x.w").alias("w"), F.col("z.x.start").alias("start"), F.col("z.x.end").alias("end"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ")
    return rows.groupBy(key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), text.alias("text"))


def paragraphs(df: DataFrame, key: str, words: str) -> DataFrame:
    """key, g, start, end, n, text: a paragraph ends at 150 words, from 60 at a clause end, from 40 at
    a sentence end, from 12 at a pause of 2.5 s."""

    def closes(n, start, x, nxt):
        pause = nxt["start"] - x["end"]
        return (n >= 150) | ((n >= 60) & x["w"].rlike("[,;:،؛]$")) | ((n >= 40) & x["w"].rlike("[.!?؟…]$")) | ((n >= 12) & (pause >= 2.5))

    return _grouped(df, key, words, closes)


def srt_cues(df: DataFrame, key: str, words: str) -> DataFrame:
    """key, g, srt: a cue ends at 10 words, 6 s, a pause of 1.2 s, or from 4 words at a sentence end. A cue
    lasts 0.4 s at least and never runs into the next one, but 0.1 s in any case."""

    def closes(n, start, x, nxt):
        pause = nxt["start"] - x["end"]
        return (n >= 10) | (x["end"] - start >= 6.0) | (pause >= 1.2) | ((n >= 4) & x["w"].rlike("[.!?؟…]$"))

    cues = _grouped(df, key, words, closes)
    nxt = F.lead("start").over(Window.partitionBy(key).orderBy("g"))
    end = F.greatest("end", F.col("start") + 0.4)
    end = F.when(nxt.isNull(), end).otherwise(F.least(end, F.greatest(nxt, F.col("start") + 0.1)))
    line = F.concat_ws("\n", (F.col("g") + 1).cast("string"), F.concat(srt_clock(F.col("start")), F.lit(" --> "), srt_clock(end)), F.col("text"))
    return cues.select(key, "g", "n", line.alias("srt"))


def description_index(df: DataFrame, key: str, start: str, source: str, text: str) -> DataFrame:
    """key, lines: one "m:ss source: first eight words" a row, in time order."""
    first = F.array_join(F.slice(F.split(text, " "), 1, 8), " ")
    more = F.when(F.size(F.split(text, " ")) > 8, "…").otherwise("")
    line = F.concat(clock(F.col(start)), F.lit(" "), F.col(source), F.lit(": "), first, more)
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), line.alias("l")))), lambda x: x["l"])
    return df.groupBy(key).agg(F.array_join(rows, "\n").alias("lines"))


def footnotes(df: DataFrame, key: str, start: str, label: str, verdict: str, grade: str) -> DataFrame:
    """Numbered footnotes of a document model, in order of their place."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(start, label))
    note = F.concat_ws(", ", F.col(label), F.when(F.col(verdict) == "partial", "wording differs"), F.when(F.col(verdict) == "lead", "to be checked"), F.col(grade))
    return df.withColumn("number", n).select(key, "number", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), note).alias("footnote"))


def shard_ids(df: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """Shard numbers by running size: a shard holds at most `most`, unless one row alone has more.

    Two levels of sums keep the running total out of a single task: sums per range of ids first."""
    ranged = df.withColumn("_r", F.floor(F.col(order) / 100_000))
    sums = ranged.groupBy("_r").agg(F.sum(size).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum(size).over(Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_in", inner).join(sums.withColumn("_b", before).drop("_t"), "_r").withColumn("shard", F.floor((F.col("_b") + F.col("_in")) / most)).drop("_r", "_in", "_b")


def file_hashes(spark, path: str) -> DataFrame:
    """path, sha256 of each input file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
