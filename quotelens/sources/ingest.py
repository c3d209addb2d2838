"""Readers and parsers: passages, transcripts, subtitles, stamped text, recogniser answers, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PASSAGE = "t string, r string, n string, m int, x struct<book:int,in_book:int,printed:string>, s int"
WORD = "array<struct<w:string,start:double,end:double>>"


def read_passages(spark: SparkSession, path: str, packs: list[str] | None = None) -> DataFrame:
    """Passages from sharded JSON lines or from Parquet partitioned by pack; packs prunes partitions."""
    df = spark.read.parquet(path) if not path.endswith((".json", ".jsonl")) and "json" not in path.rsplit("/", 1)[-1] else spark.read.schema(PASSAGE).json(path)
    return df.filter(F.col("pack").isin(*packs)) if packs and "pack" in df.columns else df


def write_passages(df: DataFrame, path: str, per_file: int = 50_000) -> None:
    """One folder a pack, files of a bounded number of rows."""
    df.write.option("maxRecordsPerFile", per_file).partitionBy("pack").mode("overwrite").parquet(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """id, text, n_citations, half of a TSV file: even lines are dev, odd ones test. A line's parity
    needs its number, so the file is one task's work: gold sets are small by nature."""
    rows = spark.read.schema("id string, text string, n_citations int").option("sep", "\t").csv(path).coalesce(1)
    return rows.withColumn("half", F.when(F.monotonically_increasing_id() % 2 == 0, "dev").otherwise("test"))


def plain_words(text: Column) -> Column:
    """Array of {w, start, end} without times."""
    ws = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    none = F.lit(None).cast("double")
    return F.transform(ws, lambda w: F.struct(w.alias("w"), none.alias("start"), none.alias("end")))


def json_words(body: Column) -> Column:
    """Array of {w, start, end} from {"words": [...]} whose items name the word w, word or text;
    times are kept only where both are there."""
    item = "array<struct<w:string,word:string,text:string,start:double,end:double>>"
    ws = F.from_json(body, f"words {item}")["words"]

    def one(x: Column) -> Column:
        both = x["start"].isNotNull() & x["end"].isNotNull()
        return F.struct(
            F.coalesce(x["w"], x["word"], x["text"], F.lit("")).alias("w"),
            F.when(both, x["start"]).alias("start"),
            F.when(both, x["end"]).alias("end"),
        )

    return F.filter(F.transform(F.coalesce(ws, F.array().cast(item)), one), lambda x: x["w"] != "")


def spread(words: Column, start: Column, end: Column) -> Column:
    """Words spread evenly over a time span."""
    n = F.greatest(F.size(words), F.lit(1))
    step = (end - start) / n
    return F.transform(words, lambda w, i: F.struct(w.alias("w"), F.round(start + i * step, 3).alias("start"), F.round(start + (i + 1) * step, 3).alias("end")))


def asr_words(body: Column) -> Column:
    """Words of a recogniser's answer: its words, else its segments' words spread, else its text."""
    a = F.from_json(body, "words array<struct<word:string,start:double,end:double>>, segments array<struct<text:string,start:double,end:double>>, text string, duration double")
    split = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    from_words = F.transform(a["words"], lambda x: F.struct(F.trim(x["word"]).alias("w"), x["start"].alias("start"), x["end"].alias("end")))
    from_segments = F.flatten(F.transform(a["segments"], lambda s: spread(split(s["text"]), s["start"], s["end"])))
    from_text = spread(split(F.coalesce(a["text"], F.lit(""))), F.lit(0.0), F.coalesce(a["duration"], F.lit(0.0)))
    return F.when(F.size(F.coalesce(a["words"], F.array())) > 0, from_words).when(F.size(F.coalesce(a["segments"], F.array())) > 0, from_segments).otherwise(from_text)


_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?"


def _seconds(col: Column, group: int) -> Column:
    part = lambda i: F.coalesce(F.try_to_number(F.regexp_extract(col, rf"{_TIME}\s*-->\s*{_TIME}", group + i), F.lit("999999")).cast("double"), F.lit(0.0))
    fraction = F.concat(F.lit("0."), F.regexp_extract(col, rf"{_TIME}\s*-->\s*{_TIME}", group + 3), F.lit("0")).cast("double")
    return part(0) * 3600 + part(1) * 60 + part(2) + fraction


def subtitle_words(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, cue, w, start, end from SRT or VTT text: each cue's words spread evenly over its time.

    Fractions of seconds are optional. A text without any cue is read as plain text, without what looks
    like subtitles' scaffolding (headers, notes, numbers, times): its words have no times."""
    plain = df.filter(~F.coalesce(F.col(col).rlike(rf"{_TIME}[ \t]*-->[ \t]*{_TIME}"), F.lit(False)))
    lines = F.filter(F.split(F.coalesce(F.col(col), F.lit("")), r"\r?\n"), lambda x: ~x.rlike(r"^\s*(WEBVTT.*|NOTE.*|\d+|.*-->.*)\s*$"))
    bare = F.filter(F.split(F.regexp_replace(F.array_join(lines, " "), r"<[^>]+>", " "), r"\s+"), lambda w: w != "")
    none = F.lit(None).cast("double")
    untimed = plain.select(key, F.lit(0).alias("cue"), F.explode(bare).alias("w"), none.alias("start"), none.alias("end"))
    cues = df.select(key, F.posexplode(F.split(F.regexp_replace(col, r"\r\n?", "\n"), r"\n[ \t]*\n")).alias("cue", "body"))
    cues = cues.filter(F.col("body").rlike(rf"{_TIME}\s*-->\s*{_TIME}"))
    said = F.regexp_replace(F.regexp_replace("body", rf"(?s)^.*?{_TIME}\s*-->\s*{_TIME}[^\n]*\n?", ""), r"<[^>]+>", " ")
    ws = F.filter(F.split(said, r"\s+"), lambda w: w != "")
    rows = cues.select(key, "cue", F.explode(spread(ws, _seconds(F.col("body"), 1), _seconds(F.col("body"), 5))).alias("x"))
    return rows.select(key, "cue", "x.w", "x.start", "x.end").unionByName(untimed)


def stamped_segments(df: DataFrame, key: str, col: str, most: float = 30.0) -> DataFrame:
    """key, start, end, text of a transcript of stamps and lines ("0:05", then text). A segment ends
    at the next later stamp, after `most` seconds at most. Texts with fewer than three stamps, or
    with more than a tenth of them running backwards, give none."""
    lines = df.select(key, F.posexplode(F.split(col, r"\r?\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    stamp = r"^(?:(\d+):)?(\d{1,2}):(\d{2})$"
    num = lambda i: F.when(F.regexp_extract("line", stamp, i) != "", F.regexp_extract("line", stamp, i)).otherwise("0").cast("double")
    lines = lines.withColumn("t", F.when(F.col("line").rlike(stamp), num(1) * 3600 + num(2) * 60 + num(3)))
    by = Window.partitionBy(key).orderBy("i")
    lines = lines.withColumn("seg", F.count("t").over(by)).filter("seg > 0")
    segs = lines.groupBy(key, "seg").agg(
        F.max("t").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNull() & (F.col("line") != ""), F.struct("i", "line")))), lambda x: x["line"]), " ").alias("text")
    )
    order = Window.partitionBy(key).orderBy("seg")
    whole = Window.partitionBy(key)
    back = (F.col("start") < F.lag("start").over(order)).cast("int")
    segs = segs.withColumn("_back", F.coalesce(back, F.lit(0))).withColumn("_n", F.count("*").over(whole)).withColumn("_b", F.sum("_back").over(whole))
    segs = segs.filter((F.col("_n") >= 3) & (F.col("_b") * 10 <= F.col("_n")))
    later = F.min(F.when(F.col("start") > 0, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    nxt = F.min("start").over(order.rowsBetween(1, Window.unboundedFollowing))
    end = F.least(F.when(nxt > F.col("start"), nxt).otherwise(F.when(later > F.col("start"), later)), F.col("start") + most)
    return segs.select(key, "seg", "start", F.coalesce(end, F.col("start") + most).alias("end"), "text")


def clamp_times(words: Column, longest: float = 0.8, least: float = 0.2) -> Column:
    """Times that never run backwards; a word lasts between `least` and `longest` seconds."""

    def step(out, x):
        last = F.when(F.size(out) > 0, F.try_element_at(out, F.lit(-1))["end"]).otherwise(F.lit(0.0))
        s = F.greatest(x["start"], last)
        e = F.greatest(F.least(x["end"], s + longest), s + least)
        return F.concat(out, F.array(F.struct(x["w"].alias("w"), s.alias("start"), e.alias("end"))))

    return F.aggregate(words, F.array().cast(WORD), step)


def read_session(body: Column) -> Column:
    """A saved session: title, packs, video, words, review; wrong parts come out null, not as errors."""
    return F.from_json(body, "version int, title string, packs array<string>, video string, words array<array<string>>, review map<string,struct<v:string,note:string,sig:string>>", {"mode": "PERMISSIVE"})
