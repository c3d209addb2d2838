"""Recognisers' answers, saved sessions and footnotes."""

from pyspark.sql import functions as F

from quotelens.sources import ingest, sinks


def words(spark, body):
    x = spark.createDataFrame([(body,)], "b string").select(ingest.asr_words(F.col("b")).alias("x")).first().x
    return [(w.w, w.start, w.end) for w in x]


def test_words_of_an_answer_come_from_words_segments_or_text(spark):
    assert words(spark, '{"words":[{"word":" a ","start":1,"end":2}],"text":"no"}') == [("a", 1.0, 2.0)]
    assert words(spark, '{"segments":[{"text":"a b","start":0,"end":1}],"text":"no"}') == [("a", 0.0, 0.5), ("b", 0.5, 1.0)]
    assert words(spark, '{"text":"a b","duration":4}') == [("a", 0.0, 2.0), ("b", 2.0, 4.0)]
    assert words(spark, "{}") == []


def test_times_never_run_backwards(spark):
    rows = [([("a", 0.0, 5.0), ("b", 0.5, 0.6), ("c", 0.1, 0.2)],), ([],)]
    df = spark.createDataFrame(rows, f"w {ingest.WORD}").select(ingest.clamp_times(F.col("w")).alias("x"))
    got = [[(w.w, round(w.start, 3), round(w.end, 3)) for w in r.x] for r in df.collect()]
    assert got == [[("a", 0.0, 0.8), ("b", 0.8, 1.0), ("c", 1.0, 1.2)], []]


def test_session_survives_wrong_parts(spark):
    df = spark.createDataFrame([('{"title":"t","packs":["p"],"words":[["a","1.5"]],"review":{"k":{"v":"yes"}}}',), ("no json",), (None,)], "b string")
    a, b, c = [r.x for r in df.select(ingest.read_session(F.col("b")).alias("x")).collect()]
    assert (a.title, a.packs, a.words, a.review["k"].v) == ("t", ["p"], [["a", "1.5"]], "yes")
    assert (b is None or b.title is None) and c is None


def test_footnotes_are_numbered_in_order(spark):
    df = spark.createDataFrame([(1, 9, "B", "partial", "sound"), (1, 2, "A", "verbatim", None), (2, 1, "C", "lead", None)], "k int, s int, l string, v string, g string")
    got = sorted(tuple(r) for r in sinks.footnotes(df, "k", "s", "l", "v", "g").collect())
    assert got == [(1, 1, "[1] A"), (1, 2, "[2] B, wording differs, sound"), (2, 1, "[1] C, to be checked")]


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "x").write_bytes(b"abc")
    assert [r.sha256 for r in sinks.file_hashes(spark, str(tmp_path)).collect()] == [hashlib.sha256(b"abc").hexdigest()]
