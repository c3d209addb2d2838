import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotelens.functions import text as T


def one(spark, col, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string").select(col(F.col("x")).alias("y")).collect()
    return [r.y for r in rows]


def test_norm_en(spark):
    assert one(spark, T.norm_en, "Élan,  Vital!", "", None, "a1-b2", "ß") == ["elan vital", "", "", "a1 b2", ""]


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=20))
def test_py_norm_matches_unicode(s):
    flat = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
    if flat.isascii() or all(not c.isalnum() or c.isascii() for c in flat):
        if all(unicodedata.normalize("NFKD", c)[0] == unicodedata.normalize("NFKD", c).rstrip("̈́") or len([d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d)]) == 1 for c in s.lower()):
            assert T.py_norm_en(s).split() == "".join(c if c.isascii() and c.isalnum() else " " for c in flat).split()


def test_stem_en(spark):
    words = ["cities", "classes", "walking", "walked", "slowly", "dogs", "bus", "grass", "make", "as", "ring"]
    assert one(spark, T.stem_en, *words) == ["city", "class", "walk", "walk", "slow", "dog", "bus", "grass", "mak", "as", "ring"]


def test_arabic(spark):
    assert one(spark, T.norm_ar, "الصَّلَاةُ", "إلى", "abc") == ["الصلاه", "الي", ""]
    assert one(spark, T.fold, "صلاه") == ["سلاه"]
    assert one(spark, T.digits_ascii, "١٢٣") == ["123"]
    assert one(spark, T.norm_mixed, "کتاب", "Élan") == ["كتاب", "elan"]


def test_word_sim(spark):
    rows = [("same", "same"), ("kitten", "kittin"), ("cat", "car"), ("alphabeta", "alphabet"), ("house", "mouses")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(T.word_sim(F.col("a"), F.col("b"))).collect()]
    assert got == ["exact", "near", "diff", "near", "diff"]
    assert got == [T.py_word_sim(a, b) for a, b in rows]


def test_windows(spark):
    df = spark.createDataFrame([(0,), (140,), (141,), (320,)], "n int")
    got = [[(x.a, x.b) for x in r[0]] for r in df.select(T.windows(F.col("n"))).collect()]
    assert got == [[(0, 0)], [(0, 140)], [(0, 120), (21, 141)], [(0, 120), (100, 220), (200, 320)]]


def test_formats(spark):
    assert one(spark, lambda c: T.clock(c.cast("double")), "65", "3661", None) == ["1:05", "1:01:01", ""]
    assert one(spark, lambda c: T.srt_clock(c.cast("double")), "1.5") == ["00:00:01,500"]
    assert one(spark, T.csv_guard, "=1+1", "a", "-x") == ["'=1+1", "a", "'-x"]
    assert one(spark, T.video_id, "https://youtu.be/abcdefghijk", "x") == ["abcdefghijk", ""]
    assert one(spark, T.grade_class, "sahih", "weak sahih", "x") == ["strong", "weak", "neutral"]
