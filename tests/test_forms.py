"""Cues by form, originals and line markup on small texts."""

from pyspark.sql import functions as F

from quotelens.operators import forms, originals
from quotelens.sources import markup


def cues(spark, text, column):
    row = spark.createDataFrame([(text.split(),)], "w array<string>").select(column(F.col("w")).alias("x")).first()
    return [tuple(c) for c in row.x]


BLESS = lambda w, i: forms.blessing_length(w, i, "peace", ["peace", "be", "upon", "him", "always"], ["him"], ["always"])
REPORT = lambda w: forms.reports(w, [("the", "teacher"), ("teacher",)], BLESS, ["that"], ["was", "the"])


def test_report_needs_title_blessing_and_opener(spark):
    assert cues(spark, "he urged the teacher peace be upon him that we read", REPORT) == [(1, 8)]
    assert cues(spark, "he urged the teacher peace be upon him always that we", REPORT) == [(1, 9)]
    assert cues(spark, "he was the teacher peace be upon him that we", REPORT) == []  # no verb
    assert cues(spark, "he urged the teacher that we", REPORT) == []  # no blessing
    assert cues(spark, "he urged the teacher peace be upon him and left", REPORT) == []  # no opener
    assert cues(spark, "the teacher peace be upon him that", REPORT) == []  # nothing before the title


def test_report_inside_a_dropped_one_is_dropped(spark):
    rows = spark.sql("SELECT transform(array(array(0, 6), array(3, 9), array(7, 12), array(11, 13)), x -> named_struct('pos', x[0], 'end', x[1])) AS c")
    got = rows.select(forms._disjoint(F.col("c")).alias("c")).first().c
    assert [tuple(c) for c in got] == [(0, 6), (11, 13)]  # the third begins inside the second, which begins inside the first


def test_blessing_ends_at_its_last_word_and_may_be_cut_off(spark):
    assert cues(spark, "told the teacher peace be upon", REPORT) == []
    assert cues(spark, "", REPORT) == []


GLORY = lambda w: forms.glorified(w, ["says"], ["god"], ["exalted"], ["great", "blessed"], "in")


def test_glorification_makes_the_cue(spark):
    assert cues(spark, "god says god great name exalted read", GLORY) == [(1, 6)]
    assert cues(spark, "says god great in heaven read", GLORY) == [(0, 5)]
    assert cues(spark, "says god read", GLORY) == []


HABIT = lambda w: forms.used_to_say(w, ["was"], ["saying"], ["said"], ["ibn"], "from")


def test_named_person_used_to_say(spark):
    assert cues(spark, "was ibn omar saying read", HABIT) == [(0, 4)]
    assert cues(spark, "was the man saying read", HABIT) == []
    assert cues(spark, "was ibn omar said saying", HABIT) == []
    assert cues(spark, "was ibn from omar saying", HABIT) == []
    assert cues(spark, "was ibn a b c d e f saying", HABIT) == []  # too long for a name


NAMED = lambda w: forms.blessed_names(w, ["said"], "from", [("may", "he", "rest"), ("mercy",)])


def test_prayer_after_a_name(spark):
    assert cues(spark, "said ibn omar may he rest read", NAMED) == [(0, 6)]
    assert cues(spark, "from omar mercy read", NAMED) == [(0, 3)]
    assert cues(spark, "from omar from zayd mercy read", NAMED) == [(2, 5)]  # the nearer link
    assert cues(spark, "said mercy read", NAMED) == []  # no name


def test_context_of_the_first_pattern(spark):
    w = spark.createDataFrame([("a b c weak d e",), ("not weakly",), ("",)], "t string")
    got = w.select(forms.phrase_context(F.filter(F.split("t", " "), lambda x: x != ""), ["void", "weak"], 2, 1).alias("x")).collect()
    assert [r.x for r in got] == ["b c weak d", None, None]


def test_original_range_and_unpaired_quotes(spark):
    df = spark.createDataFrame([('— Éloge , "du roi" fin',), (None,), ("",)], "text string").withColumn("p", originals.pieces(F.col("text")))
    df = df.withColumn("a", originals.word_places(F.col("p")))
    cut = lambda a, b: originals.original_range(F.col("p"), F.col("a"), F.lit(a), F.lit(b))
    rows = df.select(originals.shown_words(F.col("p"), F.col("a")).alias("s"), cut(0, 1).alias("one"), cut(1, 2).alias("two"), cut(0, 9).alias("out")).collect()
    assert rows[0].s == ["— Éloge ,", '"du', 'roi"', "fin"]
    assert (rows[0].one, rows[0].two, rows[0].out) == ("Éloge , du", '"du roi"', "")
    assert [(r.s, r.one) for r in rows[1:]] == [([], ""), ([], "")]


def test_ambiguous_placements_abstain(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b", "x", "a", "b"], ["A", "b", "x", "a", "b"]), (["x"], ["a", "x"], ["a", "X"]), (["q"], ["a"], ["a"])], "want array<string>, w array<string>, s array<string>")
    at = df.withColumn("at", originals.placements(F.col("want"), F.col("w")))
    rows = at.select("at", originals.unambiguous(F.col("at"), F.size("want"), F.col("s")).alias("ok")).collect()
    assert [(list(r["at"]), r.ok) for r in rows] == [([0, 3], False), ([1], True), ([], False)]


def test_spelling_wording_and_units(spark):
    df = spark.createDataFrame([("said it", "said it", '"Said, it."'), ("said", "said it", "x"), ("", "", "x")], "c string, s string, o string")
    assert [r.x for r in df.select(originals.source_spelling(F.col("c"), F.col("s"), F.col("o")).alias("x")).collect()] == ["Said, it", None, None]
    t = spark.createDataFrame([("«a b c»",), ("",), (None,), ("😀é",)], "t string")
    assert [r.x for r in t.select(originals.source_wording(F.col("t"), 2).alias("x")).collect()] == ["a b …", "", "", "😀é"]
    assert t.select(originals.utf16_length(F.col("t")).alias("x")).collect()[3].x == 3


BOOK = """#META# x
# not text
#META#Header#End#
### | First part
# one two PageV01P001 three ms12 four
~~five
### || Contents
# left out
### | Second
PageV01P002 six
# seven
PageV01P003
# eight"""


def test_markup_pages_headings_and_contents(spark):
    df = spark.createDataFrame([(1, BOOK), (2, "# a PageV01P000 b\n# c PageV01P004"), (3, None), (4, "")], "k int, t string")
    rows = sorted(tuple(r) for r in markup.markup_paragraphs(df, "k", "t", "^contents").collect())
    assert rows == [
        (1, 0, "first part", 1, 1, "one two three four five"),
        (1, 1, "second", 1, 3, "six"),
        (1, 2, "second", 1, 3, "seven"),
        (1, 3, "second", 0, 0, "eight"),
        (2, 0, "", 0, 0, "a b"),
        (2, 1, "", 0, 0, "c"),
    ]
