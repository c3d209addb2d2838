"""Entries and passages on small tables."""

from pyspark.sql import functions as F

from quotelens.operators import entries


def test_first_span_keeps_its_words(spark):
    rows = [(1, 0, 0, 5), (1, 1, 5, 6), (1, 2, 6, 9), (1, 3, 6, 9), (2, 0, 3, 3)]
    got = entries.owners(spark.createDataFrame(rows, "k int, n int, a int, b int"), "k").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 5), (1, 2, 6, 9), (2, 0, 3, 3)]
    assert entries.owners(spark.createDataFrame([], "k int, n int, a int, b int"), "k").count() == 0


def test_passages_lose_their_preamble_only_where_words_are_left(spark):
    rows = [(1, "In the name. One two three"), (2, "in the name"), (3, "in the name one"), (4, None), (5, "")]
    df = entries.usable_passages(spark.createDataFrame(rows, "k int, t string"), "t", 3, "In the name", F.col("k") != 3)
    got = {r.k: (list(r.words), r.why) for r in df.collect()}
    assert got == {
        1: (["one", "two", "three"], None), 2: (["in", "the", "name"], None), 3: (["in", "the", "name", "one"], None),
        4: ([], "missing"), 5: ([], "missing"),
    }


def test_tiers_doubts_and_alerts(spark):
    df = spark.createDataFrame([(True, None, None), (False, True, True), (None, True, None), (None, None, True)], "c boolean, b boolean, w boolean")
    assert [r.x for r in df.select(entries.tier(F.col("c"), F.col("b"), F.col("w")).alias("x")).collect()] == [0, 3, 2, 1]
    e = spark.createDataFrame([("verbatim", None, None, 1, 10), ("verbatim", None, True, 1, 10), ("partial", None, None, 0, 5), ("partial", None, None, 2, 11), ("meaning", None, None, 1, 5)], "s string, m boolean, q boolean, t int, n int")
    assert [r.x for r in e.select(entries.doubtful(*map(F.col, "smqtn")).alias("x")).collect()] == [True, False, False, False, False]
    g = spark.createDataFrame([("weak", ["x"]), ("weak", ["a"]), ("mixed", ["x"]), ("weak", None)], "k string, c array<string>")
    assert [r.x for r in g.select(entries.weak_only(F.col("k"), F.col("c"), ["a"]).alias("x")).collect()] == [True, False, False, True]


def test_positions_in_the_prefix_drop_out(spark):
    df = spark.createDataFrame([([4, 5],), ([3, 9],), ([],)], "p array<int>")
    assert [r.x for r in df.select(entries.rebased(F.col("p"), F.lit(4)).alias("x")).collect()] == [[0, 1], None, []]


def test_held_out_passages_and_null_keys(spark):
    p = spark.createDataFrame([(1, "a b c d e"), (2, "b c d x"), (None, "q q")], "k int, text string")
    f = spark.createDataFrame([(9, "z b c d e")], "q int, text string")
    out = entries.held_out(p, f, "k", "q")
    assert [r.k for r in out.collect()] == [1]
    assert sorted(str(r.k) for r in entries.without(p, out, "k").collect()) == ["2", "None"]
