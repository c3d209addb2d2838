"""Queries over chunks, ranges, votes, reviews and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.functions import text as T
from quotelens.operators import spans, tokens
from quotelens.plans.registry import query, table, tokens_sql, words_sql
from quotelens.plans.text_queries import _HITS, _hits, stem_rel


@query(
    f"""SELECT doc_id, CAST(i * 90 AS INTEGER) AS a, CAST(CASE WHEN i = last THEN n ELSE i * 90 + 110 END AS INTEGER) AS b FROM (SELECT doc_id, n, last, unnest(range(0, last + 1)) AS i
FROM (SELECT doc_id, n, CASE WHEN more > 0 AND n - (110 + (more - 1) * 90) < 8 THEN more - 1 ELSE more END AS last FROM (SELECT doc_id, len(w) AS n, CAST(greatest(0, ceil((len(w) - 110) / 90)) AS BIGINT) AS more FROM ({words_sql('documents', 'doc_id')}) WHERE len(w) > 0)))"""
)
def chunk_words(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id")
    return w.select("doc_id", F.explode(spans.chunks(F.size("w"))).alias("x")).select("doc_id", "x.a", "x.b")


@query(f"SELECT DISTINCT item_id, array_to_string(w[1:k], ' ') AS prefix FROM (SELECT item_id, w, unnest([9, 16, 24]) AS k FROM ({words_sql('benchmark', 'item_id')}) WHERE len(w) > 0)")
def query_prefixes(spark, d):
    w = tokens.with_words(table(spark, d, "benchmark"), "item_id")
    return w.select("item_id", F.explode(spans.prefixes(F.col("w"))).alias("prefix"))


@query(
    """SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE WHEN m > 0 THEN CAST(round(x / m * 127) AS INTEGER) ELSE 0 END), ',') AS q FROM (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS m
FROM (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS v FROM embeddings))"""
)
def quantised_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(spans.quantised(F.col("embedding"), 32), ",").alias("q"))


@query(
    """SELECT doc_id, count(*) FILTER (regexp_matches(w, '[.!?…]["''»”’)\\]]*$')) AS ends, count(*) AS words FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY doc_id"""
)
def sentence_ends(spark, d):
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), lambda x: x != "")
    rows = table(spark, d, "documents").select("doc_id", F.explode(w).alias("w"))
    return rows.groupBy("doc_id").agg(F.count_if(T.sentence_end(F.col("w"))).alias("ends"), F.count("*").alias("words"))


@query(
    f"""SELECT f.item_id, t.doc_id FROM (SELECT item_id, ' ' || array_to_string(w[4:9], ' ') || ' ' AS f FROM ({words_sql('benchmark', 'item_id')}) WHERE len(w) >= 9) f
JOIN (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM ({words_sql('documents', 'doc_id')})) t ON contains(t.t, f.f)"""
)
def containing_texts(spark, d):
    w = tokens.with_words(table(spark, d, "benchmark"), "item_id").filter(F.size("w") >= 9)
    return spans.containing(w.select("item_id", F.array_join(F.slice("w", 4, 6), " ").alias("text")), table(spark, d, "documents"), "item_id", "doc_id")


@query(
    """SELECT o_orderkey, o_orderstatus AS sig, CASE WHEN o_orderstatus = r.sig THEN verdict END AS verdict, coalesce(o_orderstatus <> r.sig, false) AS stale
FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_linestatus) AS sig, min(l_returnflag) AS verdict FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) r ON k = o_orderkey"""
)
def current_reviews(spark, d):
    r = table(spark, d, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("sig"), F.min("l_returnflag").alias("verdict"))
    return spans.current_reviews(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("sig")), r, "o_orderkey")


@query(
    """SELECT q, unit, exact FROM (SELECT a.o_orderkey AS q, u.p_partkey AS unit, a.number = u.number AS exact FROM (SELECT o_orderkey, o_custkey % 5 AS book, o_custkey % 300 AS number, o_custkey % 300 // 3 AS base FROM orders) a
JOIN (SELECT p_partkey, p_partkey % 5 AS book, p_partkey * 7 % 300 AS number, p_partkey * 7 % 300 // 3 AS base FROM part) u ON a.book = u.book AND a.base = u.base) QUALIFY row_number() OVER (PARTITION BY q ORDER BY exact DESC, unit) = 1"""
)
def by_printed_number(spark, d):
    asked = table(spark, d, "orders").selectExpr("o_orderkey AS q", "o_custkey % 5 AS book", "o_custkey % 300 AS number", "o_custkey % 300 div 3 AS base")
    units = table(spark, d, "part").selectExpr("p_partkey AS unit", "p_partkey % 5 AS book", "p_partkey * 7 % 300 AS number", "p_partkey * 7 % 300 div 3 AS base")
    return spans.by_printed_number(asked, units, "q", "book")


@query(
    """SELECT r.key, CAST(count(*) AS INTEGER) AS n, string_agg(u.role, ' * ' ORDER BY u.turn) AS text FROM (SELECT DISTINCT conv_id AS key, conv_id, 1 AS first, 3 AS last FROM conversations) r
JOIN (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL) u ON u.conv_id = r.conv_id AND u.turn BETWEEN first AND last GROUP BY r.key"""
)
def unit_texts(spark, d):
    c = table(spark, d, "conversations")
    ranges = c.select(F.col("conv_id").alias("key"), "conv_id", F.lit(1).cast("long").alias("first"), F.lit(3).cast("long").alias("last")).distinct()
    return spans.unit_texts(ranges, c.groupBy("conv_id", F.col("turn").cast("long").alias("unit")).agg(F.min("role").alias("text")), "key", "conv_id")


@query(
    f"""WITH t AS (SELECT DISTINCT item_id, tok FROM ({tokens_sql('benchmark', 'item_id')})), n AS (SELECT ln(count(*)) AS l FROM benchmark), i AS (SELECT tok, any_value(l) - ln(count(*)) AS idf FROM t, n GROUP BY tok),
p AS (SELECT item_id AS a, item_id + 1 AS b FROM benchmark WHERE item_id + 1 IN (SELECT item_id FROM benchmark)), w AS (SELECT item_id, sum(idf) AS whole FROM t JOIN i USING (tok) GROUP BY item_id),
x AS (SELECT a, b, sum(idf) AS s FROM p JOIN t ta ON ta.item_id = a JOIN t tb ON tb.item_id = b AND tb.tok = ta.tok JOIN i ON i.tok = ta.tok GROUP BY ALL)
SELECT a, b, round(CASE WHEN whole > 0 THEN coalesce(s, 0) / whole ELSE 0 END, 5) AS share FROM p JOIN w ON w.item_id = a LEFT JOIN x USING (a, b)"""
)
def idf_share(spark, d):
    b = table(spark, d, "benchmark")
    ids = b.select("item_id").distinct()
    pairs = ids.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b")).join(ids.withColumnRenamed("item_id", "b"), "b", "left_semi").select("a", "b")
    n = b.count()
    idf = tokens.document_frequency(b, "item_id").select("tok", (F.log(F.lit(float(n))) - F.log("df")).alias("idf"))
    return spans.idf_share(pairs, tokens.tokens(b, "item_id").select("item_id", "tok").distinct(), idf, "a", "b", "item_id")


@query(f"SELECT doc_id, item_id, votes, rank FROM (SELECT doc_id, item_id, CAST(sum(n) AS BIGINT) AS votes, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sum(n) DESC, item_id) AS INTEGER) AS rank FROM ({_HITS}) GROUP BY doc_id, item_id) WHERE rank <= 3")
def gram_votes(spark, d):
    return spans.gram_votes(_hits(spark, d), "doc_id", "item_id")


@query(
    """SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_partkey % 6 AS rare, CAST(l_quantity AS DOUBLE) AS score FROM lineitem) WHERE rare >= 3 AND score >= 16 AND (rare >= 4 OR score >= 20)"""
)
def strong_matches(spark, d):
    m = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 6 AS rare", "CAST(l_quantity AS DOUBLE) AS score")
    return spans.strong_matches(m).select("l_orderkey", "l_linenumber")


_TOP = "SELECT l_orderkey % 50 AS doc, l_linenumber AS win, l_partkey % 4 AS pid, CAST(row_number() OVER (PARTITION BY l_orderkey % 50, l_linenumber ORDER BY count(*) DESC, l_partkey % 4) AS INTEGER) AS rank FROM lineitem GROUP BY 1, 2, 3"


@query(
    f"""WITH t AS ({_TOP}) SELECT doc, win, pid, EXISTS (SELECT 1 FROM t y WHERE y.doc = x.doc AND abs(y.win - x.win) = 1 AND y.pid = x.pid AND y.rank <= 2) AS agrees FROM t x WHERE rank = 1"""
)
def agreeing_windows(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey % 50 AS doc", "l_linenumber AS win", "l_partkey % 4 AS pid").groupBy("doc", "win", "pid").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("doc", "win").orderBy(F.desc("n"), "pid"))
    return spans.agreeing_windows(rows.withColumn("rank", rank), "doc", "win", "pid", 2)


SWEEP = [5.0, 10.0, 20.0, 30.0, 45.0, 60.0]


@query(
    f"""SELECT threshold, count(*) FILTER (s >= threshold) AS found, count(*) FILTER (s >= threshold AND t) AS "right", round(count(*) FILTER (s >= threshold AND t) / nullif(count(*) FILTER (s >= threshold), 0), 6) AS "precision",
round(count(*) FILTER (s >= threshold AND t) / nullif(count(*) FILTER (t), 0), 6) AS recall FROM (SELECT CAST(l_quantity AS DOUBLE) AS s, l_returnflag = 'R' AS t FROM lineitem), (SELECT unnest({SWEEP}::DOUBLE[]) AS threshold) GROUP BY threshold"""
)
def threshold_sweep(spark, d):
    return spans.threshold_sweep(table(spark, d, "lineitem").withColumn("s", F.col("l_quantity").cast("double")), SWEEP, "s", F.col("l_returnflag") == "R")


@query(
    f"""SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY back, i) - 1 AS INTEGER) AS pos, w, back FROM (SELECT item_id, pos AS back, i, p[i] AS w FROM (SELECT item_id, pos, p, unnest(range(1, len(p) + 1)) AS i
FROM (SELECT item_id, pos, list_filter(string_split(CASE WHEN pos % 10 = 0 THEN tok || ' ' || tok WHEN pos % 10 = 5 THEN '' ELSE tok END, ' '), lambda x: x <> '') AS p FROM ({tokens_sql('benchmark', 'item_id')}))))"""
)
def corrected_words(spark, d):
    t = tokens.tokens(table(spark, d, "benchmark"), "item_id").select("item_id", F.col("pos").cast("long").alias("pos"), F.col("tok").alias("w"))
    twice = F.when(F.col("pos") % 10 == 0, F.concat_ws(" ", "w", "w")).otherwise("")
    return spans.corrected(t, t.filter("pos % 5 = 0").select("item_id", "pos", twice.alias("w")), "item_id")


_E = "SELECT event_id AS id, user_id AS key, CAST(floor(value * 3) AS DOUBLE) AS s, CAST(floor(value * 3) AS DOUBLE) + 2 AS e FROM events WHERE event_id % 2 = {}"


@query(f"SELECT id, key FROM ({_E.format(1)}) x WHERE NOT EXISTS (SELECT 1 FROM ({_E.format(0)}) y WHERE y.key = x.key AND x.s <= y.e + 1.5 AND y.s <= x.e + 1.5)")
def only_second(spark, d):
    e = table(spark, d, "events").selectExpr("event_id AS id", "user_id AS key", "CAST(floor(value * 3) AS DOUBLE) AS s", "CAST(floor(value * 3) AS DOUBLE) + 2 AS e")
    return spans.only_second(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), "key").select("id", "key")


@query(
    """SELECT l_shipmode, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n, round(sum(k) / sum(n), 6) AS pooled, round(avg(k / n), 6) AS mean, round(min(k / n), 6) AS least, round(max(k / n), 6) AS most
FROM (SELECT l_shipmode, l_suppkey, count(*) FILTER (l_returnflag = 'N') AS k, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_shipmode""".replace("l_shipmode", "l_linenumber")
)
def share_summary(spark, d):
    return spans.share_summary(table(spark, d, "lineitem"), ["l_linenumber"], ["l_suppkey"], F.col("l_returnflag") == "N")


@query("SELECT event_id, coalesce(v, lead(v) OVER (PARTITION BY user_id ORDER BY event_id)) AS filled FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 > 0 THEN event_id END AS v FROM events)")
def next_filled(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 > 0, F.col("event_id")))
    return spans.next_filled(e, "user_id", "event_id", "v").select("event_id", "filled")


_WIN = f"SELECT doc_id, i * 20 AS a, array_to_string(s[i * 20 + 1 : i * 20 + 40], ' ') AS stems FROM (SELECT doc_id, s, unnest(range(0, CAST(greatest(0, ceil((len(s) - 40) / 20)) AS BIGINT) + 1)) AS i FROM (SELECT doc_id, list(stem ORDER BY pos) AS s FROM ({stem_rel(tokens_sql('documents', 'doc_id'))}) GROUP BY doc_id))"


@query(f"SELECT doc_id, CAST(a AS INTEGER) AS a, md5(stems) AS stems FROM ({_WIN})")
def stem_windows(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id").filter(F.size("w") > 0).select("doc_id", F.transform("w", T.stem_en).alias("s"))
    last = F.greatest(F.lit(0), F.ceil((F.size("s") - 40) / 20)).cast("int")
    rows = w.select("doc_id", "s", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return rows.select("doc_id", (F.col("i") * 20).alias("a"), F.md5(F.array_join(F.slice("s", F.col("i") * 20 + 1, 40), " ").cast("binary")).alias("stems"))


@query(
    """WITH v AS (SELECT vec_id % 20 AS tok, 1.0 / (1 + vec_id % 20) AS weight, CAST(embedding[1:8] AS DOUBLE[]) AS x FROM embeddings WHERE vec_id < 20), w AS (SELECT user_id, event_id % 23 AS tok FROM events WHERE user_id < 40),
s AS (SELECT user_id, i, sum(weight * x[i]) AS s, count(*) AS n FROM (SELECT user_id, weight, x, unnest(range(1, 9)) AS i FROM w JOIN v USING (tok)) GROUP BY ALL)
SELECT user_id, max(n) AS known, CASE WHEN max(n) >= 2 THEN round(max(s) FILTER (i = 1) / sqrt(sum(s * s)), 5) END AS x0 FROM s GROUP BY user_id"""
)
def weighted_vectors(spark, d):
    v = table(spark, d, "embeddings").filter("vec_id < 20").select((F.col("vec_id") % 20).alias("tok"), (1.0 / (1 + F.col("vec_id") % 20)).alias("weight"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("vector"))
    w = table(spark, d, "events").filter("user_id < 40").select("user_id", (F.col("event_id") % 23).alias("tok"))
    return spans.weighted_vectors(w, v, "user_id").select("user_id", "known", F.round(F.get("vector", F.lit(0)), 5).alias("x0"))


