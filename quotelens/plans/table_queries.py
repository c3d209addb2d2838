"""Queries over vectors, intervals, events, ledgers, sources and relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotelens.functions import text as T
from quotelens.operators import evaluate, intervals, ledger, retrieval, seeds, tokens
from quotelens.plans.registry import query, table, tokens_sql, words_sql
from quotelens.sources import ingest, sinks
from quotelens.streaming import streams

_COS = "round(list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v))), 5)"
_VEC = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_DENSE = f"""SELECT q.vec_id AS q_id, p.vec_id, {_COS} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, p.vec_id) AS INTEGER) AS rank
FROM ({_VEC}) q JOIN ({_VEC}) p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10"""


def _queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding")


@query(_DENSE)
def dense_topk(spark, d):
    return retrieval.dense_topk(_queries(spark, d), table(spark, d, "embeddings"), 10)


@query(
    f"""WITH a AS ({_DENSE}), b AS (SELECT q_id, vec_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY vec_id) AS INTEGER) AS r2 FROM a QUALIFY r2 <= 5)
SELECT q_id, vec_id, round(sum(part), 6) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY round(sum(part), 6) DESC, vec_id) AS INTEGER) AS rank
FROM (SELECT q_id, vec_id, 1.0 / (60 + rank - 1) AS part FROM a UNION ALL SELECT q_id, vec_id, 1.0 / (60 + r2 - 1) FROM b) GROUP BY q_id, vec_id QUALIFY rank <= 8"""
)
def rrf_fusion(spark, d):
    a = dense_topk(spark, d)
    b = a.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("vec_id"))).filter("rank <= 5")
    return retrieval.fuse([a, b], "q_id", "vec_id", 8)


@query(
    f"""WITH v AS ({_VEC}), q AS (SELECT vec_id // 100 AS q_id, vec_id AS word, 1.0 + vec_id % 3 AS idf, v FROM v WHERE vec_id % 100 = 0)
SELECT q_id, label, round(sum(idf * m) / sum(idf), 5) AS score FROM (SELECT q_id, word, idf, p.label, max(list_dot_product(q.v, p.v)) AS m FROM q, v p WHERE p.label IS NOT NULL GROUP BY ALL) GROUP BY q_id, label"""
)
def maxsim_rerank(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.floor(F.col("vec_id") / 100).alias("q_id"), F.col("vec_id").alias("word"), (1.0 + F.col("vec_id") % 3).alias("idf"), F.col("embedding").alias("vec"))
    p = e.filter("label is not null").select("label", F.col("vec_id").alias("word"), F.col("embedding").alias("vec"))
    pairs = q.select("q_id").distinct().crossJoin(F.broadcast(p.select("label").distinct()))
    return retrieval.max_sim(pairs, q, p, "q_id", "label")



def _seconds():
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6


_EV = "SELECT event_id AS id, user_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 600 + value AS e, event_type FROM events"


def _spans(spark, d, kind=None):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", _seconds().alias("s"), (_seconds() + 600 + F.col("value")).alias("e"), "event_type")
    return e.filter(F.col("event_type") == kind) if kind else e


@query(
    f"""SELECT a.user_id, a.id AS id_a, b.id AS id_b, round((least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s), 4) AS share
FROM ({_EV}) a JOIN ({_EV}) b ON a.user_id = b.user_id AND a.id < b.id AND a.s < b.e AND b.s < a.e"""
)
def overlap_pairs(spark, d):
    x = _spans(spark, d)
    return intervals.overlap_pairs(x, x, "user_id", 3600.0).filter("id_a < id_b").select("user_id", "id_a", "id_b", F.round(intervals.overlap_share("s_a", "e_a", "s_b", "e_b"), 4).alias("share"))


_ASOF = """SELECT l.event_id, l.user_id, CAST(r.event_id AS VARCHAR) AS found, round(epoch_us(l.ts) / 1e6 - epoch_us(r.ts) / 1e6, 3) AS gap
FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts >= r.ts"""


def _asof(spark, d, after):
    e = table(spark, d, "events").withColumn("at", _seconds())
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "at")
    right = e.filter("event_type = 'click'").groupBy("user_id", "at").agg(F.max("event_id").cast("string").alias("click"))
    return intervals.asof(left, right, "user_id", "at", "click", after=after).select("event_id", "user_id", F.col("click_found").alias("found"), F.round("gap", 3).alias("gap"))


@query(_ASOF)
def asof_last_event(spark, d):
    return _asof(spark, d, False)


@query(_ASOF.replace("l.ts >= r.ts", "l.ts <= r.ts").replace("round(epoch_us(l.ts) / 1e6 - epoch_us(r.ts) / 1e6, 3)", "round(epoch_us(r.ts) / 1e6 - epoch_us(l.ts) / 1e6, 3)"))
def asof_next_event(spark, d):
    return _asof(spark, d, True)


@query(
    f"""WITH b AS ({_ASOF}), a AS ({_ASOF.replace('l.ts >= r.ts', 'l.ts <= r.ts').replace('round(epoch_us(l.ts) / 1e6 - epoch_us(r.ts) / 1e6, 3)', 'round(epoch_us(r.ts) / 1e6 - epoch_us(l.ts) / 1e6, 3)')})
SELECT event_id, CASE WHEN b.gap IS NULL AND a.gap IS NULL THEN 'none' WHEN a.gap IS NULL OR b.gap <= a.gap THEN 'before' ELSE 'after' END AS side,
CASE WHEN a.gap IS NULL OR b.gap <= a.gap THEN b.found ELSE a.found END AS found FROM b JOIN a USING (event_id)"""
)
def attribution_nearest(spark, d):
    b = asof_last_event(spark, d).select("event_id", F.col("found").alias("fb"), F.col("gap").alias("gb"))
    a = asof_next_event(spark, d).select("event_id", F.col("found").alias("fa"), F.col("gap").alias("ga"))
    first = F.col("ga").isNull() | F.coalesce(F.col("gb") <= F.col("ga"), F.lit(False))
    side = F.when(F.col("gb").isNull() & F.col("ga").isNull(), "none").when(first, "before").otherwise("after")
    return b.join(a, "event_id").select("event_id", side.alias("side"), F.when(first, F.col("fb")).otherwise(F.col("fa")).alias("found"))


@query(
    """SELECT user_id, session, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, sum(CASE WHEN epoch_us(ts) - prev > 21600000000 THEN 1 ELSE 0 END)
OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS prev FROM events)) GROUP BY user_id, session"""
)
def session_gaps(spark, d):
    e = intervals.sessions(table(spark, d, "events"), "user_id", _seconds(), 21600.0, ["ts", "event_id"])
    return e.groupBy("user_id", "session").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query(
    f"""WITH e AS (SELECT user_id, CAST(floor(s) AS BIGINT) AS s, CAST(floor(e) AS BIGINT) AS e FROM ({_EV}))
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM (SELECT *, sum(CASE WHEN s > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)) GROUP BY user_id, g"""
)
def merge_ranges(spark, d):
    e = _spans(spark, d).select("user_id", F.floor("s").alias("s"), F.floor("e").alias("e"))
    return intervals.merge_ranges(e, "user_id")


@query(
    """WITH e AS (SELECT user_id, (epoch_us(ts) / 1e6 - 1704067200) / 1000 AS s, (epoch_us(ts) / 1e6 - 1704067200) / 1000 + 1 AS e FROM events),
g AS (SELECT *, greatest(s - coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS gap FROM e),
m AS (SELECT user_id, greatest(max(gap), 2700 - max(e)) AS gap FROM g GROUP BY user_id)
SELECT user_id, round(gap, 4) AS gap, gap > least(120, greatest(60, 0.2 * 2700)) AS silent FROM m"""
)
def silence_gaps(spark, d):
    s = (_seconds() - 1704067200) / 1000
    e = table(spark, d, "events").select("user_id", s.alias("s"), (s + 1).alias("e"))
    return intervals.longest_silence(e, "user_id", "s", "e", F.lit(2700.0)).withColumn("gap", F.round("gap", 4))


@query(
    """SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b, count(*) AS n FROM (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 4 <> 0)) GROUP BY l_orderkey, g"""
)
def digest_segments(spark, d):
    return intervals.islands(table(spark, d, "lineitem").filter("l_linenumber % 4 <> 0"), ["l_orderkey"], "l_linenumber")


_CONV = tokens_sql("conversations", "conv_id || '-' || turn AS key").replace("FROM (SELECT conv_id || '-' || turn AS key, w, unnest", "FROM (SELECT key, w, unnest").replace("SELECT conv_id || '-' || turn AS key, k - 1", "SELECT key, k - 1")
_CLS = f"""SELECT key, pos, CASE WHEN ta IS NULL OR tb IS NULL THEN 'ONLY_ONE_COVERS' WHEN ta = tok AND tb = tok THEN 'BOTH_EXACT' WHEN ta = tok OR tb = tok THEN 'ONE_EXACT'
 WHEN ta = tb THEN 'BOTH_DIFFER_SAME' ELSE 'BOTH_DIFFER_DIFFERENT' END AS class FROM
 (SELECT key, pos, tok, CASE WHEN pos % 7 = 3 THEN NULL WHEN pos % 5 = 2 THEN tok || 'x' ELSE tok END AS ta, CASE WHEN pos % 11 = 4 THEN NULL WHEN pos % 10 = 2 THEN tok || 'x' WHEN pos % 6 = 1 THEN tok || 'y' ELSE tok END AS tb FROM ({_CONV})) WHERE ta IS NOT NULL OR tb IS NOT NULL"""


def _agreement(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "text")
    t = tokens.tokens(c, "key")
    a = t.filter("pos % 7 <> 3").withColumn("tok", F.when(F.expr("pos % 5 = 2"), F.concat("tok", F.lit("x"))).otherwise(F.col("tok")))
    b = t.filter("pos % 11 <> 4").withColumn("tok", F.when(F.expr("pos % 10 = 2"), F.concat("tok", F.lit("x"))).when(F.expr("pos % 6 = 1"), F.concat("tok", F.lit("y"))).otherwise(F.col("tok")))
    return ledger.agreement(a, b, ["key"], truth=t)


@query(_CLS)
def agreement_classes(spark, d):
    return _agreement(spark, d).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""SELECT *, CASE WHEN differ_same > 0 THEN 'differs' WHEN one_exact + differ_different + only_one = 0 THEN 'confirmed' WHEN differ_different > 0 THEN 'unresolved' ELSE 'raised' END AS verdict
FROM (SELECT key, count(*) FILTER (class = 'BOTH_EXACT') AS both_exact, count(*) FILTER (class = 'ONE_EXACT') AS one_exact, count(*) FILTER (class = 'BOTH_DIFFER_SAME') AS differ_same,
count(*) FILTER (class = 'BOTH_DIFFER_DIFFERENT') AS differ_different, count(*) FILTER (class = 'ONLY_ONE_COVERS') AS only_one FROM ({_CLS}) GROUP BY key)"""
)
def agreement_verdicts(spark, d):
    return ledger.agreement_verdict(_agreement(spark, d), ["key"])


def _matches(spark, d):
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    n = b.count()
    c = seeds.topk_region(seeds.accepted_seeds(seeds.seed_clusters(seeds.seed_hits(docs, b, n))))
    return ledger.verify(c, docs, b, n)


@query()
def align_verdicts(spark, d):
    return _matches(spark, d)


@query()
def quotation_ledger(spark, d):
    return ledger.group(_matches(spark, d))


@query("""SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT doc_id) AS docs FROM documents GROUP BY ROLLUP (lang, source)""")
def summary_rollup(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("doc_id").alias("docs"))


_W = """SELECT lang, k, n, round(k / n, 6) AS share,
CASE WHEN n = 0 THEN 0.0 ELSE round(100 * greatest((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 0), 0) END AS lo,
CASE WHEN n = 0 THEN 100.0 ELSE round(100 * least((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 1), 0) END AS hi
FROM (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)"""


@query(_W)
def wilson_share(spark, d):
    return evaluate.shares(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), ["lang"], F.col("quality") == 1)


@query(
    """SELECT *, round(CASE WHEN p + r > 0 THEN 2 * p0 * r0 / (p0 + r0) END, 6) AS f FROM (SELECT l_returnflag, tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS p0, tp / nullif(tp + fn, 0) AS r0, round(tp / nullif(tp + fp, 0), 6) AS p, round(tp / nullif(tp + fn, 0), 6) AS r
FROM (SELECT l_returnflag, CAST(sum(least(g, t)) AS BIGINT) AS tp, CAST(sum(greatest(t - g, 0)) AS BIGINT) AS fp, CAST(sum(greatest(g - t, 0)) AS BIGINT) AS fn, count(*) FILTER (g = 0 AND t = 0) AS tn
FROM (SELECT l_returnflag, l_linenumber % 3 AS g, l_orderkey % 3 AS t FROM lineitem) GROUP BY l_returnflag))""".replace("SELECT *, round", "SELECT l_returnflag, tp, fp, fn, tn, p, r, round")
)
def prf_counts(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 3).cast("long").alias("g"), (F.col("l_orderkey") % 3).cast("long").alias("t"))
    return evaluate.prf(x, ["l_returnflag"], "g", "t")


@query("""SELECT o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE k = floor(0.9 * (n - 1))""")
def nearest_rank(spark, d):
    return evaluate.nearest_rank(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 0.9)


@query(
    """SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1"""
)
def mode_first_seen(spark, d):
    return evaluate.mode_first(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query(
    """SELECT event_id, CASE WHEN regexp_matches(c, '^[=+@\\t\\r-]') THEN '''' || c ELSE c END AS cell FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || event_type AS c FROM events)"""
)
def csv_guard(spark, d):
    c = F.concat(F.when(F.expr("event_id % 4 = 0"), "=").when(F.expr("event_id % 4 = 1"), "-").when(F.expr("event_id % 4 = 2"), "@").otherwise(""), "event_type")
    return table(spark, d, "events").select("event_id", T.csv_guard(c).alias("cell"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    """SELECT event_id, CASE WHEN h > 0 THEN h || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ':' || lpad(CAST(s AS VARCHAR), 2, '0') ELSE m || ':' || lpad(CAST(s AS VARCHAR), 2, '0') END AS clock
FROM (SELECT event_id, v // 3600 AS h, v % 3600 // 60 AS m, v % 60 AS s FROM (SELECT event_id, event_id * 37 % 9000 AS v FROM events))"""
)
def clock_format(spark, d):
    return table(spark, d, "events").select("event_id", T.clock(F.expr("event_id * 37 % 9000")).alias("clock"))


def _timed(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "text")
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    times = F.transform(w, lambda x, i: F.struct(x.alias("w"), (i * 0.5 + F.floor(i / 17) * 2.0).alias("start"), (i * 0.5 + F.floor(i / 17) * 2.0 + 0.4).alias("end")))
    return c.select("key", times.alias("words"))


@query()
def paragraphs(spark, d):
    return sinks.paragraphs(_timed(spark, d), "key", "words")


@query()
def srt_cues(spark, d):
    return sinks.srt_cues(_timed(spark, d), "key", "words")


@query()
def subtitle_words(spark, d):
    cues = srt_cues(spark, d).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "srt"))), lambda x: x["srt"]), "\n\n").alias("body"))
    return ingest.subtitle_words(cues, "key", "body")


@query(f"SELECT key, CAST(len(w) AS INTEGER) AS n FROM (SELECT conv_id || '-' || turn AS key, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM conversations)")
def plain_words(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.size(ingest.plain_words(F.col("text"))).alias("n"))


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(*) > 3 AS over FROM events GROUP BY ALL")
def quota_tumbling(spark, d):
    return streams.quota(table(spark, d, "events"))


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY ALL HAVING count(*) > 2")
def quota_over_cap(spark, d):
    return streams.quota(table(spark, d, "events"), width="1 day", cap=2).filter("over")


@query(
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 60 MINUTE AS end, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts >= prev + INTERVAL 60 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, s""".replace(" AS end", ' AS "end"')
)
def user_sessions(spark, d):
    return streams.user_sessions(table(spark, d, "events"))


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM (SELECT * FROM events UNION ALL SELECT * FROM events)) GROUP BY event_type")
def stream_dedup(spark, d):
    e = table(spark, d, "events")
    return streams.first_of_each(e.unionByName(e), "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000""")
def set_ops(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    some = c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")
    return some.exceptAll(some.join(o.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")).distinct()


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o.filter("o_totalprice > 300000"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_nationkey")


@query(
    """SELECT n_name, l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name, l_returnflag), (n_name), ())"""
)
def grouping_sets(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.groupingSets([["n_name", "l_returnflag"], ["n_name"], []], "n_name", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("""SELECT o_orderkey, o_custkey, c_nationkey, coalesce(n_name, 'none') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def dimension_lookup(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return o.select("o_orderkey", "o_custkey", "c_nationkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


@query(f"SELECT doc_id, CAST(floor((coalesce(sum(len(w)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / 20000) AS BIGINT) AS shard FROM ({words_sql('documents', 'doc_id')})")
def shard_ids(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id").select("doc_id", F.size("w").alias("n"))
    return sinks.shard_ids(w, "doc_id", "n", 20000).select("doc_id", "shard")


@query(f"SELECT item_id, CASE WHEN len(w) > 10 THEN '… ' || array_to_string(w[7:16], ' ') || CASE WHEN len(w) > 16 THEN ' …' ELSE '' END END AS excerpt FROM ({words_sql('benchmark', 'item_id')})")
def excerpt(spark, d):
    w = tokens.with_words(table(spark, d, "benchmark"), "item_id")
    return w.select("item_id", F.when(F.size("w") > 10, T.excerpt(F.col("w"), F.lit(10))).alias("excerpt"))


@query()
def noisy_tokens(spark, d):
    return evaluate.noisy(tokens.tokens(table(spark, d, "benchmark"), "item_id"), "item_id", 101, 0.05, 0.1)

