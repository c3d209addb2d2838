"""Queries over verdicts, cues, attributions and entries of a ledger, with their SQL.

Rows of counts, entries and gradings are made from the columns of the relations, since the tables hold
no ledger; the expressions that make them stand in one place and are the same for both engines.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotelens.functions import text as T
from quotelens.operators import cues, evidence, tokens
from quotelens.plans.registry import query, table, tokens_sql, words_sql

#: Counts of a match, from a row of lineitem (k, q, d, x are whole numbers of 0 or more).
_COUNTS = {
    "asr": "k % 3", "near": "(k + q) % 2", "joined": "q % 2", "diff": "CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END", "ins": "CASE WHEN q % 9 = 0 THEN 1 ELSE 0 END", "del": "CASE WHEN x % 7 = 0 THEN 1 ELSE 0 END",
    "matched": "3 + q % 20", "inf": "1 + q % 13", "evidence": "CAST(x % 40 AS DOUBLE)", "d_q": "CAST(30 + k % 71 AS DOUBLE) / 100", "d_changed": "CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END",
    "d_cols": "4 + q % 20", "d_run": "1 + (k + x) % 6", "d_matched": "3 + q % 20", "d_inf": "1 + q % 13", "d_content": "(k + q) % 6", "d_evidence": "CAST(x % 40 AS DOUBLE) + 1",
    "d_content_evidence": "CAST(x % 40 AS DOUBLE) / 2", "canonical": "k % 2 = 0", "book": "k % 6 = 1", "cue": "x % 3 = 0", "near_cue": "x % 6 = 0", "bracket": "q % 5 = 0", "direct": "x % 3 = 0", "starts": "q % 2 = 0",
    "whole": "k % 5 = 0", "closed": "q % 3 > 0", "anchored": "x % 11 = 0", "formula": "x % 13 = 0", "chain": "x % 17 = 0", "comment": "q % 19 = 0", "open_tail": "x % 2",
}
_M = f"SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {n}' for n, e in _COUNTS.items())} FROM (SELECT l_orderkey, l_linenumber, l_partkey AS k, CAST(l_quantity AS BIGINT) AS q, l_suppkey + l_orderkey AS x FROM lineitem)"


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN inf < 2 OR chain OR comment OR (formula AND canonical) THEN 'reject'
 WHEN NOT formula AND head AND d_inf - tail >= 5 AND d_content >= min_c AND ev >= e_min THEN told
 WHEN NOT formula AND head AND canonical AND whole AND cue AND d_evidence >= 2.5 THEN told
 WHEN NOT formula AND d_q >= 0.55 AND d_run >= 3 AND d_inf - tail >= 6 AND d_content >= min_c AND ev >= 1.25 * e_min THEN 'partial'
 WHEN NOT formula AND NOT canonical AND NOT book AND direct AND ins + diff + del + asr + near = 0 AND evidence >= 5 AND closed AND (starts OR (inf >= 3 AND evidence >= 12)) THEN CASE WHEN whole THEN 'verbatim' ELSE 'partial' END
 WHEN NOT formula AND NOT anchored AND d_q >= 0.4 AND d_run >= 3 AND d_inf - tail >= 5 AND d_content >= min_c AND ev >= 1.5 * e_min THEN 'lead'
 WHEN NOT canonical AND NOT book AND NOT anchored AND ins + diff + del + asr + near = 0 AND inf >= 5 AND evidence >= 16 THEN 'echo' ELSE 'reject' END AS status
FROM (SELECT *, CASE WHEN book THEN open_tail ELSE 0 END AS tail, d_q >= 0.86 AND d_changed <= 0.1 * d_cols AND d_run >= least(4, d_matched) AS head,
 CASE WHEN ins + diff + del = 0 AND asr + near <= 0.2 * matched THEN 'verbatim' ELSE 'partial' END AS told, CASE WHEN canonical THEN CASE WHEN cue THEN 7 ELSE 16 END ELSE CASE WHEN cue THEN 12 ELSE 20 END END AS e_min,
 CASE WHEN near_cue OR bracket OR (canonical AND ins + diff + del + asr + near + joined = 0) THEN 2 ELSE 3 END AS min_c,
 CASE WHEN cue OR bracket OR NOT canonical THEN d_evidence ELSE d_content_evidence + 0.5 * (d_evidence - d_content_evidence) END AS ev FROM ({_M}))"""
)
def verdict_table(spark, d):
    m = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey AS k", "CAST(l_quantity AS BIGINT) AS q", "l_suppkey + l_orderkey AS x")
    m = m.selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in _COUNTS.items()])
    return m.select("l_orderkey", "l_linenumber", evidence.verdicts(m).alias("status"))


STRONG, WEAK = ["that", "was"], ["the", "of", "and", "in"]
_IN = lambda words: ", ".join(f"'{w}'" for w in words)


@query(
    f"""SELECT doc_id, round(share, 6) AS share, share >= 0.34 AS chain FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE
(2 * len(list_filter(w, lambda x: x IN ({_IN(STRONG)}))) + len(list_filter(w, lambda x: x IN ({_IN(WEAK)})))) / len(w) END AS share FROM ({words_sql('documents', 'doc_id')}))"""
)
def chain_filter(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id")
    share = evidence.lexicon_share(F.col("w"), STRONG, WEAK)
    return w.select("doc_id", F.round(share, 6).alias("share"), evidence.is_chain(F.col("w"), STRONG, WEAK).alias("chain"))


@query(
    """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN wo AND fab THEN 'weak' WHEN wo THEN 'mush' WHEN fab THEN 'weakmention' END, CASE WHEN agrees = false THEN 'attr' END, CASE WHEN tail THEN 'tail' END,
CASE WHEN spoken THEN 'grade' END, CASE WHEN NOT wo AND textual AND graded THEN 'dweak' END], lambda x: x IS NOT NULL), ',') AS flags
FROM (SELECT *, l_returnflag = 'R' AS wo, l_linestatus = 'F' AS fab, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 3 = 1 END AS agrees, l_suppkey % 4 = 0 AS tail, l_orderkey % 5 = 0 AS spoken, l_linenumber < 4 AS textual, l_partkey % 2 = 0 AS graded FROM lineitem)"""
)
def alert_flags(spark, d):
    c = F.col
    agrees = F.when(c("l_partkey") % 3 != 0, c("l_partkey") % 3 == 1)
    flags = evidence.alert_flags(c("l_returnflag") == "R", c("l_linestatus") == "F", agrees, c("l_suppkey") % 4 == 0, c("l_orderkey") % 5 == 0, c("l_linenumber") < 4, c("l_partkey") % 2 == 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(flags, ",").alias("flags"))


_G = "SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_partkey % 6 WHEN 0 THEN 'sahih' WHEN 1 THEN 'hasan' WHEN 2 THEN 'weak' WHEN 3 THEN 'hasan sahih' ELSE 'mursal' END AS grade FROM lineitem"


@query(
    f"""WITH g AS (SELECT *, CASE WHEN regexp_matches(grade, 'weak') THEN 'weak' WHEN regexp_matches(grade, 'sahih|hasan') THEN 'strong' ELSE 'neutral' END AS c FROM ({_G})),
m AS (SELECT l_orderkey, c, grade FROM (SELECT l_orderkey, c, grade, count(*) AS n, min(l_linenumber) AS f FROM g WHERE c <> 'neutral' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_orderkey, c ORDER BY n DESC, f, grade DESC) = 1),
j AS (SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS judges FROM (SELECT l_orderkey, c, count(DISTINCT l_suppkey) AS n FROM g WHERE c <> 'neutral' GROUP BY ALL) GROUP BY ALL),
s AS (SELECT l_orderkey, max(grade) FILTER (c = 'strong') AS st, max(grade) FILTER (c = 'weak') AS wk FROM m GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN st IS NOT NULL AND wk IS NOT NULL THEN 'mixed' WHEN st IS NOT NULL THEN 'strong' WHEN wk IS NOT NULL THEN 'weak' ELSE 'none' END AS kind,
CASE WHEN st IS NOT NULL AND wk IS NOT NULL THEN st || ' / ' || wk ELSE coalesce(st, wk) END AS grade, coalesce(judges, 0) AS judges
FROM (SELECT DISTINCT l_orderkey FROM g) LEFT JOIN s USING (l_orderkey) LEFT JOIN j USING (l_orderkey)"""
)
def grade_summary(spark, d):
    word = "CASE l_partkey % 6 WHEN 0 THEN 'sahih' WHEN 1 THEN 'hasan' WHEN 2 THEN 'weak' WHEN 3 THEN 'hasan sahih' ELSE 'mursal' END AS grade"
    g = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", word)
    return evidence.grade_summary(g, ["l_orderkey"], "grade", "l_suppkey", "l_linenumber")


_NAMED = {"said": "o_custkey % 5, o_custkey % 3", "found": "o_custkey % 3, o_orderkey % 4", "elsewhere": "o_orderkey % 7"}


@query(
    f"""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN len(missing) = 0 THEN 'collection_ok' WHEN len(absent) = 0 THEN 'collection_other_wording'
WHEN len(list_intersect(said, found)) > 0 OR len(list_intersect(missing, elsewhere)) > 0 THEN 'collection_partial' ELSE 'collection_mismatch' END AS code
FROM (SELECT *, list_filter(missing, lambda x: NOT list_contains(elsewhere, x)) AS absent FROM (SELECT *, list_filter(said, lambda x: NOT list_contains(found, x)) AS missing
FROM (SELECT o_orderkey, o_custkey, {', '.join(f'[{e}] AS {n}' for n, e in _NAMED.items())} FROM orders)))"""
)
def attribution_codes(spark, d):
    said = "CASE WHEN o_custkey % 4 = 0 THEN array() ELSE array(o_custkey % 5, o_custkey % 3) END AS said"
    o = table(spark, d, "orders").selectExpr("o_orderkey", said, f"array({_NAMED['found']}) AS found", f"array({_NAMED['elsewhere']}) AS elsewhere")
    return o.select("o_orderkey", evidence.attribution_code(F.col("said"), F.col("found"), F.col("elsewhere")).alias("code"))


@query(
    """SELECT key, CASE WHEN bool_or(ok) THEN 'ref_ok' ELSE 'ref_mismatch' END AS code FROM (SELECT s.key, EXISTS (SELECT 1 FROM (SELECT l_orderkey AS key, l_suppkey % 5 AS unit, l_partkey % 40 AS a, l_partkey % 40 + 3 AS b FROM lineitem WHERE l_linenumber > 2) f
WHERE f.key = s.key AND f.unit = s.unit AND s.a <= f.b AND f.a <= s.b) AS ok FROM (SELECT l_orderkey AS key, l_suppkey % 5 AS unit, l_partkey % 40 AS a, l_partkey % 40 + 9 AS b FROM lineitem WHERE l_linenumber <= 2) s) GROUP BY key"""
)
def reference_codes(spark, d):
    li = table(spark, d, "lineitem")
    rows = lambda cond, more: li.filter(cond).selectExpr("l_orderkey AS key", "l_suppkey % 5 AS unit", "l_partkey % 40 AS a", f"l_partkey % 40 + {more} AS b")
    return evidence.reference_code(rows("l_linenumber <= 2", 9), rows("l_linenumber > 2", 3), "key")


@query(
    """SELECT event_id, unsafe FROM (SELECT event_id, twice OR back OR max(one) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 AS unsafe FROM (SELECT *, coalesce(c <= top, false) AS back, CASE WHEN top IS NOT NULL AND c = 1 THEN 1 ELSE 0 END AS one
FROM (SELECT event_id, user_id, c, max(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, count(*) OVER (PARTITION BY user_id, c) > 1 AS twice
FROM (SELECT event_id, user_id, event_id % 97 AS c FROM events))))"""
)
def link_audit(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "user_id", "event_id % 97 AS c")
    return evidence.link_audit(e, ["user_id"], ["event_id"], "c").select("event_id", "unsafe")


_MATCH = "SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS tier, l_discount AS q, l_extendedprice AS evidence, l_partkey AS stable_rank FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, stable_rank FROM ({_MATCH}) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, q DESC, evidence DESC, stable_rank) = 1")
def preferred_source(spark, d):
    m = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_linenumber % 3 AS tier", "l_discount AS q", "l_extendedprice AS evidence", "l_partkey AS stable_rank")
    return evidence.preferred(m, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "stable_rank")


@query(
    """SELECT s, ref, stable_rank, CAST(row_number() OVER (PARTITION BY s ORDER BY tier, stable_rank, ref) AS INTEGER) AS place FROM (SELECT l_suppkey AS s, l_partkey % 50 AS ref, l_linenumber % 3 AS tier, l_orderkey * 8 + l_linenumber AS stable_rank FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY l_linenumber % 3, l_orderkey * 8 + l_linenumber) = 1) QUALIFY place <= 40"""
)
def alternate_places(spark, d):
    m = table(spark, d, "lineitem").selectExpr("l_suppkey AS s", "l_partkey % 50 AS ref", "l_linenumber % 3 AS tier", "l_orderkey * 8 + l_linenumber AS stable_rank")
    return evidence.alternates(m, ["s"], "ref").select("s", "ref", "stable_rank", "place")


_CITES = "SELECT o_custkey AS doc, o_orderkey AS cite, o_orderkey % 3000 AS ts FROM orders"
_PLACES = "SELECT o_custkey AS doc, l_orderkey AS cite, l_suppkey % 7 AS pid, CAST(max(l_quantity) AS BIGINT) AS size, min(l_linenumber) = 1 AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"


@query(
    f"""WITH p AS (SELECT * FROM ({_PLACES}) JOIN ({_CITES}) USING (doc, cite)),
h AS (SELECT x.doc, x.cite, x.pid, x.first, sum(y.size) AS held FROM p x JOIN p y ON x.doc = y.doc AND x.pid = y.pid AND abs(x.ts - y.ts) <= 500 GROUP BY ALL)
SELECT doc, cite, pid FROM h QUALIFY row_number() OVER (PARTITION BY doc, cite ORDER BY held DESC, first DESC, pid) = 1"""
)
def one_source(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    cites = o.selectExpr("o_custkey AS doc", "o_orderkey AS cite", "o_orderkey % 3000 AS ts")
    p = li.join(o, li.l_orderkey == o.o_orderkey).selectExpr("o_custkey AS doc", "l_orderkey AS cite", "l_suppkey % 7 AS pid", "l_quantity", "l_linenumber")
    places = p.groupBy("doc", "cite", "pid").agg(F.max("l_quantity").cast("long").alias("size"), (F.min("l_linenumber") == 1).alias("first"))
    return evidence.one_source(cites, places, "doc")


_GRADINGS = "SELECT user_id AS doc, event_id AS g, CAST(floor(value * 10) AS BIGINT) AS pos, CAST(floor(value * 10) AS BIGINT) + 2 AS \"end\" FROM events WHERE event_id % 3 = 0"
_HOSTS = "SELECT user_id AS doc, event_id AS host, CAST(floor(value * 10) AS BIGINT) AS ts, CAST(floor(value * 10) AS BIGINT) + 12 AS te FROM events WHERE event_id % 3 = 1"


@query(
    f"""SELECT doc, g, host, place FROM (SELECT g.doc, g.g, h.host, h.ts, h.te, CASE WHEN h.te <= g.pos + 1 AND g.pos - h.te <= 40 THEN 'after' ELSE 'before' END AS place
FROM ({_GRADINGS}) g JOIN ({_HOSTS}) h ON g.doc = h.doc AND ((h.te <= g.pos + 1 AND g.pos - h.te <= 40) OR (h.ts >= g."end" - 1 AND h.ts - g."end" <= 8)))
QUALIFY row_number() OVER (PARTITION BY doc, g ORDER BY place, CASE WHEN place = 'after' THEN -te ELSE ts END, host) = 1"""
)
def attached_gradings(spark, d):
    e = table(spark, d, "events").selectExpr("user_id AS doc", "event_id", "CAST(floor(value * 10) AS BIGINT) AS at")
    g = e.filter("event_id % 3 = 0").selectExpr("doc", "event_id AS g", "at AS pos", "at + 2 AS end")
    return evidence.attach_gradings(g, e.filter("event_id % 3 = 1").selectExpr("doc", "event_id AS host", "at AS ts", "at + 12 AS te"), "doc")


_ENTRY = "SELECT event_id AS id, user_id AS key, event_id % 13 AS lo, event_id % 13 + 4 AS hi, CAST(floor(value) AS DOUBLE) AS s, CAST(floor(value) AS DOUBLE) + 20 AS e FROM events WHERE event_id % 2 = {}"


@query(
    f"""SELECT a.id AS a_id, b.id AS b_id, round(least(1.0, (least(a.e, b.e) - greatest(a.s, b.s)) / 20), 6) AS time FROM ({_ENTRY.format(0)}) a JOIN ({_ENTRY.format(1)}) b
ON a.key = b.key AND least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 >= 1 AND least(a.e, b.e) - greatest(a.s, b.s) >= -3 AND least(a.e, b.e) - greatest(a.s, b.s) + 3 >= 6"""
)
def paired_entries(spark, d):
    e = table(spark, d, "events").selectExpr("event_id AS id", "user_id AS key", "event_id % 13 AS lo", "event_id % 13 + 4 AS hi", "CAST(floor(value) AS DOUBLE) AS s", "CAST(floor(value) AS DOUBLE) + 20 AS e")
    return evidence.conflicting(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), "key")


BLESSING = ["in", "the", "of", "to", "and"]


@query(
    f"""SELECT doc_id, min(pos) AS pos, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) - 1) // 9 AS cut FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run
FROM ({tokens_sql('documents', 'doc_id')}) WHERE tok IN ({_IN(BLESSING)}))) GROUP BY doc_id, run, cut"""
)
def blessing_runs(spark, d):
    return cues.runs_of(tokens.tokens(table(spark, d, "documents"), "doc_id"), "doc_id", BLESSING).withColumn("pos", F.col("pos").cast("long"))


_CUE = "SELECT user_id AS doc, event_id AS id, event_id % 1500 AS pos, event_id % 1500 + 3 AS \"end\", event_id % 7 = 0 AS trailing FROM events WHERE event_id % 5 = 0"
_PLACE = "SELECT DISTINCT user_id AS doc, event_id % 1500 AS pos FROM events WHERE event_id % 5 = 2"


@query(
    f"""SELECT p.doc, p.pos, coalesce(bool_or((NOT c.trailing AND c."end" <= p.pos AND p.pos < c."end" + 45) OR (c.trailing AND p.pos < c.pos AND p.pos >= c.pos - 45)), false) AS announced,
p.pos - max(c."end") FILTER (NOT c.trailing AND c."end" <= p.pos) AS distance FROM ({_PLACE}) p LEFT JOIN ({_CUE}) c ON p.doc = c.doc GROUP BY p.doc, p.pos"""
)
def cue_reach(spark, d):
    return cues.reach(_cues(spark, d), table(spark, d, "events").filter("event_id % 5 = 2").selectExpr("user_id AS doc", "event_id % 1500 AS pos").distinct(), "doc")


def _cues(spark, d):
    return table(spark, d, "events").filter("event_id % 5 = 0").selectExpr("user_id AS doc", "event_id AS id", "event_id % 1500 AS pos", "event_id % 1500 + 3 AS end", "event_id % 7 = 0 AS trailing")


_NEXT = f"""SELECT *, (SELECT min(y.pos) FROM ({_CUE}) y WHERE y.doc = x.doc AND NOT y.trailing AND y.pos > x.pos) AS next_pos FROM ({_CUE}) x"""


@query(f"SELECT doc, id, next_pos FROM ({_NEXT})")
def next_cue(spark, d):
    return cues.next_leading(_cues(spark, d), "doc").select("doc", "id", "next_pos")


@query(
    f"""SELECT x.doc, x.id FROM ({_NEXT}) x WHERE NOT x.trailing AND NOT EXISTS (SELECT 1 FROM ({_HOSTS}) h WHERE h.doc = x.doc AND h.ts < least(x."end" + 16, coalesce(x.next_pos, x."end" + 16)) AND h.te > x."end")"""
)
def unanswered_cues(spark, d):
    cites = table(spark, d, "events").filter("event_id % 3 = 1").selectExpr("user_id AS doc", "CAST(floor(value * 10) AS BIGINT) AS ts", "CAST(floor(value * 10) AS BIGINT) + 12 AS te")
    return cues.unanswered(_cues(spark, d), cites, "doc").select("doc", "id")


SAID = [
    "as it says in chapter 2 verse 255 of the book", "read chapter number 3 verses 7 to 9 then stop", "chapter cow verse 9 through 5", "the chapter cave", "chapter 12 and chapter 114 verse 1",
    "no reference here", "chaptered 5 verse", "verse 3 of chapter cow",
]
_SAID = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SAID))
_REF = r"\bchapter (?:number )?(?:([0-9]{1,3})|(cave|cow))(?: verses? (?:number )?([0-9]{1,3})(?: (?:to|through|until) ([0-9]{1,3}))?)?\b"


@query(
    f"""SELECT id, CAST(nullif(regexp_extract(m, '{_REF}', 1), '') AS INTEGER) AS unit, nullif(regexp_extract(m, '{_REF}', 2), '') AS name,
least(CAST(nullif(regexp_extract(m, '{_REF}', 3), '') AS INTEGER), CAST(nullif(coalesce(nullif(regexp_extract(m, '{_REF}', 4), ''), regexp_extract(m, '{_REF}', 3)), '') AS INTEGER)) AS "first",
greatest(CAST(nullif(regexp_extract(m, '{_REF}', 3), '') AS INTEGER), CAST(nullif(coalesce(nullif(regexp_extract(m, '{_REF}', 4), ''), regexp_extract(m, '{_REF}', 3)), '') AS INTEGER)) AS "last"
FROM (SELECT id, unnest(regexp_extract_all(s, '{_REF}')) AS m FROM (VALUES {_SAID}) v(id, s))"""
)
def spoken_references(spark, d):
    rows = spark.createDataFrame(list(enumerate(SAID)), "id int, s string")
    return rows.select("id", F.explode(cues.references(F.col("s"), "chapter", "verse", ["cave", "cow"])).alias("x")).select("id", "x.*")


SUBJECTS, GRADINGS = ["the", "that"], {"is": "strong", "was": "weak"}


@query(
    f"""SELECT doc_id, pos, CASE tok WHEN 'is' THEN 'strong' ELSE 'weak' END AS kind FROM (SELECT *, max(CASE WHEN tok IN ({_IN(SUBJECTS)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS s
FROM ({tokens_sql('documents', 'doc_id')})) WHERE s = 1 AND tok IN ('is', 'was')"""
)
def spoken_gradings(spark, d):
    out = cues.spoken_gradings(tokens.tokens(table(spark, d, "documents"), "doc_id"), "doc_id", SUBJECTS, GRADINGS)
    return out.withColumn("pos", F.col("pos").cast("long"))


STOP = ["the", "of", "and", "in", "that", "is", "it", "for", "was", "with", "a", "an", "to"]


@query(f"""SELECT conv_id, turn, array_to_string(f[1:8], ' ') AS topic FROM (SELECT conv_id, turn, list_filter(w, lambda x, i: NOT list_contains(w[1 : i - 1], x)) AS f
FROM (SELECT conv_id, turn, list_filter(w, lambda x: x NOT IN ({_IN(STOP)})) AS w FROM (SELECT conv_id, turn, w FROM conversations JOIN ({words_sql('conversations', 'conv_id, turn')}) USING (conv_id, turn))))""")
def topic_words(spark, d):
    c = table(spark, d, "conversations")
    w = T.words(T.norm_en(F.col("text")))
    return c.select("conv_id", "turn", F.array_join(cues.topic_words(w, STOP), " ").alias("topic"))


_TIMES = """SELECT o_custkey AS key, i, CAST(i AS DOUBLE) * 0.5 AS s, CAST(i AS DOUBLE) * 0.5 + CASE WHEN o_custkey % 2 = 0 THEN 0.5 ELSE 0.4 END AS e
FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    f"""SELECT key, CASE WHEN sum(al) >= 8 AND sum(m) > 0 AND sum(n) >= 0.6 * sum(m) THEN least(30.0, greatest(3.0, floor(coalesce(max(e - s), 0) + 0.5))) ELSE 3.0 END AS tolerance FROM (
SELECT key, run, min(a) FILTER (flat) AS s, max(e) FILTER (flat) AS e, count(*) FILTER (flat) AS n, count(*) FILTER (a IS NOT NULL) AS m, count(*) AS al FROM (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
FROM (SELECT *, coalesce(abs((b - a) - (e - s)) < 0.025 AND abs(s - b) < 0.015 AND b - a > 0, false) AS flat FROM (SELECT *, lag(s) OVER (PARTITION BY key ORDER BY i) AS a, lag(e) OVER (PARTITION BY key ORDER BY i) AS b FROM ({_TIMES})))) GROUP BY key, run) GROUP BY key"""
)
def time_tolerance(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    by = Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber")
    w = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("key"), F.row_number().over(by).alias("i"))
    s = F.col("i").cast("double") * 0.5
    return cues.time_tolerance(w.select("key", "i", s.alias("s"), (s + F.when(F.col("key") % 2 == 0, 0.5).otherwise(0.4)).alias("e")), "key")
