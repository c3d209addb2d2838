"""Queries over cues by form, originals and marked-up books, with their SQL.

The tables hold no Arabic lectures, so the word lists here are frequent words of the test texts; books
are made from documents, by the same rule in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.operators import entries, evaluate, families, forms, intervals, ledger, originals, tokens
from quotelens.plans.registry import grams_sql, norm_sql, query, table, tokens_sql, words_sql
from quotelens.sources import markup, sinks

TITLES, OPENERS, NO_VERBS = [("of", "the"), ("the",), ("it",)], ["is", "the", "a", "that", "for", "on"], ["to", "with"]
BLESS_FIRST, BLESS, BLESS_ENDS, BLESS_TAIL = "of", ["of", "and", "in", "to"], ["of", "and", "to"], ["by", "as"]
SAY, SAYS, WAS, MARKS, VIA = ["is", "are", "and"], ["is", "are"], ["was", "the"], ["of", "in"], "by"
NAMES, ALONE, PAIRED, INTO = ["the", "of"], ["that", "it"], ["in", "on"], "is"
PRAYERS = [("the",), ("to", "a"), ("for",)]


def _in(words) -> str:
    return "(" + ", ".join(f"'{x}'" for x in words) + ")"


def _phrase_sql(i: str, phrases) -> str:
    """Length of the longest phrase at the 1-based place i of w."""
    whens = " ".join("WHEN " + " AND ".join(f"w[{i} + {k}] = '{x}'" for k, x in enumerate(p)) + f" THEN {len(p)}" for p in sorted(phrases, key=len, reverse=True))
    return f"(CASE {whens} ELSE 0 END)"


def _leading_sql(words: str, members) -> str:
    return f"(SELECT coalesce(min(k) - 1, len({words})) FROM (SELECT unnest({words}) AS x, generate_subscripts({words}, 1) AS k) WHERE x NOT IN {_in(members)})"


_PLACE = f"SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM ({words_sql('documents', 'doc_id')})"


@query(
    f"""WITH t AS (SELECT *, {_phrase_sql('i', TITLES)} AS tl FROM ({_PLACE}) WHERE i > 1),
a AS (SELECT *, i + tl AS j, w[i + tl : i + tl + {forms.BLESSING - 1}] AS ahead FROM t WHERE tl > 0),
r AS (SELECT *, {_leading_sql('ahead', BLESS)} AS run FROM a WHERE w[j] = '{BLESS_FIRST}'),
e AS (SELECT *, coalesce(list_max(list_filter(range(1, run + 1), lambda k: ahead[k] IN {_in(BLESS_ENDS)})), 0) AS stop FROM r),
m AS (SELECT *, stop + {_leading_sql(f'w[j + stop : j + stop + {forms.BLESSING - 1}]', BLESS_TAIL)} AS bl FROM e WHERE stop > 0),
c AS (SELECT doc_id, i - 2 AS pos, j + bl - 1 AS stop FROM m WHERE length(w[i - 1]) >= 2 AND w[i - 1] NOT IN {_in(NO_VERBS)} AND w[j + bl] IN {_in(OPENERS)})
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(stop AS INTEGER) AS "end" FROM c
QUALIFY pos + 1 >= coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)"""
)
def report_cues(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id")
    bless = lambda w, i: forms.blessing_length(w, i, BLESS_FIRST, BLESS, BLESS_ENDS, BLESS_TAIL)
    return _rows(w, forms.reports(F.col("w"), TITLES, bless, OPENERS, NO_VERBS))


def _rows(df, cues):
    return df.select("doc_id", F.explode(cues).alias("x")).select("doc_id", "x.pos", "x.end")


_GLORY = rf"^((?:(?:{'|'.join(ALONE)}) |(?:{'|'.join(PAIRED)}) (?:{INTO} \S+ |\S+ ))*)"


@query(
    f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CAST(i + 1 + n AS INTEGER) AS "end" FROM (
SELECT doc_id, i, len(string_split(regexp_extract(array_to_string(w[i + 2 : i + {forms.GLORY + 1}], ' ') || ' ', '{_GLORY}', 1), ' ')) - 1 AS n
FROM ({_PLACE}) WHERE w[i] IN {_in(SAY)} AND w[i + 1] IN {_in(NAMES)}) WHERE n > 0"""
)
def glory_cues(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id")
    return _rows(w, forms.glorified(F.col("w"), SAY, NAMES, ALONE, PAIRED, INTO))


@query(
    f"""WITH c AS (SELECT doc_id, w, i, list_min(list_filter(range(i + 2, least(i + 1 + {forms.NAME}, len(w)) + 1), lambda j: w[j] IN {_in(sorted({*SAY, *SAYS}))})) AS j
FROM ({_PLACE}) WHERE w[i] IN {_in(WAS)})
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CAST(j AS INTEGER) AS "end" FROM c WHERE j IS NOT NULL AND w[j] IN {_in(SAYS)}
AND list_has_any(w[i + 1 : j - 1], {list(MARKS)}) AND NOT list_has_any(w[i + 1 : j - 1], {[VIA, *WAS]})"""
)
def habit_cues(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id")
    return _rows(w, forms.used_to_say(F.col("w"), WAS, SAYS, SAY, MARKS, VIA))


@query(
    f"""WITH c AS (SELECT doc_id, w, i, list_min(list_filter(range(i + 2, least(i + 1 + {forms.NAME}, len(w)) + 1), lambda j: w[j - 1] IN {_in([*SAY, VIA])} OR {_phrase_sql('j', PRAYERS)} > 0)) AS j
FROM ({_PLACE}) WHERE w[i] IN {_in([*SAY, VIA])})
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, CAST(j - 1 + {_phrase_sql('j', PRAYERS)} AS INTEGER) AS "end" FROM c WHERE j IS NOT NULL AND w[j - 1] NOT IN {_in([*SAY, VIA])}"""
)
def blessed_name_cues(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id")
    return _rows(w, forms.blessed_names(F.col("w"), SAY, VIA, PRAYERS))


PATTERNS = ["by of (?:the|this)", "(?:to|in) the", "of"]
_CONTEXT = " ".join(
    rf"""WHEN regexp_matches(s, '\b(?:{p})\b') THEN (SELECT array_to_string(w[greatest(0, k - 7) + 1 : k + m + 11], ' ') FROM (SELECT
 len(list_filter(string_split(string_split_regex(s, '\b(?:{p})\b')[1], ' '), lambda x: x <> '')) AS k, len(string_split(regexp_extract(s, '\b(?:{p})\b'), ' ')) AS m))"""
    for p in PATTERNS
)


@query(f"SELECT doc_id, md5(context) AS context_md5 FROM (SELECT doc_id, CASE {_CONTEXT} END AS context FROM (SELECT doc_id, w, array_to_string(w, ' ') AS s FROM ({words_sql('documents', 'doc_id')}))) WHERE context IS NOT NULL")
def phrase_contexts(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id")
    out = w.select("doc_id", forms.phrase_context(F.col("w"), PATTERNS).alias("context")).filter("context is not null")
    return out.select("doc_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


_PIECES = "SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS p FROM documents"
_AT = f"SELECT doc_id, p, list_filter(range(1, len(p) + 1), lambda i: {norm_sql('p[i]')} <> '') AS a FROM ({_PIECES})"
_SHOWN = f"SELECT doc_id, p, a, list_transform(range(1, len(a) + 1), lambda i: array_to_string(p[(CASE WHEN i = 1 THEN 1 ELSE a[i] END) : coalesce(a[i + 1] - 1, len(p))], ' ')) AS shown FROM ({_AT})"


def _originals(spark, d):
    from quotelens.functions import text as T

    docs = table(spark, d, "documents").select("doc_id", originals.pieces(F.col("text")).alias("p"), T.words(T.norm_en(F.col("text"))).alias("w"))
    at = docs.withColumn("a", originals.word_places(F.col("p")))
    return at.withColumn("shown", originals.shown_words(F.col("p"), F.col("a")))


@query(
    f"""SELECT doc_id, CAST(len(a) AS INTEGER) AS words, list_transform(a, lambda i: {norm_sql('p[i]')}) = w AS exact, md5(array_to_string(shown, '|')) AS shown_md5
FROM ({_SHOWN}) JOIN ({words_sql('documents', 'doc_id')}) USING (doc_id)"""
)
def original_words(spark, d):
    o = _originals(spark, d)
    shown = F.md5(F.array_join("shown", "|").cast("binary")).alias("shown_md5")
    return o.select("doc_id", F.size("a").alias("words"), originals.exact(F.col("p"), F.col("a"), F.col("w")).alias("exact"), shown)


@query(
    f"""WITH f AS (SELECT doc_id, shown, list_transform(a, lambda i: {norm_sql('p[i]')}) AS w FROM ({_SHOWN}) WHERE len(a) >= 3),
q AS (SELECT *, w[2:3] AS want, list_filter(range(1, len(w)), lambda i: w[i : i + 1] = w[2:3]) AS pl FROM f)
SELECT doc_id, CAST(len(pl) AS INTEGER) AS places, CAST(pl[1] - 1 AS INTEGER) AS first_place, len(list_distinct(list_transform(pl, lambda i: shown[i] || ' ' || shown[i + 1]))) = 1 AS certain FROM q"""
)
def placed_excerpts(spark, d):
    from quotelens.functions import text as T

    o = _originals(spark, d).filter(F.size("a") >= 3).withColumn("own", F.transform("a", lambda i: T.norm_en(F.get("p", i))))
    at = o.withColumn("at", originals.placements(F.slice("own", 2, 2), F.col("own")))
    sure = originals.unambiguous(F.col("at"), F.lit(2), F.col("shown"))
    return at.select("doc_id", F.size("at").alias("places"), F.get("at", F.lit(0)).alias("first_place"), sure.alias("certain"))


_EDGE = r"^[\s\"«»“”.,،؛:]+|[\s\"«»“”.,،؛:]+$".replace("'", "''")


@query(
    f"""WITH x AS (SELECT doc_id, p, a, array_to_string(p[a[3] : a[12]], ' ') AS cut, regexp_replace(array_to_string(p[1:60], ' '), '{_EDGE}', '', 'g') AS body FROM ({_AT}))
SELECT doc_id, md5(CASE WHEN len(a) < 12 THEN '' WHEN (length(cut) - length(replace(cut, '"', ''))) % 2 = 1
 THEN array_to_string(list_filter(string_split(replace(cut, '"', ''), ' '), lambda x: x <> ''), ' ') ELSE cut END) AS range_md5,
md5(CASE WHEN body = '' THEN '' WHEN len(p) > 60 THEN body || ' …' ELSE body END) AS wording_md5 FROM x"""
)
def original_ranges(spark, d):
    o = _originals(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    cut = originals.original_range(F.col("p"), F.col("a"), F.lit(2), F.lit(11))
    return o.select("doc_id", F.md5(cut.cast("binary")).alias("range_md5"), F.md5(originals.source_wording(F.col("text")).cast("binary")).alias("wording_md5"))


@query("SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS INTEGER) AS units FROM documents")
def utf16_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", originals.utf16_length(F.col("text")).alias("units"))


@query(
    """SELECT l_orderkey, array_to_string(flatten(list(range(l_linenumber * 3, l_linenumber * 3 + 1 + CAST(l_quantity AS BIGINT) % 3) ORDER BY l_linenumber, CAST(l_quantity AS BIGINT) % 3)), ',') AS said
FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <> 4 GROUP BY l_orderkey"""
)
def said_positions(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "del").otherwise("exact").alias("kind")
    src = F.when(F.col("l_linenumber") != 4, F.col("l_linenumber") * 3).cast("long").alias("src")
    op = F.struct(kind, src, (1 + F.col("l_quantity").cast("long") % 3).alias("n"))
    ops = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", op.alias("op")))).alias("o"))
    said = originals.said_positions(F.transform("o", lambda x: x["op"]))
    return ops.select("l_orderkey", F.array_join(said, ",").alias("said")).filter("said <> ''")


@query(
    """SELECT l_returnflag, string_agg(l_linenumber || ' ' || n, ', ' ORDER BY n DESC, l_linenumber) AS line
FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag"""
)
def collection_lines(spark, d):
    return originals.counted_list(table(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber")


#: A book of a document: lines of seven words; each ninth line a heading, each third a paragraph, each fourth with a mark.
_LINES = f"""SELECT doc_id, k, array_to_string(w[k * 7 + 1 : k * 7 + 7], ' ') AS body, k % 9 = 4 AS h, k % 9 <> 4 AND k % 3 = 0 AS s, k % 4 = 2 AS m, k + 1 AS page
FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 6) // 7)) AS k FROM ({words_sql('documents', 'doc_id')}))"""


@query(
    f"""WITH l AS (SELECT *, coalesce(last_value(CASE WHEN h THEN body END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k), '') AS heading,
 min(CASE WHEN m THEN page END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p, count(*) FILTER (m) OVER (PARTITION BY doc_id) AS marks FROM ({_LINES})),
t AS (SELECT *, heading IS DISTINCT FROM lag(heading) OVER (PARTITION BY doc_id ORDER BY k) AS turn FROM l WHERE NOT h),
g AS (SELECT *, sum(CASE WHEN s OR turn THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS para FROM t)
SELECT doc_id, para, heading, CASE WHEN any_value(marks) >= 2 THEN arg_min(coalesce(p, 0), k) ELSE 0 END AS page, md5(string_agg(body, ' ' ORDER BY k)) AS text_md5 FROM g GROUP BY doc_id, para, heading"""
)
def markup_books(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id").filter(F.size("w") > 0)
    n = F.floor((F.size("w") + 6) / 7).cast("int")

    def line(k):
        body = F.array_join(F.slice("w", k * 7 + 1, F.lit(7)), " ")
        head = F.when(k % 9 == 4, "### | ").when(k % 3 == 0, "# ").otherwise("~~")
        return F.concat(head, body, F.when(k % 4 == 2, F.concat(F.lit(" PageV01P"), F.lpad((k + 1).cast("string"), 6, "0"))).otherwise(""))

    book = F.concat(F.lit("#META# title\n#META#Header#End#\n"), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), line), "\n"))
    out = markup.markup_paragraphs(w.select("doc_id", book.alias("book")), "doc_id", "book")
    return out.select("doc_id", "para", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"), "heading")


_E = "SELECT l_orderkey, l_linenumber AS n, l_linenumber * 5 + CAST(l_quantity AS BIGINT) % 4 AS a, l_linenumber * 5 + CAST(l_quantity AS BIGINT) % 4 + l_partkey % 9 AS b FROM lineitem"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED ({_E}), o AS (SELECT l_orderkey, min({{'a': a, 'b': b, 'n': n}}) AS x FROM e GROUP BY l_orderkey
UNION ALL SELECT o.l_orderkey, min({{'a': e.a, 'b': e.b, 'n': e.n}}) FROM o JOIN e ON e.l_orderkey = o.l_orderkey AND e.a > o.x.b GROUP BY o.l_orderkey)
SELECT l_orderkey, CAST(x.n AS BIGINT) AS n, CAST(x.a AS BIGINT) AS a, CAST(x.b AS BIGINT) AS b FROM o"""
)
def owner_spans(spark, d):
    q = F.col("l_quantity").cast("long") % 4
    a = F.col("l_linenumber") * 5 + q
    e = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), a.alias("a"), (a + F.col("l_partkey") % 9).alias("b"))
    return entries.owners(e, "l_orderkey")


@query(
    f"""SELECT source, why, count(*) AS n FROM (SELECT source, CASE WHEN n = 0 THEN 'missing' WHEN n < 30 THEN 'too_short' END AS why FROM (SELECT source,
CASE WHEN doc_id % 2 = 1 AND w[1:1] = ['the'] AND len(w) > 1 THEN len(w) - 1 ELSE len(w) END AS n FROM documents JOIN ({words_sql('documents', 'doc_id')}) USING (doc_id))) WHERE why IS NOT NULL GROUP BY ALL"""
)
def passages_left_out(spark, d):
    p = entries.usable_passages(table(spark, d, "documents"), "text", 30, "The", F.col("doc_id") % 2 == 1)
    return entries.left_out(p, "source")


@query(
    f"""WITH f AS ({grams_sql('benchmark', 'item_id', 4)}), b AS (SELECT DISTINCT doc_id FROM ({grams_sql('documents', 'doc_id', 4)}) WHERE gram IN (SELECT gram FROM f))
SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b) GROUP BY source"""
)
def corpus_without(spark, d):
    docs = table(spark, d, "documents")
    blocked = entries.held_out(docs, table(spark, d, "benchmark"), "doc_id", "item_id")
    return entries.without(docs, blocked, "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query(
    """SELECT tier, count(*) AS n, count(*) FILTER (status IN ('verbatim', 'partial') AND k % 5 > 0 AND k % 2 > 0 AND tier > 0 AND q BETWEEN 1 AND 10) AS doubtful, count(*) FILTER (status = 'partial' AND k % 4 = 0) AS listed
FROM (SELECT l_partkey AS k, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_partkey % 3 = 0 THEN 0 WHEN l_partkey % 7 < 3 AND l_linestatus = 'O' THEN 3 WHEN l_partkey % 7 < 3 THEN 2 ELSE 1 END AS tier,
CASE l_returnflag WHEN 'A' THEN 'verbatim' WHEN 'N' THEN 'partial' ELSE 'meaning' END AS status FROM lineitem) GROUP BY tier"""
)
def entry_filters(spark, d):
    k, q = F.col("l_partkey"), F.col("l_quantity").cast("long")
    status = F.when(F.col("l_returnflag") == "A", "verbatim").when(F.col("l_returnflag") == "N", "partial").otherwise("meaning")
    rows = table(spark, d, "lineitem").withColumn("tier", entries.tier(k % 3 == 0, k % 7 < 3, F.col("l_linestatus") == "O"))
    flags = F.when(k % 4 == 0, F.array(F.lit("tail"))).otherwise(F.array().cast("array<string>"))
    listed = entries.shown(status, flags, F.lit(None).cast("string"), "partial", flagged=True, unreviewed=True)
    again = entries.doubtful(status, k % 5 == 0, k % 2 == 0, F.col("tier"), q)
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(again).alias("doubtful"), F.count_if(listed).alias("listed"))


@query(
    """SELECT l_orderkey, array_to_string(list(p - 4 ORDER BY p), ',') AS moved FROM (SELECT l_orderkey, l_linenumber + CAST(l_quantity AS BIGINT) % 5 + 2 AS p FROM lineitem) GROUP BY l_orderkey HAVING min(p) >= 4"""
)
def rebased_positions(spark, d):
    p = (F.col("l_linenumber") + F.col("l_quantity").cast("long") % 5 + 2).alias("p")
    rows = table(spark, d, "lineitem").select("l_orderkey", p).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return rows.select("l_orderkey", F.array_join(entries.rebased(F.col("p"), F.lit(4)), ",").alias("moved")).filter("moved is not null")


GRADES = [("r returned", "weak"), ("a accepted", "sound")]


@query(
    """SELECT grade, CASE clean WHEN 'r returned' THEN 'weak' WHEN 'a accepted' THEN 'sound' ELSE grade END AS shown, count(*) AS n FROM (SELECT grade, trim(regexp_replace(lower(grade), '[^a-z]+', ' ', 'g')) AS clean
FROM (SELECT l_returnflag || CASE l_returnflag WHEN 'R' THEN ' - Returned.' WHEN 'A' THEN ': accepted' ELSE '?' END AS grade FROM lineitem)) GROUP BY ALL"""
)
def grade_wording(spark, d):
    tail = F.when(F.col("l_returnflag") == "R", " - Returned.").when(F.col("l_returnflag") == "A", ": accepted").otherwise("?")
    rows = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", tail).alias("grade")).agg(F.count("*").alias("n"))
    return entries.graded(rows, spark.createDataFrame(GRADES, "key string, name string"), "grade").select("grade", "shown", "n")


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, tok FROM ({tokens_sql('documents', 'doc_id')}) WHERE tok IN ('the', 'of', 'de')")
def masked_words(spark, d):
    return families.mask_words(table(spark, d, "documents"), "doc_id", ["the", "of", "de"])


@query(
    """WITH o AS (SELECT l_orderkey, l_linenumber AS i, l_partkey % 4 AS said, l_suppkey % 4 AS written FROM lineitem)
SELECT x.l_orderkey, x.i AS i1, min(y.i) AS i2 FROM o x JOIN o y ON x.l_orderkey = y.l_orderkey AND y.i BETWEEN x.i + 1 AND x.i + 12 AND x.said = y.written AND x.written = y.said GROUP BY ALL"""
)
def moved_words(spark, d):
    ops = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber AS i", "l_partkey % 4 AS said", "l_suppkey % 4 AS written")
    return ledger.diff_marks(ops, "l_orderkey")


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN min(l_partkey) % 3 = 0 THEN l_linenumber END AS mark FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l_orderkey, l_linenumber, min(mark) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mark FROM m"""
)
def next_marks(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    m = m.select("l_orderkey", "l_linenumber", F.when(F.col("p") % 3 == 0, F.col("l_linenumber")).alias("mark"))
    return intervals.fill_back(m, "l_orderkey", "l_linenumber", "mark")


_ITEMS = "SELECT DISTINCT l_orderkey, l_linenumber AS item, l_linenumber * 5 AS a, l_linenumber * 5 + 4 + l_partkey % 7 AS b, l_suppkey % 5 AS pid FROM lineitem"
_FOUND = "SELECT DISTINCT l_orderkey, l_linenumber * 6 AS ts, l_linenumber * 6 + 3 + l_suppkey % 6 AS te, l_partkey % 5 AS pid FROM lineitem"


@query(
    f"""WITH j AS (SELECT i.*, f.pid AS fpid, greatest(least(b, te) - greatest(a, ts), 0) AS inter, greatest(b, te) - least(a, ts) AS whole FROM ({_ITEMS}) i JOIN ({_FOUND}) f USING (l_orderkey))
SELECT l_orderkey, item, a, b, pid, max(inter) * 2 >= b - a AS covered, round(max(inter / whole), 6) AS iou, arg_max(fpid = pid, {{'i': inter, 'p': -fpid}}) AS first_right FROM j GROUP BY l_orderkey, item, a, b, pid"""
)
def item_detection(spark, d):
    li = table(spark, d, "lineitem")
    items = li.selectExpr("l_orderkey", "l_linenumber AS item", "l_linenumber * 5 AS a", "l_linenumber * 5 + 4 + l_partkey % 7 AS b", "l_suppkey % 5 AS pid").distinct()
    found = li.selectExpr("l_orderkey", "l_linenumber * 6 AS ts", "l_linenumber * 6 + 3 + l_suppkey % 6 AS te", "l_partkey % 5 AS pid").distinct()
    return evaluate.detection(items, found, "l_orderkey")


@query(
    """SELECT l_orderkey, string_agg(printf('%d:%02d', s // 60, s % 60) || ' ' || l_linestatus || ': ' || t, chr(10) ORDER BY s, l_linestatus, t) AS lines FROM (
SELECT l_orderkey, l_linenumber * 37 AS s, l_linestatus, CASE WHEN l_partkey % 2 = 0 THEN 'a b c d e f g h…' ELSE 'a b ' || l_partkey END AS t FROM lineitem) GROUP BY l_orderkey"""
)
def description_lines(spark, d):
    text = F.when(F.col("l_partkey") % 2 == 0, "a b c d e f g h i j").otherwise(F.concat(F.lit("a b "), F.col("l_partkey").cast("string")))
    rows = table(spark, d, "lineitem").withColumn("s", F.col("l_linenumber") * 37).withColumn("t", text)
    return sinks.description_index(rows, "l_orderkey", "s", "l_linestatus", "t")
