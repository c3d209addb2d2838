"""Queries over words, grams, seeds and exact matches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.functions import text as T
from quotelens.operators import families, retrieval, seeds, tokens
from quotelens.plans.registry import grams_sql, query, table, tokens_sql, words_sql

STEM_SQL = """CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y'
 WHEN length({t}) > 5 AND {t} LIKE '%sses' THEN left({t}, length({t}) - 2)
 WHEN length({o}) > 3 AND {o} LIKE '%e' THEN left({o}, length({o}) - 1) ELSE {o} END"""
ONCE_SQL = """CASE WHEN length({t}) > 5 AND {t} LIKE '%ing' THEN left({t}, length({t}) - 3)
 WHEN length({t}) > 4 AND {t} LIKE '%ed' THEN left({t}, length({t}) - 2)
 WHEN length({t}) > 5 AND {t} LIKE '%ly' THEN left({t}, length({t}) - 2)
 WHEN length({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' AND {t} NOT LIKE '%us' THEN left({t}, length({t}) - 1) ELSE {t} END"""


def stem_rel(rel: str) -> str:
    """rel with a column stem of its column tok."""
    inner = f"SELECT *, {ONCE_SQL.format(t='tok')} AS once FROM ({rel})"
    return f"SELECT * EXCLUDE (once), {STEM_SQL.format(t='tok', o='once')} AS stem FROM ({inner})"


@query(f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, md5(array_to_string(w, ' ')) AS norm_md5 FROM ({words_sql('documents', 'doc_id')})")
def norm_en_tokens(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id")
    return w.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("norm_md5"))


@query(f"SELECT DISTINCT tok, stem FROM ({stem_rel(tokens_sql('documents', 'doc_id'))})")
def stem_en_vocab(spark, d):
    t = tokens.tokens(table(spark, d, "documents"), "doc_id").select("tok").distinct()
    return t.select("tok", T.stem_en(F.col("tok")).alias("stem"))


ARABIC = ["قال", "صلاة", "الصَّلَاةُ", "ذلك", "إلى", "مؤمن", "ٱلْحَمْدُ", "١٢٣", "کتاب", "والكتاب", "للناس"]
_VALUES = ", ".join(f"('{w}')" for w in ARABIC)
_AR = f"trim(regexp_replace(regexp_replace(translate(regexp_replace(translate(w, 'یک', 'يك'), '{T.ARABIC_MARKS}', '', 'g'), 'إأآٱىة', 'اااايه'), '[^\u0621-\u064a ]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT w, {_AR} AS norm, translate({_AR}, 'صثضظذطقحعءئؤغخ', 'سسدززتكهاااوكه') AS folded FROM (VALUES {_VALUES}) v(w)")
def phonetic_fold(spark, d):
    rows = spark.createDataFrame([(w,) for w in ARABIC], "w string")
    return rows.select("w", T.norm_ar(F.col("w")).alias("norm"), T.fold(T.norm_ar(F.col("w"))).alias("folded"))


_VOCAB = f"SELECT DISTINCT tok FROM ({tokens_sql('benchmark', 'item_id')}) WHERE length(tok) >= 4"
_PAIRS = f"SELECT x.tok AS a, y.tok AS b, CAST(levenshtein(x.tok, y.tok) AS INTEGER) AS d FROM ({_VOCAB}) x JOIN ({_VOCAB}) y ON left(x.tok, 2) = left(y.tok, 2) AND x.tok < y.tok"


def _vocab_pairs(spark, d):
    v = tokens.tokens(table(spark, d, "benchmark"), "item_id").select("tok").distinct().filter(F.length("tok") >= 4).withColumn("p", F.substring("tok", 1, 2))
    return v.withColumnRenamed("tok", "a").join(v.withColumnRenamed("tok", "b"), "p").filter("a < b").drop("p")


@query(f"SELECT a, b, least(d, 4) AS d, d <= 1 AS within1 FROM ({_PAIRS})")
def edit_distance_pairs(spark, d):
    a, b = F.col("a"), F.col("b")
    return _vocab_pairs(spark, d).select("a", "b", T.edit_distance(a, b, 3).alias("d"), T.within(a, b, 1).alias("within1"))


@query(
    f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN m >= 8 AND d <= 2 THEN 'near' WHEN m >= 4 AND m < 8 AND d <= 1 THEN 'near' ELSE 'diff' END AS kind
FROM (SELECT d, least(length(a), length(b)) AS m FROM ({_PAIRS}))) GROUP BY kind"""
)
def word_sim_classes(spark, d):
    return _vocab_pairs(spark, d).groupBy(T.word_sim(F.col("a"), F.col("b")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""WITH t AS (SELECT DISTINCT doc_id, tok FROM ({tokens_sql('documents', 'doc_id')})), n AS (SELECT count(*) AS n FROM documents)
SELECT tok, count(*) AS df, round(ln(any_value(n.n)) - ln(count(*)), 5) AS idf FROM t, n GROUP BY tok"""
)
def token_df_idf(spark, d):
    docs = table(spark, d, "documents")
    n = docs.agg(F.count("*").cast("double").alias("n"))
    return tokens.document_frequency(docs, "doc_id").crossJoin(F.broadcast(n)).select("tok", "df", F.round(F.log("n") - F.log("df"), 5).alias("idf"))


@query(
    f"""WITH s AS (SELECT DISTINCT doc_id, stem FROM ({stem_rel(tokens_sql('documents', 'doc_id'))}))
SELECT stem, count(*) AS df FROM s GROUP BY stem HAVING count(*) <= greatest(1500, 0.035 * (SELECT count(*) FROM documents))"""
)
def rare_stems(spark, d):
    return retrieval.rare_stems(table(spark, d, "documents"), "doc_id", 0.035, 1500)


def _all_grams(rel, key):
    return f"SELECT DISTINCT n, gram, {key} FROM ({grams_sql(rel, key, 2)} UNION ALL {grams_sql(rel, key, 3)})"


@query(f"SELECT n, gram, count(*) AS df FROM ({_all_grams('documents', 'doc_id')}) GROUP BY n, gram HAVING count(*) > 255")
def high_df_grams(spark, d):
    return tokens.dropped_grams(table(spark, d, "documents"), "doc_id", most=255)


_POST = f"SELECT n, gram, item_id, df FROM (SELECT *, count(*) OVER (PARTITION BY n, gram) AS df FROM ({_all_grams('benchmark', 'item_id')})) WHERE df <= 255"


@query(_POST)
def gram_postings(spark, d):
    return tokens.postings(table(spark, d, "benchmark"), "item_id")


_HITS = f"""SELECT g.doc_id, p.item_id, g.n, g.pos, g.gram,
 (ln((SELECT count(*) FROM benchmark)) - ln(p.df)) * CASE WHEN g.n = 3 THEN 1.0 ELSE 0.5 END AS w
FROM ({grams_sql('documents', 'doc_id', 2)} UNION ALL {grams_sql('documents', 'doc_id', 3)}) g JOIN ({_POST}) p ON g.n = p.n AND g.gram = p.gram"""


def _hits(spark, d):
    b = table(spark, d, "benchmark")
    return seeds.seed_hits(table(spark, d, "documents"), b, b.count())


@query(f"SELECT doc_id, item_id, n, pos, gram, round(w, 5) AS w FROM ({_HITS})")
def seed_hits(spark, d):
    return _hits(spark, d).withColumn("w", F.round("w", 5)).withColumn("pos", F.col("pos").cast("long"))


_CLUSTERS = f"""SELECT doc_id, item_id, cluster, min(pos) AS a, max(pos + n) AS b, count(*) AS hits, round(sum(w), 6) AS score FROM (
 SELECT *, sum(CASE WHEN pos - prev > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id ORDER BY pos, n ROWS UNBOUNDED PRECEDING) AS cluster
 FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id, item_id ORDER BY pos, n) AS prev FROM ({_HITS}))) GROUP BY doc_id, item_id, cluster"""


@query(f"SELECT doc_id, item_id, CAST(cluster AS BIGINT) AS cluster, a, b, hits, round(score, 4) AS score FROM ({_CLUSTERS})")
def seed_clusters(spark, d):
    c = seeds.seed_clusters(_hits(spark, d)).withColumn("score", F.round("score", 4))
    return c.withColumn("a", F.col("a").cast("long")).withColumn("b", F.col("b").cast("long"))


_TOPK = f"""SELECT doc_id, item_id, CAST(cluster AS BIGINT) AS cluster, a, b, hits, region, round(score, 4) AS score,
 CAST(row_number() OVER (PARTITION BY doc_id, region ORDER BY score DESC, item_id, a, cluster) AS INTEGER) AS rank
FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, region) AS best FROM (SELECT *, CAST(a // 8 AS BIGINT) AS region FROM ({_CLUSTERS}) WHERE score >= 12 AND (hits >= 2 OR score >= 12)))
WHERE score >= 0.3 * best QUALIFY rank <= 24"""


@query(_TOPK)
def seed_topk_region(spark, d):
    c = seeds.topk_region(seeds.accepted_seeds(seeds.seed_clusters(_hits(spark, d))))
    c = c.withColumn("score", F.round("score", 4))
    return c.withColumn("a", F.col("a").cast("long")).withColumn("b", F.col("b").cast("long"))


@query(
    f"""WITH c AS MATERIALIZED ({_CLUSTERS})
SELECT doc_id, item_id, CAST(cluster AS BIGINT) AS cluster, round(sum(s), 6) AS support FROM (
 SELECT x.doc_id, x.item_id, x.cluster, y.item_id AS p, max(y.score) AS s FROM c x JOIN c y ON x.doc_id = y.doc_id AND abs(x.a - y.a) <= 24 AND abs(x.item_id - y.item_id) <= 12
 GROUP BY ALL) GROUP BY doc_id, item_id, cluster"""
)
def neighbour_support(spark, d):
    return seeds.neighbour_support(seeds.seed_clusters(_hits(spark, d)))


@query()
def seed_rounds(spark, d):
    return seeds.rounds(_hits(spark, d))


@query(
    f"""WITH p AS (SELECT item_id, k - 1 AS off, least(len(w), 8) AS n, array_to_string(w[k : k + least(len(w), 8) - 1], ' ') AS gram
 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS k FROM ({words_sql('benchmark', 'item_id')}) WHERE len(w) > 0)),
t AS (SELECT doc_id, k - 1 AS place, n, array_to_string(w[k : k + n - 1], ' ') AS gram
 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM ({words_sql('documents', 'doc_id')}), (SELECT DISTINCT n FROM p) WHERE len(w) >= n))
SELECT item_id, CAST(off AS INTEGER) AS off, doc_id, CAST(place AS INTEGER) AS "at" FROM t JOIN p ON t.n = p.n AND t.gram = p.gram"""
)
def contains_phrase(spark, d):
    return families.phrase_places(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")


_TRI = f"SELECT DISTINCT doc_id, gram FROM ({grams_sql('documents', 'doc_id', 3)})"


@query(
    f"""WITH g AS MATERIALIZED ({_TRI}), s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
k AS (SELECT gram FROM g GROUP BY gram HAVING count(*) BETWEEN 2 AND 255),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN k ON x.gram = k.gram JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, shared FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE shared >= 5 AND shared >= 0.3 * least(sa.size, sb.size)"""
)
def trigram_families(spark, d):
    return families.trigram_families(table(spark, d, "documents"), "doc_id", 5, 0.3)


@query(
    f"""WITH g AS ({grams_sql('documents', 'doc_id', 3)}), p AS ({grams_sql('benchmark', 'item_id', 3)}),
r AS (SELECT gram FROM p GROUP BY gram HAVING count(DISTINCT item_id) <= 255),
h AS (SELECT doc_id, item_id, g.pos, p.pos AS ppos, g.pos - p.pos AS diag FROM g JOIN p ON g.gram = p.gram JOIN r ON r.gram = p.gram),
q AS (SELECT doc_id, item_id, min(pos) AS start, min(ppos) AS p_start, count(*) + 2 AS words FROM
 (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY pos) AS grp FROM h) GROUP BY doc_id, item_id, diag, grp)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(p_start AS INTEGER) AS p_start, words FROM q
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, start, p_start) = 1"""
)
def longest_exact_run(spark, d):
    return families.longest_run(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


@query(
    f"""WITH w AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 20, 0) + 1, 10)) AS win FROM ({words_sql('documents', 'doc_id')}) WHERE len(w) > 0),
wt AS (SELECT doc_id, win, tok, count(*) AS tf FROM (SELECT doc_id, win, unnest(w[win + 1 : win + 20]) AS tok FROM w) GROUP BY ALL),
pt AS (SELECT item_id, tok, count(*) AS ptf FROM ({tokens_sql('benchmark', 'item_id')}) GROUP BY ALL), n AS (SELECT ln(count(*)) AS ln_n FROM benchmark),
idf AS (SELECT tok, any_value(ln_n) - ln(count(*)) AS idf FROM pt, n GROUP BY tok),
pv AS (SELECT item_id, tok, ptf * idf AS pw FROM pt JOIN idf USING (tok)), pn AS (SELECT item_id, sqrt(sum(pw * pw)) AS pn FROM pv GROUP BY item_id),
wv AS (SELECT doc_id, win, tok, tf * coalesce(idf, ln_n) AS x, idf FROM wt LEFT JOIN idf USING (tok), n), wn AS (SELECT doc_id, win, sqrt(sum(x * x)) AS wn FROM wv GROUP BY ALL),
dots AS (SELECT doc_id, win, item_id, sum(x * pw) AS dot FROM wv JOIN pv USING (tok) GROUP BY ALL)
SELECT doc_id, CAST(win AS INTEGER) AS win, item_id, round(dot / (wn * pn), 5) AS cosine FROM dots JOIN wn USING (doc_id, win) JOIN pn USING (item_id)
WHERE wn > 0 AND pn > 0 AND round(dot / (wn * pn), 5) >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id, win ORDER BY round(dot / (wn * pn), 5) DESC, item_id) = 1"""
)
def tfidf_windows(spark, d):
    b = table(spark, d, "benchmark")
    return families.tfidf_windows(table(spark, d, "documents"), b, b.count(), "doc_id", "item_id")


_STEMS = lambda rel, key: f"SELECT DISTINCT {key}, stem FROM ({stem_rel(tokens_sql(rel, key))})"


@query(
    f"""WITH q AS ({_STEMS('benchmark', 'item_id')}), p AS MATERIALIZED ({_STEMS('documents', 'doc_id')}), n AS (SELECT ln(count(*)) AS ln_n FROM documents),
df AS (SELECT stem, count(*) AS df FROM p GROUP BY stem HAVING count(*) <= greatest(1500, 0.05 * (SELECT count(*) FROM documents))), len AS (SELECT doc_id, len(w) AS len FROM ({words_sql('documents', 'doc_id')})),
h AS (SELECT item_id, doc_id, count(*) AS shared, sum(ln_n - ln(df)) AS raw FROM q JOIN df USING (stem) JOIN p USING (stem), n GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT item_id, doc_id, shared, round(raw / (1 + 0.5 * ln(greatest(1.0, len / 20))), 5) AS score FROM h JOIN len USING (doc_id))
SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""
)
def lexical_meaning(spark, d):
    docs = table(spark, d, "documents")
    n = docs.count()
    return retrieval.lexical(table(spark, d, "benchmark"), docs, n, "item_id", "doc_id", max(1500, int(0.05 * n)), 10)


@query()
def topic_search(spark, d):
    docs = table(spark, d, "documents")
    n = docs.count()
    return retrieval.topic_search(table(spark, d, "benchmark"), docs, n, "item_id", "doc_id", max(1500, round(0.05 * n)), 10)


@query(
    f"""SELECT tok, exact, affixed, docs, array_to_string(list_sort(docs_list)[1:5], ',') AS first_docs FROM (
SELECT stem AS tok, count(*) FILTER (tok = stem) AS exact, count(*) FILTER (tok <> stem) AS affixed, count(DISTINCT doc_id) AS docs, list(DISTINCT doc_id) AS docs_list
FROM ({stem_rel(tokens_sql('documents', 'doc_id'))}) GROUP BY stem)"""
)
def word_counts(spark, d):
    return retrieval.word_counts(table(spark, d, "documents"), "doc_id")


@query(
    f"""SELECT doc_id, CAST(x.a AS INTEGER) AS a, CAST(x.b AS INTEGER) AS b FROM (SELECT doc_id, unnest(CASE WHEN n <= 140 THEN [{{'a': 0, 'b': n}}]
ELSE list_transform(list_distinct(list_concat(range(0, n - 120 + 1, 100), [n - 120])), lambda s: {{'a': s, 'b': s + 120}}) END) AS x
FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM ({words_sql('documents', 'doc_id')}) WHERE len(w) > 0))"""
)
def sentence_windows(spark, d):
    w = tokens.with_words(table(spark, d, "documents"), "doc_id").filter(F.size("w") > 0)
    return w.select("doc_id", F.explode(T.windows(F.size("w"))).alias("x")).select("doc_id", "x.a", "x.b")


LEXICON = [("is it", "report"), ("of the", "report"), ("and", "opener"), ("and the", "opener")]
_LEX = ", ".join(f"('{p}', '{k}', {len(p.split())})" for p, k in LEXICON)


@query(
    f"""WITH t AS ({tokens_sql('documents', 'doc_id')}), w AS ({words_sql('documents', 'doc_id')}),
h AS (SELECT t.doc_id, t.pos, x.kind, x.phrase, x.words FROM t JOIN w USING (doc_id) JOIN (VALUES {_LEX}) x(phrase, kind, words)
 ON array_to_string(w.w[t.pos + 1 : t.pos + x.words], ' ') = x.phrase QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.pos ORDER BY x.words DESC) = 1)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, kind, phrase, CAST(words AS INTEGER) AS words FROM h
QUALIFY pos >= coalesce(max(pos + words) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""
)
def phrase_cues(spark, d):
    return families.phrase_cues(table(spark, d, "documents"), "doc_id", LEXICON)
