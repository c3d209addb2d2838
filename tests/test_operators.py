import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quotelens.operators import evaluate, families, intervals, ledger, retrieval, seeds, sharing, spans, tokens
from quotelens.sources import ingest, sinks


def test_gap_clusters_split_after_twenty(spark):
    rows = [(1, 1, 3, 0, "a", 1.0), (1, 1, 3, 20, "b", 1.0), (1, 1, 3, 41, "c", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, item_id long, n int, pos int, gram string, w double")
    got = sorted((r.a, r.b, r.hits) for r in seeds.seed_clusters(df).collect())
    assert got == [(0, 23, 2), (41, 44, 1)]


def test_region_quota(spark):
    rows = [(1, p, 0, 0, 5, 10, 10.0) for p in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, item_id long, cluster int, a int, b int, hits long, score double")
    got = seeds.topk_region(df).collect()
    assert sorted(r.item_id for r in got) == list(range(24))


def test_rounds_restart_on_repeat(spark):
    rows = [(1, 1, 3, i, g, 1.0) for i, g in enumerate("abcab")]
    df = spark.createDataFrame(rows, "doc_id long, item_id long, n int, pos int, gram string, w double")
    assert [r["round"] for r in seeds.rounds(df).orderBy("pos").collect()] == [0, 0, 0, 1, 1]


def test_overlap_and_merge(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 9.0, 25.0), (1, 3, 30.0, 31.0)], "k int, id int, s double, e double")
    got = {(r.id_a, r.id_b) for r in intervals.overlap_pairs(a, a, "k", 4.0).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}
    assert sorted((r.s, r.e, r.n) for r in intervals.merge_ranges(a, "k").collect()) == [(0.0, 25.0, 2), (30.0, 31.0, 1)]


def test_asof_both_ways(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.5)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 4.0, "b"), (1, 9.0, "c")], "k int, t double, v string")
    back = {r.t: r.v_found for r in intervals.asof(left, right, "k", "t", "v").collect()}
    assert back == {5.0: "b", 0.5: None}
    ahead = {r.t: r.v_found for r in intervals.asof(left, right, "k", "t", "v", after=True).collect()}
    assert ahead == {5.0: "c", 0.5: "a"}


def test_agreement(spark):
    mk = lambda ws: spark.createDataFrame([("k", i, w) for i, w in enumerate(ws) if w], "key string, pos int, tok string")
    out = ledger.agreement(mk(["a", "x", "x", "y", "a"]), mk(["a", "b", "x", "z", None]), ["key"], truth=mk(["a", "b", "c", "d", "a"]))
    assert [r["class"] for r in out.orderBy("pos").collect()] == ["BOTH_EXACT", "ONE_EXACT", "BOTH_DIFFER_SAME", "BOTH_DIFFER_DIFFERENT", "ONLY_ONE_COVERS"]


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 0), (20, 20)], "k int, n int")
    got = [(r.lo, r.hi) for r in df.select(*evaluate.wilson(F.col("k"), F.when(F.col("n") == 0, None).otherwise(F.col("n")))).collect()]
    assert got[1] == (84.0, 100.0)


def test_phrase_and_runs(spark):
    docs = spark.createDataFrame([(1, "x one two three four five y"), (2, "one two three")], "doc_id long, text string")
    ph = spark.createDataFrame([(7, "one two three four five")], "item_id long, text string")
    assert [(r.item_id, r.doc_id, r.at) for r in families.contains_phrase(ph, docs, "item_id", "doc_id").collect()] == [(7, 1, 1)]
    runs = {(r.doc_id, r.words) for r in families.longest_run(docs, ph, "doc_id", "item_id").collect()}
    assert runs == {(1, 5), (2, 3)}


def test_ledger_end_to_end(spark):
    words = [f"w{i}q" for i in range(20)]
    b = spark.createDataFrame([(1, " ".join(words)), (2, "other words entirely not quoted here")] + [(i, f"filler{i}") for i in range(3, 40)], "item_id long, text string")
    d = spark.createDataFrame([(1, "before " + " ".join(words) + " after"), (2, "nothing")], "doc_id long, text string")
    c = seeds.seed_clusters(seeds.seed_hits(d, b, 39))
    m = ledger.verify(c, d, b, 39)
    rows = ledger.group(m).collect()
    assert [(r.doc_id, r.pid, r.status, r.ts, r.te) for r in rows] == [(1, 1, "verbatim", 1, 21)]


def test_empty_inputs(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.tokens(d, "doc_id").count() == 0
    assert tokens.grams(d, "doc_id").count() == 0


def test_ingest(spark):
    srt = "1\n00:00:01,000 --> 00:00:03,000\nhello there\n\n2\n00:00:04,000 --> 00:00:05,000\nbye\n"
    got = ingest.subtitle_words(spark.createDataFrame([("a", srt)], "key string, t string"), "key", "t").orderBy("start").collect()
    assert [(r.w, r.start, r.end) for r in got] == [("hello", 1.0, 2.0), ("there", 2.0, 3.0), ("bye", 4.0, 5.0)]
    st = spark.createDataFrame([("a", "0:05\none two\n0:09\nthree\n1:00\nfour")], "key string, t string")
    got = ingest.stamped_segments(st, "key", "t").orderBy("seg").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(5.0, 9.0, "one two"), (9.0, 39.0, "three"), (60.0, 90.0, "four")]
    js = spark.createDataFrame([('{"words":[{"w":"a","start":1,"end":2},{"word":"b","start":3}]}',)], "x string")
    ws = js.select(ingest.json_words(F.col("x"))).first()[0]
    assert [(w.w, w.start) for w in ws] == [("a", 1.0), ("b", None)]


def test_sinks(spark, tmp_path):
    w = [(f"w{i}" + ("." if i == 4 else ""), i * 1.0, i * 1.0 + 0.5) for i in range(12)]
    df = spark.createDataFrame([("k", w)], "key string, words array<struct<w:string,start:double,end:double>>")
    cues = sinks.srt_cues(df, "key", "words").orderBy("g").collect()
    assert [c.n for c in cues] == [5, 7] or sum(c.n for c in cues) == 12
    assert sum(p.n for p in sinks.paragraphs(df, "key", "words").collect()) == 12
    sinks.write_csv(spark.createDataFrame([("=1", None)], "a string, b string"), str(tmp_path / "c"))
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "c").glob("*.csv"))
    assert "\"'=1\"" in text and "\r\n" in text


def test_topic_of_ordinary_words(spark):
    docs = spark.createDataFrame([(i, f"river stone filler{i} harbour") for i in range(6)] + [(9, "violet comet")], "doc_id long, text string")
    topics = spark.createDataFrame([(1, "river harbour"), (2, "river comet violet"), (3, "stone"), (4, "nothing here")], "item_id long, text string")
    got = retrieval.topic_search(topics, docs, 7, "item_id", "doc_id", 3, 10).collect()
    assert sorted((r.item_id, r.doc_id) for r in got) == [(1, i) for i in range(6)] + [(2, 9)] + [(3, i) for i in range(6)]


def test_topic_search_takes_whole_items(spark, tmp_path):
    from quotelens.plans.text_queries import topic_search

    words = [f"word{chr(97 + i)}" for i in range(12)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = [(i, " ".join(words[9:])) for i in range(300)] + [(i, "other text here") for i in range(300, 700)]
    item.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = topic_search(spark, str(tmp_path)).collect()
    assert len(got) == 10 and {r.hits for r in got} == {3}


def test_printed_numbers_form_no_pairs(spark):
    asked = spark.range(4000).selectExpr("id AS q", "0 AS book", "CAST(id % 2 AS int) + 6 AS number", "2 AS base")
    asked = asked.unionByName(spark.createDataFrame([(9001, 0, None, 2), (9002, 0, 60, 20), (9003, None, 6, 2)], "q long, book int, number int, base int"))
    units = spark.range(4000).selectExpr("4000 - id AS unit", "0 AS book", "CAST(6 + (4000 - id) % 3 AS int) AS number", "2 AS base").filter("number <> 7")
    got = {r.q: (r.unit, r.exact) for r in spans.by_printed_number(asked, units, "q", "book").collect()}
    want = {q: (3, True) if q % 2 == 0 else (2, False) for q in range(4000)} | {9001: (2, False)}
    assert got == want
    df = spans.by_printed_number(asked, units, "q", "book")
    df.collect()
    rows = []

    def walk(node):
        metric = node.metrics().get("numOutputRows")
        if "Join" in node.nodeName() and metric.isDefined():
            rows.append(metric.get().value())
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        below = node.plan() if "QueryStage" in node.nodeName() else None
        for child in [below] if below is not None else [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 4001  # one row a question, not one for each unit of its base


def test_phrase_cues_send_no_text_along(spark):
    from quotelens.plans.text_queries import LEXICON

    docs = spark.createDataFrame([(1, "and the cat and is it of the end"), (2, None), (3, "and"), (3, "and the")], "doc_id long, text string")
    got = families.phrase_cues(docs, "doc_id", LEXICON)
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 0, "opener", "and the", 2), (1, 3, "opener", "and", 1), (1, 4, "report", "is it", 2), (1, 6, "report", "of the", 2), (3, 0, "opener", "and the", 2),
    ]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.split("\n") if "Generate" in x and "explode" in x]
    assert not [x for x in plan.split("\n") if "Generate posexplode" in x]  # words leave their row as matches only


def _pairs_by_hand(rows, least, share, most):
    sets: dict = {}
    for key, text in rows:
        w = (text or "").lower().split()
        sets.setdefault(key, set()).update(zip(w, w[1:], w[2:]))
    df = Counter(g for s in sets.values() for g in s)
    kept = {k: {g for g in s if 1 < df[g] <= most} for k, s in sets.items() if k is not None}
    out = set()
    for a in kept:
        for b in kept:
            n = len(kept[a] & kept[b]) if a < b else 0
            if n >= least and n >= share * min(len(sets[a]), len(sets[b])):
                out.add((a, b, n))
    return out


def test_families_by_hand(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.choice((2, 6, 20, 60, 300)))]
        if i % 3 and rows:
            base = (rng.choice(rows)[1] or "").split()
            words = [rng.choice(words) if rng.random() < 0.2 else w for w in base]
        rows.append((i * 7 - 100, " ".join(words)))
    rows += [(-100, "one more row of this key"), (None, rows[1][1]), (None, None), (9_000_000_000, rows[5][1]), (13, None)]
    for most in (6, 255):
        for size in ("4", "80"):  # one part of each layer, and three
            before = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", size)
            try:
                got = [tuple(r) for r in families.trigram_families(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", 5, 0.3, most).collect()]
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", before)
            assert len(got) == len(set(got)) and set(got) == _pairs_by_hand(rows, 5, 0.3, most) and got
    assert families.trigram_families(spark.createDataFrame([], "doc_id long, text string"), "doc_id", 5, 0.3).count() == 0


def test_families_leave_chance_pairs_where_they_are():
    # 200 texts of need 100 share one gram, two of them 20 more of this layer: one pair of 19,900 leaves the cell
    size = np.array([200] + [2] * 20, np.uint32)
    ids = np.array([*range(200), *[3, 8] * 20], np.int64)
    blobs = [pa.array([sharing._planes(x)], pa.binary()) for x in (size, ids, np.full(len(ids), 100, np.uint32))]
    cell = pa.table([pa.array([0], pa.int32()), *blobs], names=["cell", "sizes", "ids", "needs"])
    assert sharing._named(cell, 1).to_pylist() == [{"a": 3, "b": 8, "k": 21, "need": 100}]
