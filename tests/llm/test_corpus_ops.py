"""Mixing, fingerprints, similarity join, passages, components, classifiers: against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelens.llm import fingerprint, graph, jaccard, links, mixing, paragraphs, quality, toxicity


def water_fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mix_meets_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([1, 3, 10, 40, 200])), r.choice(["a", "a", "a", "a", "b", "c", "d", None]), 1) for i in range(800)]
    rows += [(900, None, "a", 1), (901, "", "e", 1), (902, " \t", "a", 1), (903, "x", "a", 1), (903, "x", "a", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(d).collect()))
    sizes, taken, target = {}, {}, {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        target[x.source] = x.target
        assert x.taken <= 2 * x.size and x.taken == x.copies * x.size
    want = water_fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert abs(taken[s] - target[s]) <= 40
    assert {x.source: x.source_size for x in got} == sizes
    assert mixing.mix(d.limit(0)).count() == 0


def test_fingerprints(spark):
    rows = [(1, "a b c d e f g h"), (3, "a b c d e f g h"), (7, None), (9, ""), (2000, "one"), (90_000, "x y z")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.report(d).collect()}
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        t, n = texts[k], texts[(k + 1) % len(texts)]
        h = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest()
        assert got[i].n_chars == len(t)
    assert got[1].fingerprint == got[3].fingerprint and got[1].near_next == 1.0 and got[7].near_next == 1.0
    assert got[9].near_next == 0.0 and got[7].fingerprint == ""
    assert fingerprint.report(d.limit(0)).count() == 0
    assert fingerprint.report(d.limit(1)).count() == 1


def test_fingerprint_is_sensitive_to_order(spark):
    w = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(w)), (1, " ".join(w[150:] + w[:150])), (2, " ".join(w[:290] + ["q"] * 10))]
    fp = {r.doc_id: r.fingerprint for r in fingerprint.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same = lambda a, b: sum(fp[a][i : i + 16] == fp[b][i : i + 16] for i in range(0, len(fp[a]), 16))
    assert same(0, 2) > same(0, 1) > 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(seed, n=120):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 5, 20, 60, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            k = r.randrange(len(w))
            w[k : k + r.choice([0, 1])] = [r.choice(vocab)]
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "One TWO"), (n + 4, "one two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes_match_brute_force(spark, seed):
    rows = near_rows(seed)
    d = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_classes(d).collect()}
    assert got == brute_components(rows)


def test_near_classes_edges(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.near_classes(d).collect()), key=str)
    assert got == [(1, 1), (1, 1), (None, 1), (None, None)]
    assert jaccard.near_classes(d.limit(0)).count() == 0


def test_prefixes_share_as_many_as_they_need():
    r = random.Random(5)
    levels = np.random.default_rng(1).integers(0, 200, jaccard.COUNTERS).astype(np.uint8)
    df = (levels / 10 + 0.1).astype(np.float32)
    for _ in range(200):
        common = [r.getrandbits(64) for _ in range(r.randint(1, 60))]
        a = np.unique(np.array(common + [r.getrandbits(64) for _ in range(len(common) // 9)], np.uint64))
        b = np.unique(np.array(common + [r.getrandbits(64) for _ in range(len(common) // 9)], np.uint64))
        if links.similar(a, b, 75):
            (p, x), (q, y) = jaccard.prefix(a, levels, df, 1000.0, 75), jaccard.prefix(b, levels, df, 1000.0, 75)
            assert len(set(p.tolist()) & set(q.tolist())) >= min(x, y)


def test_packed_sets():
    s = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 500).astype(np.uint64))
    t = links.unpack(links.pack(s))
    assert len(t) == len(s) and (np.diff(t.astype(np.int64)) >= 0).all()


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61))
    for a, b in edges:
        if a is not None and a != b:
            assert got[a] == got[b]
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def sentence(r, n):
    return (" ".join(f"{r.choice('abcdefgh')}{r.randrange(10_000)}" for _ in range(n)) + ".").capitalize()


def test_repeated_passages(spark):
    r = random.Random(11)
    passage = " ".join(sentence(r, 12) for _ in range(6))
    rows = [(i, " ".join(sentence(r, 11) for _ in range(8))) for i in range(40)]
    rows += [(100 + i, sentence(r, 9) + " " + sentence(r, 7) + " " + passage + " " + sentence(r, 10)) for i in range(3)]
    rows += [(200, None), (201, ""), (None, passage), (300, "Same short line here now. " + sentence(r, 30)), (301, "Same short line here now. " + sentence(r, 30))]
    got = paragraphs.repeated(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, class_id int")).collect()
    assert {x.doc_id for x in got} == {100, 101, 102}
    assert {x.doc_id for x in got if not x.removed} == {100}
    assert sum(x.n_words for x in got if x.doc_id == 101) >= 50
    assert all(x.first_doc == 100 for x in got)
    assert paragraphs.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_inside_paragraphs(spark):
    r = random.Random(5)
    words = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(10_000)}" for _ in range(n)]
    rows, place = [], {}
    for k in range(120):
        n = r.choice([20, 51, 60, 80])
        passage = words(n) if k % 2 else " ".join(sentence(r, 23) for _ in range(4)).split()[5 : 5 + n]
        for i in (2 * k, 2 * k + 1):
            a = r.randrange(7, 40)
            rows.append((i, " ".join(words(a) + passage + words(r.randrange(7, 40)))))
            place[i] = (a, len(passage))
    rows += [(900, " ".join(["same"] * 300)), (901, " ".join(["same"] * 200)), (902, " ".join(words(300))), (902, None)]
    got: dict = {}
    for x in paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert x.removed == (x.doc_id != x.first_doc) or x.doc_id == 900
        for at in range(x.start, x.start + x.n_words):
            assert at not in got.setdefault(x.doc_id, set())
            got[x.doc_id].add(at)
        if x.number is None and x.doc_id in place:
            a, n = place[x.doc_id]
            assert a <= x.start and x.start + x.n_words <= a + n
    for i, (a, n) in place.items():
        assert got.get(i, set()) >= set(range(a, a + n)), (i, a, n)
    assert got[900] == set(range(300)) and got[901] == set(range(200)) and 902 not in got


def test_pipeline_keeps_unlinked_texts_of_one_id(spark):
    import corpus_pipeline

    r = random.Random(8)
    a, b, c = (" ".join(f"w{r.randrange(10_000)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (5, b), (5, c), (5, c), (5, c + " more"), (6, a), (7, c), (7, b), (8, None), (8, None), (9, ""), (None, a), (None, a)]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars int")
    got = corpus_pipeline.keep_one_of_each(spark, d, "")
    assert got.columns == d.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    want = [(1, a), (5, b), (5, c), (8, None), (9, ""), (None, a), (None, a)]
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=key) == sorted(want, key=key)
    # a row whose text is kept under another id must not stand in for its id's own text
    rows = [(3, b), (4, b), (4, c)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in corpus_pipeline.keep_one_of_each(spark, d, "").collect()) == [(3, b), (4, c)]


def crc(i):
    return zlib.crc32(str(i).encode())


def test_toxicity_learns_from_every_labelled_row_in_parts(spark):
    # the bad word stands far behind 10,000 characters, and in rows beyond 3,000 of a class
    filler = "plain calm words stand here and more of them follow " * 250
    docs = [(i, filler + ("vilest gutterword" if i % 4 == 0 else "kindest greeting")) for i in range(240)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    net = toxicity.fit(d, labels, chars=300_000)
    again = toxicity.fit(d.repartition(3), labels, chars=300_000)
    assert (net.e == again.e).all() and (net.out == again.out).all() and (net.shift == again.shift).all()
    got = {x.doc_id: x.score >= toxicity.AT for x in toxicity.score(d, net, ["doc_id"]).collect()}
    assert got == {i: i % 4 == 0 for i in range(240)}


@pytest.mark.parametrize("scanned", [False, True])
@pytest.mark.parametrize("one_group", [False, True])
def test_classes_of_a_key_give_fewer_links_than_there_are_classes(spark, scanned, one_group):
    import numpy as np

    m = 40  # near copies of each other, but for the last, which only shares the key
    own = [np.sort(np.append(np.arange(1, 20), 100 + i)).astype(np.uint64) for i in range(m - 1)] + [np.arange(500, 520).astype(np.uint64)]
    sets = spark.createDataFrame([(i, links.pack(x)) for i, x in enumerate(own)], "id long, set binary")
    shared = spark.createDataFrame([(7, i) for i in range(m)], "key long, id long")
    # id, n, need, c, g, reach, rest, hub, common, sig
    rows = [(i, 20, 1, i, 1000 if one_group else i, 20, 20, i, -1, -1) for i in range(m)]
    classes = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in links._CLASS))
    found = links.crossing_links(shared, classes, lambda ids: sets.join(ids.distinct(), "id"), 75, 4, scanned)
    got = [tuple(x) for x in found.collect()]
    assert all(a < b < m - 1 for a, b in got)
    assert {x.component for x in graph.components(found).collect()} == {0}
    assert {x for pair in got for x in pair} == set(range(m - 1))
    if one_group or not scanned:  # the pairs of whole texts of different groups are few by their number of keys
        assert len(got) == m - 2


def test_only_classes_of_pairs_that_can_be_links_send_their_sets(spark):
    import numpy as np

    # one group; 0 and 1 share the two keys that they need, the others one key with each other, and 9 and 10 too few for their sizes
    own = {i: np.arange(100 * i, 100 * i + 20) for i in range(11)} | {0: np.arange(20), 1: np.arange(1, 21)}
    sets = spark.createDataFrame([(i, links.pack(x.astype(np.uint64))) for i, x in own.items()], "id long, set binary")
    keys = [(7, i) for i in range(11)] + [(8, 0), (8, 1), (9, 9), (9, 10)]
    shared = spark.createDataFrame(keys, "key long, id long")
    # id, n, need, c, g, reach, rest, hub, common, sig
    rows = [(i, 40 if i == 10 else 20, 2, i, 1000, 40 if i == 10 else 20, 40, i, -1, -1) for i in range(11)]
    classes = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in links._CLASS))
    asked = set()

    def given(ids):
        asked.update(x.id for x in ids.collect())
        return sets.join(ids.distinct(), "id")

    found = links.crossing_links(shared, classes, given, 75, 4, True)
    assert [tuple(x) for x in found.collect()] == [(0, 1)]
    assert asked == {0, 1}


def test_toxicity_deals_texts_once_whatever_the_size_of_the_labels(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d"), (3, "d"), (5, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, 0), (5, 0)], "doc_id long, toxic int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for labels that are large
    try:
        parts = toxicity._parts(d, labels, 2)
        plan = parts._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
        got = [tuple(x) for p in parts.collect() for x in p.rows]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(got) == [(1, 0, "a"), (1, 0, "b"), (1, 1, "a"), (1, 1, "b"), (3, 1, "d"), (3, 1, "d"), (5, 0, "")]


def test_toxicity_learns_without_held_out_rows(spark):
    r = random.Random(2)
    bad = ["grumblefoo", "snarkibar", "grumblequx"]
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        t = i % 4 == 0
        if t:
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(t) if crc(i) % 3 != 1 else int(not t)))  # held-out labels are lies
    d = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    net = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.score(d, net, ["doc_id"]).collect()}
    right = sum((got[i] >= 0.7) == (i % 4 == 0) for i in range(400))
    assert right >= 380 and got[900] == got[901] and 0 <= got[900] < 0.7
    empty = toxicity.fit(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(d, empty, ["doc_id"]).filter("score >= 0.7").count() == 0


def test_quality_learns(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        w = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(30, 120))]
        junk = i % 4 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)))
        labels.append((i, int(not junk)))
    d = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    net = quality.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {x.doc_id: x.score for x in quality.score(d, net, ["doc_id"]).collect()}
    assert sum((got[i] >= 0.3) == (i % 4 != 0) for i in range(300)) >= 290
    assert got[900] == got[901]
    x, owner, filled = quality.chunks(["a" * 700, "", None])
    assert owner.tolist()[-2:] == [1, 2] and (x[owner == 0] != 0).all() and filled[-1] == 0


def test_pipeline_on_the_smallest_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    total = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0 < len(rows) <= total
    assert len({x.doc_id for x in rows}) == len(rows)
    empty = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "/root/testdata/sf0.001")
    assert empty.count() == 0
    assert F is not None


def test_near_documents_free_each_round_before_sets_travel_again(spark, monkeypatch):
    freed, plain = [], links.cut

    def watched(df, stays=False, frees=False):
        freed.append((tuple(df.columns), frees))
        return plain(df, stays, frees)

    monkeypatch.setattr(links, "cut", watched)
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:39])), (3, " ".join(words[1:])), (4, "nothing like the others at all"), (5, None)]
    got = {r.doc_id: r.component_id for r in jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    for last in ("linked", "between", "set"):  # tested pairs of round one, open postings, sets of round two
        assert any(frees for columns, frees in freed if last in columns), last
