"""Rules of sources, seeds, verdicts and cues on small inputs with known answers."""

from pyspark.sql import functions as F

from quotelens.operators import cues, evidence, families, seeds, spans
from quotelens.sources import ingest, sinks


def test_subtitles_without_fractions_and_without_cues(spark):
    rows = [
        (1, "1\n0:01 --> 0:03\nalpha beta\n\n2\n00:00:05,5 --> 00:00:06.250\n<i>gamma</i>\n"),
        (2, "WEBVTT\nNOTE made by hand\n\n12\nalpha <b>beta</b>\ngamma"),
        (3, None),
    ]
    got = ingest.subtitle_words(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()
    assert [(x.w, x.start, x.end) for x in got if x.id == 1] == [("alpha", 1.0, 2.0), ("beta", 2.0, 3.0), ("gamma", 5.5, 6.25)]
    assert [(x.w, x.start) for x in got if x.id == 2] == [("alpha", None), ("beta", None), ("gamma", None)]
    assert not [x for x in got if x.id == 3]


def test_srt_cue_lasts_and_never_runs_into_the_next(spark):
    words = [("a.", 0.0, 0.05), ("b", 3.0, 9.5), ("c", 9.2, 9.3)]
    d = spark.createDataFrame([(1, words)], "id long, words array<struct<w:string,start:double,end:double>>")
    lines = [x.srt.split("\n")[1] for x in sinks.srt_cues(d, "id", "words").orderBy("g").collect()]
    assert lines == ["00:00:00,000 --> 00:00:00,400", "00:00:03,000 --> 00:00:09,200", "00:00:09,200 --> 00:00:09,600"]


def test_seeds_need_evidence_and_less_near_a_cue(spark):
    c = spark.createDataFrame([(1, 12.0, 1), (2, 11.9, 9), (3, 5.0, 2), (4, 5.0, 1), (5, 4.9, 9)], "id int, score double, hits int")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(seeds.accepted_seeds(c)) == [1]
    assert ids(seeds.accepted_seeds(c, near=F.col("id") > 1)) == [1, 2, 3]


def counts(**more):
    base = dict(asr=0, near=0, joined=0, diff=0, ins=0, matched=12, inf=12, evidence=40.0, d_q=1.0, d_changed=0, d_cols=12, d_run=12, d_matched=12, d_inf=12, d_content=8, d_evidence=40.0, d_content_evidence=40.0, open_tail=0)
    flags = dict.fromkeys("canonical book cue near_cue bracket direct starts whole closed anchored formula chain comment".split(), False)
    row = {**base, "del": 0, **flags, **more}
    return row


def test_each_row_of_the_verdict_table(spark):
    cases = [
        (counts(), "verbatim"),
        (counts(diff=1, d_changed=1), "partial"),  # one changed word is never verbatim
        (counts(asr=2, near=1), "partial"),  # more than a fifth mis-heard
        (counts(inf=1), "reject"),
        (counts(chain=True), "reject"),
        (counts(comment=True), "reject"),
        (counts(canonical=True, formula=True), "reject"),
        (counts(evidence=19.0, d_evidence=19.0), "echo"),  # below 20 without a cue
        (counts(evidence=12.0, d_evidence=12.0, cue=True), "verbatim"),  # 12 after one
        (counts(canonical=True, whole=True, cue=True, matched=3, inf=3, d_inf=3, d_content=1, evidence=3.0, d_evidence=3.0, d_cols=3, d_run=3, d_matched=3), "verbatim"),
        (counts(d_q=0.6, d_changed=5, diff=5, d_run=3, d_inf=6, d_evidence=25.0), "partial"),
        (counts(d_q=0.6, d_changed=5, diff=5, d_run=2, d_inf=6), "reject"),
        (counts(direct=True, closed=True, starts=True, matched=3, inf=3, d_inf=3, evidence=5.0, d_evidence=5.0), "partial"),
        (counts(direct=True, closed=True, starts=True, whole=True, matched=3, inf=3, d_inf=3, evidence=5.0, d_evidence=5.0), "verbatim"),
        (counts(d_q=0.45, d_changed=6, diff=6, d_run=3, d_inf=5, d_evidence=30.0), "lead"),
        (counts(d_q=0.45, d_changed=6, diff=6, d_run=3, d_inf=5, d_evidence=30.0, anchored=True), "reject"),
        (counts(book=True, open_tail=8), "reject"),  # particles that begin the next clause do not count
        (counts(canonical=True, diff=1, d_changed=1, d_content=3, d_evidence=20.0, d_content_evidence=8.0), "reject"),  # plain speech: function words count half
    ]
    names = list(cases[0][0])
    kind = lambda v: "boolean" if isinstance(v, bool) else ("double" if isinstance(v, float) else "int")
    d = spark.createDataFrame([(i, *(c[n] for n in names)) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"`{n}` {kind(cases[0][0][n])}" for n in names))
    got = [r.s for r in d.select("i", evidence.verdicts(d).alias("s")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_collections_named_in_a_list(spark):
    toks = "this was reported by one and two and three but not four reported elsewhere one".split()
    w = spark.createDataFrame([(1, i, t) for i, t in enumerate(toks)], "id int, pos int, tok string")
    got = cues.collections_named(w, "id", ["by"], ["one", "two", "three", "four"]).collect()
    assert [(x.pos, x.names) for x in got] == [(3, ["one", "two", "three"])]


def test_phrases_shorter_than_the_window_are_looked_for_whole(spark):
    p = spark.createDataFrame([(1, "Alpha beta!"), (2, " ".join(f"w{i}" for i in range(10))), (3, "")], "item_id long, text string")
    t = spark.createDataFrame([(7, "so alpha beta, alpha beta"), (8, "w1 " + " ".join(f"w{i}" for i in range(1, 10)))], "doc_id long, text string")
    got = sorted((x.item_id, x.off, x.doc_id, x.at) for x in families.phrase_places(p, t, "item_id", "doc_id").collect())
    assert got == [(1, 0, 7, 1), (1, 0, 7, 3), (2, 1, 8, 1), (2, 2, 8, 2)]
    assert families.phrase_places(p.limit(0), t, "item_id", "doc_id").count() == 0


def test_vectors_of_one_known_word_are_null(spark):
    w = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "zz")], "id int, tok string")
    v = spark.createDataFrame([("a", 1.0, [3.0, 0.0]), ("b", 2.0, [0.0, 2.0])], "tok string, weight double, vector array<double>")
    got = {x.id: x.vector for x in spans.weighted_vectors(w, v, "id").collect()}
    assert got[1] is None and got[2] == [0.6, 0.8] and 3 not in got


def test_chunks_merge_a_short_tail(spark):
    d = spark.createDataFrame([(0,), (110,), (117,), (118,), (250,)], "n int")
    got = [[(x.a, x.b) for x in r[0]] for r in d.select(spans.chunks(F.col("n"))).collect()]
    assert got == [[], [(0, 110)], [(0, 117)], [(0, 110), (90, 118)], [(0, 110), (90, 200), (180, 250)]]
