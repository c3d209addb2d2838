"""Columns that clash, nulls, repeated rows, empty tables, long texts; groups of near copies with outsiders."""

import random

import pytest
from test_corpus_ops import brute_components

import corpus_pipeline
from quotelens.llm import decontaminate, fingerprint, html, jaccard, links, mixing, paragraphs, pii, quality, toxicity, urls

CLASH = ["score", "_id", "_text", "_value", "n_words", "items", "hit_spans", "_own", "_row", "_size", "_head", "_set", "_spans", "_items", "rate", "id", "n", "key"]


def table_of(spark, rows):
    kinds = ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *(f"mine {c}" for c in CLASH)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {kinds}")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(1)
    words = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    item = words(30)
    rows = [(i, words(60), "en", "ab"[i % 2], 1) for i in range(40)]
    rows += [(50, f"{words(20)} {item} {words(20)}", "en", "a", 1), (51, f"write to jane.doe@example.com {words(30)}", "en", "a", 1)]
    rows += [(60, None, None, None, None), (60, None, None, None, None), (61, "", "en", "a", 0), (None, words(60), "en", "a", 1), (1, words(60), "en", "a", 1)]
    rows += [(62, words(40_000), "en", "b", 1)]
    spark.createDataFrame([(1, item), (2, None), (None, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_clashing_columns(spark, tables, name, stage):
    at, rows = tables
    docs = table_of(spark, rows)
    out = stage(spark, docs, at)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(x[c] == f"mine {c}" for x in got for c in CLASH)
    ids = sorted((x.doc_id for x in got), key=str)
    if name == "personal data":
        assert len(got) == len(rows) and any("[EMAIL]" in (x.text or "") for x in got)
    if name == "benchmark decontamination":
        assert ids == sorted((r[0] for r in rows if r[0] != 50), key=str)
    if name == "near documents":
        # the repeated row becomes one; both texts of id 1, and the row without an id, stay
        assert ids == sorted([*range(40), 1, 50, 51, 60, 61, 62, None], key=str)
    assert stage(spark, docs.limit(0), at).count() == 0


def test_last_stage_counts_every_row(spark, tables):
    at, rows = tables
    assert corpus_pipeline.STAGES[-1][1](spark, table_of(spark, rows), at).count() == len(rows)


def test_operators_take_clashing_columns_and_empty_tables(spark, tables):
    at, rows = tables
    docs = table_of(spark, rows)
    benchmark, labels = spark.read.parquet(f"{at}/benchmark.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    for run, n in (
        (lambda d: decontaminate.report(decontaminate.find_leaks(d, benchmark, keep=["doc_id"])), len(rows)),
        (lambda d: mixing.mix(d), len(rows)),
        (lambda d: toxicity.score(d, toxicity.fit(d, labels), ["doc_id"]), len(rows)),
        (lambda d: fingerprint.report(d), len(rows)),
        (lambda d: jaccard.near_classes(d), len(rows)),
        (lambda d: pii.find(d, pii.fit(d), ["doc_id"]), len(rows)),
        (lambda d: quality.score(d, quality.fit(d, labels), ["doc_id"]), len(rows)),
        (lambda d: paragraphs.repeated(d), 0),
    ):
        assert run(docs).count() == n
        assert run(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None, "x", "y"), (1, None, None, "x", "y"), (2, "http://a.org/b", "<p>One.</p>", "x", "y")], "page_id long, url string, html string, text string, host string")
    assert [r.text for r in html.extract_pages(pages, ["page_id", "text"]).orderBy("page_id").collect()] == ["", "", "One."]
    assert html.extract_pages(pages.limit(0), ["page_id"]).count() == 0
    assert urls.judge(pages, keep=["page_id", "host"]).count() == 3 and urls.judge(pages.limit(0)).count() == 0


def variants(seed, n, size):
    """Copies of one text with up to a third of its words replaced from a few words, and strangers."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 7, 10])):
            w[r.randrange(size)] = f"x{r.randrange(6)}"
        if i % 7 == 0:
            a = r.randrange(size // 2)
            del w[a : a + r.randrange(size // 3)]
        rows.append((i, " ".join(w)))
    return rows + [(n + i, " ".join(f"y{r.randrange(50)}" for _ in range(size))) for i in range(10)]


@pytest.mark.parametrize("seed, meet", [(1, 1000), (2, 20)])
def test_groups_with_outsiders_match_brute_force(spark, monkeypatch, seed, meet):
    monkeypatch.setattr(links, "MEET", meet)  # small parts, so that cells of two parts occur
    rows = variants(seed, 160, 90)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_paragraph_recall_against_brute_force(spark):
    """Paragraphs at Jaccard 0.75 or more to another document's: nine in ten or more are found."""
    r = random.Random(4)
    sentences, rows = [], []
    for i in range(60):
        w = [f"s{r.randrange(3000)}" for _ in range(45)]
        v = list(w)
        v[r.choice([0, 1, 2, 42, 43])] = "changed"
        sentences.append((2 * i, 2 * i + 1))
        filler = lambda: " ".join(f"f{r.randrange(100_000)}" for _ in range(30)).capitalize() + "."
        rows += [(2 * i, f"{filler()} {' '.join(w).capitalize()}. {filler()}"), (2 * i + 1, f"{filler()} {' '.join(v).capitalize()}. {filler()}")]
    found = {x.doc_id for x in paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(a in found and b in found for a, b in sentences) >= 54


def test_main_text_without_an_article_follows_density(monkeypatch):
    prose = "A long paragraph of plain words that says something about the matter at hand."
    page = f"<body><div><ul><li><a href=/x>First</a></li><li><a href=/y>Second</a></li></ul></div><div><h2>Title</h2><p>{prose}</p><p>{prose}</p></div><div><a href=/z>Read on</a></div></body>"
    want = f"Title\n{prose}\n{prose}"
    assert html.extract(page) == want
    measure = html.measure

    def flat(root):
        nodes = measure(root)
        for x in nodes:
            x.density = x.total = 0.0
        return nodes

    monkeypatch.setattr(html, "measure", flat)
    assert html.extract(page) != want


def test_main_text_of_odd_markup():
    assert html.extract("<p>One.</p><a href=it's.html>link</a><p>Two words here.</p><p>Three.</p>").split("\n")[-2:] == ["Two words here.", "Three."]
    assert html.extract("<div class='content related'><p>Main text here.</p></div>") == "Main text here."
    assert html.extract("<div class=sidebar><article><p>The text.</p></article></div><p>Other</p>") == "The text."
    assert html.extract("<b>" * 20_000 + "</i></b></i>" * 20_000 + "x") == "x"


def test_mix_deals_rows_without_ids(spark):
    rows = [(None, "w " * (i % 7 + 1), "s") for i in range(200)] + [(5, "w " * 3, "s")] * 20
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda x: sorted((r.size, r.taken) for r in x.collect())
    assert key(mixing.mix(d)) == key(mixing.mix(d.repartition(7)))


def test_mix_rates_solve_the_dual(spark):
    """Rates are min(2, exp(lambda z)) and meet the target to 1e-6 of it before they become copies."""
    r = random.Random(6)
    rows = [(i, "w " * r.choice([1, 2, 5, 30, 90]), r.choice("aaaabbc")) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        own = [x for x in got if x.source == s]
        assert sum(x.rate * x.size for x in own) == pytest.approx(own[0].target, rel=1e-6)
