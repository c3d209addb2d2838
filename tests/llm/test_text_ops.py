"""Decontamination, URL rules, page extraction, personal data: against brute force and edge cases."""

import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quotelens.llm import decontaminate, html, pii, urls


def brute_hits(doc, items):
    w = decontaminate.words(doc)
    hit, found = set(), set()
    for i, t in items:
        for p in decontaminate.windows(decontaminate.words(t)):
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(i)
    return len(hit), found


def test_wu_manber_matches_brute_force():
    r = random.Random(4)
    for _ in range(200):
        items = [(i, " ".join(r.choice("abc") for _ in range(r.choice([1, 2, 3, 9, 10, 11, 14])))) for i in range(4)]
        doc = " ".join(r.choice("abcd") for _ in range(r.randint(0, 60)))
        spans, found = decontaminate.Matcher(items).find(decontaminate.words(doc))
        assert (sum(b - a for a, b in spans), found) == brute_hits(doc, items)


def test_leaks_blocks_and_edges(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (4, ""), (None, "x")]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "ONE two three four five six seven eight nine ten eleven, short item."), (2, None), (3, ""), (4, "short"), (4, "short"), (None, "a short item")]
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, items int")
    one = decontaminate.report(decontaminate.find_leaks(d, b)).collect()
    many = decontaminate.report(decontaminate.find_leaks(d, b, block_words=1)).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in one}
    assert got == {(1, 13, 13, 2, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 1, 0, 0, False), (None, 3, 2, 1, True)}
    assert {r.items_sha256 for r in one if r.doc_id == 1} == {hashlib.sha256(b"1,2").hexdigest()}
    assert decontaminate.find_leaks(d, b.limit(0)).filter("size(items) > 0").count() == 0
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0


def test_url_rules(spark):
    rows = [
        "http://Example.ORG/es/1", "https://a.example.org/en/15?x", "http://foo.org/x", "ftp://x.com/fr/", "http://x.com/de/a#b", "http://xcom/de/a", "nothing", None, "http://x.net?q=/fr/", "http://notexample.org/es/"
    ]
    df = spark.createDataFrame([(u,) for u in rows], "url string")
    h, p = urls.host_and_path(F.col("url"))
    df = df.select("url", h.alias("host"), p.alias("path"))
    rule, says = urls.rule_columns(F.col("host"), F.col("path"))
    got = [(r.host, r.path, r.rule, r.says) for r in df.select("host", "path", rule.alias("rule"), says.alias("says")).collect()]
    assert got == [
        ("example.org", "/es/1", "example.org/es/", "block"),
        ("a.example.org", "/en/15", "example.org/en/1", "block"),
        ("foo.org", "/x", "org/", "allow"),
        ("x.com", "/fr/", "com/fr/", "allow"),
        ("x.com", "/de/a", "com/de/", "block"),
        ("xcom", "/de/a", None, None),
        ("", "", None, None),
        ("", "", None, None),
        ("x.net", "", None, None),
        ("notexample.org", "/es/", "org/", "allow"),
    ]


def test_url_model_learns(spark):
    rows = [(i, f"http://good{i}.org/a", "x", 1) for i in range(40)] + [(100 + i, f"http://bad{i}.com/de/b", "x", 1) for i in range(40)]
    rows += [(200, "http://good77.net/a", "x", 1), (201, "http://bad77.net/de/b", "x", 1), (202, None, None, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, ratio int")
    got = {r.page_id: r.verdict for r in urls.judge(df).collect()}
    assert len(got) == 83 and got[200] == "allow" and got[201] == "block" and got[0] == "allow" and got[100] == "block"
    assert urls.judge(df.limit(0)).count() == 0


def test_url_counts_are_exact(spark):
    r = random.Random(4)
    rows = [("".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789/-") for _ in range(30)), "allow" if i % 3 else "block") for i in range(6000)]
    seen: dict = {}
    for url, says in rows:
        for context, byte in grams_of(url):
            for key in (context, (context, byte)):
                seen[says, key] = seen.get((says, key), 0) + 1

    def score(url):
        logs, n = 0.0, 0
        for says, sign in (("allow", 1), ("block", -1)):
            p = 1 / 257
            for k, (context, byte) in enumerate(grams_of(url)):
                p = 1 / 257 if k % (urls.ORDERS + 1) == 0 else p
                p = (seen.get((says, (context, byte)), 0) + urls.STRENGTH * p) / (seen.get((says, context), 0) + urls.STRENGTH)
                if k % (urls.ORDERS + 1) == urls.ORDERS:
                    logs += sign * math.log(p)
                    n += says == "allow"
        return logs / n

    model = urls.train(spark.createDataFrame(rows, "url string, says string"))
    texts = [u for u, _ in rows[:40]] + ["", "new/one", "abc"]
    assert np.allclose(urls.ratios(texts, model), [score(u) for u in texts], atol=1e-9)


def grams_of(url):
    data = f"\x02{url}\x03"
    return [((k, data[max(0, i - k) : i].rjust(k, "\0")), data[i]) for i in range(len(data)) for k in range(urls.ORDERS + 1)]


def test_extract():
    page = (
        "<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><a href=x>N</a></nav>"
        "<div class='ad'>buy</div><article><h1>Head &amp; line</h1><p><b>One  two\n three.<br><p>Four &lt;five&gt;.</p><script>x</p></script>"
        "<form><input>f</form><aside>s</aside><p>Six&nbsp;seven</p></article><section class='comments'><p>nice</p></section><footer>F</footer></body></html>"
    )
    assert html.extract(page) == "Head & line\nOne two three.\nFour <five>.\nSix seven"
    assert html.extract(None) == html.extract("") == ""
    assert html.extract("plain") == "plain"
    deep = "<div>" * 5000 + "<p>deep text</p>"
    assert html.extract(f"<body>{deep}</body>") == "deep text"
    assert html.extract("<body><p>unclosed <b>bold <i>both</p><p>next") == "unclosed bold both\nnext"


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html.extract_pages(df, ["page_id", "url"]).collect()) == [(1, "a", 1), (2, "", 0), (2, "", 0)]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    out = [pii.Span("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [pii.Span("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(pii.Span("card", *m.span()))
    out += [pii.Span("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return pii.ordered(out)


def test_base_spans_match_the_patterns():
    r = random.Random(9)
    for _ in range(30_000):
        t = "".join(r.choice("ab1.9@@+- ()%_25 5.1..7\né") for _ in range(r.randint(0, 26)))
        assert pii.base_spans(t) == plain(t), t
    t = "card 4111 1111 1111 1111 at a.b@c.example.org, +1 (316) 555-2121, 10.0.0.1"
    assert [s.kind for s in pii.base_spans(t)] == ["card", "email", "phone", "ip"]
    assert pii.base_spans("1" * 200_000) == []
    assert pii.base_spans("a" * 200_000 + "@") == []


def test_pii_end_to_end(spark):
    rows = [(i, f"word mail{i}.x@mail{i % 9}.example.com and +1 (316) 555-{i:04d} end") for i in range(30)]
    rows += [(100, "call phone (316) 555-2121 now"), (101, None), (102, ""), (103, "clean text 12 and 3.5 of 100")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(d)
    got = {r.doc_id: r for r in pii.find(d, model, ["doc_id"]).collect()}
    assert got[0].n_email == 1 and got[0].n_phone == 1 and got[0].base_sha256 == hashlib.sha256(got[0].spans.encode()).hexdigest()
    assert got[101].spans == got[102].spans == got[103].spans == ""
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in got.values())
    red = {r.doc_id: r.text for r in pii.redact(d, model).collect()}
    assert red[1] == "word [EMAIL] and [PHONE] end" and red[101] is None and red[103] == rows[-1][1]
    assert pii.find(d.limit(0), pii.fit(d.limit(0)), ["doc_id"]).count() == 0


def test_pii_forms_beyond_the_patterns(spark):
    rows = [(i, f"word mail{i}.x@mail{i % 9}.example.com and +1 (316) 555-{i:04d} from 10.2.{i}.7 end") for i in range(300)]
    found = [
        "Tel: [030 1234 5678] heute", "call [555-123-4567] now", "the number [555-123-4567] stands alone", "mail [jane.doe at host dot com] please",
        "see [bob (at) host.org] there", "ask [bob [at] host [dot] net] there", "at [2001:db8:1:2:3:4:5:6] it runs",
    ]
    clean = ["on 2024-01-15 we met", "look at this. It is", "years 1990 2000 2010 2020", "ping 300.1.2.3 now", "sum 12 34 56 78"]
    rows += [(1000 + i, t[: t.find("[")] + t[t.find("[") + 1 : t.rfind("]")] + t[t.rfind("]") + 1 :]) for i, t in enumerate(found)]
    rows += [(2000 + i, t) for i, t in enumerate(clean)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    red = {r.doc_id: r.text for r in pii.redact(d, pii.fit(d)).collect()}
    for i, t in enumerate(found):
        kind = "[EMAIL]" if "host" in t else "[IP]" if ":db8:" in t else "[PHONE]"
        assert red[1000 + i] == t[: t.find("[")] + kind + t[t.rfind("]") + 1 :]
    for i, t in enumerate(clean):
        assert red[2000 + i] == t
