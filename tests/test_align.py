import random

from quotelens.functions.align import DIFF, EXACT, GAP, align, diagonal_band, summarize, verdict
from quotelens.functions.text import py_within


def one(_):
    return 1.0


def brute(t, p):
    """Best local score with exact matches only, weights 1."""
    h = [[0.0] * (len(p) + 1) for _ in range(len(t) + 1)]
    best = 0.0
    for i in range(1, len(t) + 1):
        for j in range(1, len(p) + 1):
            s = EXACT if t[i - 1] == p[j - 1] else -DIFF
            h[i][j] = max(0.0, h[i - 1][j - 1] + s, h[i - 1][j] - GAP, h[i][j - 1] - GAP)
            best = max(best, h[i][j])
    return best


def test_score_matches_brute_force():
    r = random.Random(1)
    for _ in range(60):
        t = [r.choice("abcd") for _ in range(r.randint(1, 9))]
        p = [r.choice("abcd") for _ in range(r.randint(1, 9))]
        al = align(t, p, one, tolerant=False)
        want = brute(t, p)
        assert (al is None and want == 0) or abs(al.score - want) < 1e-4


def test_ops_are_monotone_and_counts_add_up():
    t = "we saw alpha beta gamma delta epsilon zeta today".split()
    p = "alpha beta gama delta zeta".split()
    al = align(t, p, one)
    c = summarize(al, t, p, lambda w: 3.0)
    assert c["matched"] + c["diff"] + c["ins"] + c["del"] == c["cols"]
    assert [o.ti for o in al.ops if o.ti >= 0] == sorted(o.ti for o in al.ops if o.ti >= 0)
    assert 0 <= al.ps < al.pe <= len(p)


def test_split_and_glued_words():
    al = align("the alphabeta gamma delta".split(), "the alpha beta gamma delta".split(), one)
    assert "joinP" in [o.op for o in al.ops]
    al = align("the alpha beta gamma delta".split(), "the alphabeta gamma delta".split(), one)
    assert "joinT" in [o.op for o in al.ops]


def test_verdicts():
    p = [f"word{i}x" for i in range(12)]
    al = align(p, p, one)
    assert verdict(summarize(al, p, p, lambda w: 3.0)) == "verbatim"
    t = [*p[:5], "other", *p[6:]]
    al = align(t, p, one)
    c = summarize(al, t, p, lambda w: 3.0)
    assert c["diff"] == 1 and verdict(c) == "partial"
    assert align([], p, one) is None and align(["q"], p, one) is None


def test_within():
    assert py_within("abc", "abd", 1) and not py_within("abc", "axd", 1) and py_within("", "a", 1)


def test_band_holds_the_alignment():
    p = [f"w{i}" for i in range(60)]
    t = ["x"] * 10 + p[20:40] + ["y"] * 10
    band = diagonal_band(t, p)
    assert band == (10 - 16, 10 + 16)
    al, free = align(t, p, one, band=band), align(t, p, one)
    assert (al.ts, al.te, al.ps, al.pe) == (free.ts, free.te, free.ps, free.pe) == (10, 30, 20, 40)
    assert diagonal_band(["a"], ["b", "c"]) is None
