"""Personal data by weak supervision.

Labelers of three kinds (patterns, gazetteers, context) vote on candidate spans. Expectation-
maximisation over all votes of the corpus estimates how reliable each labeler is, without labels.
Its posteriors then train a span classifier (logistic regression over shape features), which
decides the candidates that the base patterns do not already settle. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.common import fresh, map_texts, quoted, small_batches, tidy

KINDS = ("email", "ip", "card", "phone")
#: A further candidate becomes a span from this probability on.
ACCEPT = 0.8
#: Share of the classifier's training weight on votes as such.
UNSEEN = 0.2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HAS_DIGIT = re.compile("[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Every match of the email pattern. Found from each @ outwards, so a long run of name
    characters without one costs nothing: the leftmost match begins where the run before @ does."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(Span("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[Span]:
    """Matches of four dotted numbers: a dotted chain is taken apart four numbers at a time."""
    out = []
    for m in _DOTTED.finditer(text):
        if "." not in m[0]:
            continue
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts), 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + len(four) - 1
            if len(four) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(Span("ip", at, end))
            at = end + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    out = []
    if "+" not in text:
        return out
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(Span("phone", m.start(), m.end()))
    return out


def base_spans(text: str | None) -> list[Span]:
    """Spans of the base patterns, by start, then kind as listed."""
    out: list[Span] = []
    if text:
        if "@" in text:
            out += emails(text)
        if _HAS_DIGIT.search(text):
            out += ips(text) + cards(text) + phones(text)
    return ordered(out)


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def joined(spans) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


# --- candidates and labelers -----------------------------------------------------------------

#: Wider than the base patterns; each match is one candidate of its kind.
WIDE = {
    "email": re.compile(
        r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\{at\}| at )\s?[A-Za-z0-9-]{1,63}"
        r"(?:\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[A-Za-z0-9-]{2,63}){1,5}"
    ),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{3,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,4}){2,4}(?![0-9A-Za-z])"),
}
#: Gazetteers: our own short lists.
HOSTS = frozenset("com org net edu gov info biz de fr es uk eu io dev".split())
MAILERS = re.compile(r"(?i)\b(?:mail|post|smtp|imap|mx|web)[a-z0-9-]*\.")
CONTEXT = {
    "email": re.compile(r"(?i)(?:e-?mail|mail|write to|contact|kontakt|courriel|correo|schreiben)\W{0,3}$"),
    "ip": re.compile(r"(?i)(?:\bip|address|host|server|adresse|direcci[oó]n|ping|from)\W{0,3}$"),
    "card": re.compile(r"(?i)(?:card|visa|mastercard|amex|credit|kreditkarte|karte|carte|tarjeta|pan)\W{0,3}(?:n\w*\W{0,3})?$"),
    "phone": re.compile(r"(?i)(?:phone|tel|telefon|t[ée]l[ée]phone|tel[ée]fono|call|mobile|handy|fax|cell|whatsapp)\W{0,3}$"),
}
BEFORE = 32
LABELERS = 5
FEATURES = 10
#: A spelt-out @ or dot; a number as it is written inside a country, with its 0 or as 3, 3 and 4 digits.
_SPELT = re.compile(r"[(\[{](?:at|dot)[)\]}]| at .* dot ")
_NATIONAL = re.compile(r"0[0-9]{1,4}(?:[\x20./-][0-9]{2,4}){2,4}|\(0[0-9]{1,4}\)(?:[\x20./-]?[0-9]{2,4}){2,4}|[2-9][0-9]{2}([\x20.-])[0-9]{3}\1[0-9]{4}|\([2-9][0-9]{2}\)\x20?[0-9]{3}[\x20.-][0-9]{4}")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def votes_and_features(kind: str, text: str, start: int, end: int, is_base: bool) -> tuple[int, int]:
    """(votes, features) of a candidate, each as bits.

    Votes are pairs of bits a labeler: 0 abstains, 1 says no, 2 says yes. Every labeler looks at
    something else: the strict pattern, a looser form, a gazetteer, the words before, the edges.
    """
    body, digits = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - BEFORE) : start], text[end : end + 1]
    votes = [2 if is_base else 0]
    if kind == "email":
        tld = re.split(r"[.\s)\]]", body)[-1].lower()
        votes.append(2 if "@" in body or _SPELT.search(body) else 0)
        votes.append(2 if tld in HOSTS else 1)
        strong = bool(MAILERS.search(body))
    elif kind == "ip":
        parts = body.split(".")
        dotted = len(parts) == 4 and all(p.isdigit() and int(p) <= 255 for p in parts)
        votes.append(2 if dotted or ":" in body else 1)
        if dotted:
            votes.append(1 if parts[0] in ("0", "1", "2") or len(set(parts)) == 1 else 2)
        else:  # the blocks of IPv6 that are given out, and local ones
            votes.append(2 if re.match(r"(?i)[23][0-9a-f]{3}:|f[cd][0-9a-f]{2}:|fe80:", body) else 0)
        strong = dotted and all(p == str(int(p)) for p in parts)
    elif kind == "card":
        votes.append(2 if 13 <= len(digits) <= 19 and luhn(digits) else 1)
        votes.append(2 if digits[:1] in ("3", "4", "5", "6") else 1)
        strong = len(digits) in (15, 16)
    else:
        # a national number has no +; its form says nothing against it
        votes.append(2 if body.startswith(("+", "00")) or _NATIONAL.fullmatch(body) else 0)
        votes.append(2 if 10 <= len(digits) <= 13 else 1)
        strong = bool(re.search(r"\(\d{2,4}\)", body))
    votes.append(2 if CONTEXT[kind].search(before) else 0)
    edge = (not before or not (before[-1].isalnum() or before[-1] in "-/.")) and not (after and (after.isalnum() or after in "-/%"))
    votes.append(0 if edge else 1)
    bits = sum(v << (2 * i) for i, v in enumerate(votes))
    features = [
        strong,
        len(digits) >= 10,
        len(digits) >= 14,
        bool(CONTEXT[kind].search(before)),
        edge,
        "@" in body or body.startswith("+") or body.count(".") == 3,
        bool(re.search(r"\s", body)),
        len(set(digits)) <= 2,
        kind == "card" and luhn(digits) if digits else False,
        before[-1:].isdigit() or after.isdigit(),
    ]
    return bits, sum(bool(f) << i for i, f in enumerate(features))


def candidates(text: str, base: list[Span]) -> list[tuple[Span, int, int, bool]]:
    """(span, votes, features, is base) of each candidate: the base spans, and wider matches that
    overlap none of them."""
    out = []
    taken = sorted((s.start, s.end) for s in base)
    reach, most = [], 0
    for a, b in taken:  # running maximum of ends, for overlap tests by bisection
        most = max(most, b)
        reach.append(most)
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k == 0 or reach[k - 1] <= a

    for s in base:
        out.append((s, *votes_and_features(s.kind, text, s.start, s.end, True), True))
    digit = _HAS_DIGIT.search(text) is not None
    for kind, pattern in WIDE.items():
        if kind == "email":
            if not ("@" in text or "(at)" in text or "[at]" in text or "{at}" in text or (" at " in text and _SAID.search(text))):
                continue
        elif not digit:
            continue
        for m in pattern.finditer(text) if kind == "email" else _near_digits(pattern, text):
            a, b = m.span()
            if kind in ("card", "phone") and len(_digits(m[0])) < 8:
                continue
            if free(a, b):
                out.append((Span(kind, a, b), *votes_and_features(kind, text, a, b, False), False))
    return out


_SAID = re.compile(r" at [A-Za-z0-9-]+\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[A-Za-z0-9-]{2}")
_NUMBERY = re.compile(r"[0-9A-Fa-f+(][0-9A-Fa-f+().:/\x20-]{6,}[0-9A-Fa-f)]")


def _near_digits(pattern, text):
    """Matches of a pattern inside the stretches that look like numbers; the rest of the text is skipped."""
    for stretch in _NUMBERY.finditer(text):
        if _HAS_DIGIT.search(stretch[0]):
            yield from pattern.finditer(text, stretch.start(), stretch.end())


# --- the model -------------------------------------------------------------------------------


class Model(NamedTuple):
    """weights[kind, feature + vote + bias] of the span classifier and reliability[kind, labeler, class, vote]."""

    weights: np.ndarray
    reliability: np.ndarray
    prior: np.ndarray


#: Labelers whose votes the classifier sees: all but the strict pattern, which further candidates lack.
SEEN = LABELERS - 1


def _inputs(votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """What the classifier sees of each pattern: shape features, no and yes votes, bias."""
    v = _votes(votes)[:, 1:]
    shape = (features[:, None] >> np.arange(FEATURES)) & 1
    return np.concatenate([shape, v == 1, v == 2, np.ones((len(v), 1))], axis=1).astype(float)


def _every_vote() -> tuple[np.ndarray, np.ndarray]:
    """All votes of the seen labelers, with no shape feature and with each one alone."""
    n = 3**SEEN
    votes = sum(((np.arange(n) // 3**j % 3) << (2 * (j + 1))) for j in range(SEEN))
    shapes = np.array([0, *(1 << i for i in range(FEATURES))])
    return np.repeat(votes, len(shapes)), np.tile(shapes, n)


def _votes(bits: np.ndarray) -> np.ndarray:
    return np.stack([(bits >> (2 * i)) & 3 for i in range(LABELERS)], axis=1)


def _posterior(prior: float, reliability: np.ndarray, v: np.ndarray) -> np.ndarray:
    logit = np.log(prior / (1 - prior)) * np.ones(len(v))
    for j in range(1, LABELERS):  # the strict pattern is not evidence against the others
        logit += np.log(reliability[j, 1, v[:, j]] / reliability[j, 0, v[:, j]])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def estimate(patterns: list[tuple[int, int, int, int]], rounds: int = 50) -> Model:
    """EM over (kind, votes, features, n), then logistic regression on its posteriors.

    The start takes each labeler's word: a class is likelier the more yes votes it has. Smoothing
    keeps labelers that never vote neutral. The strict pattern's yes is trusted throughout, which
    fixes what the two classes mean. A share UNSEEN of the regression's weight lies on all
    votes that labelers can give, at the posterior EM has for them, so that a form which the corpus
    hardly has is judged by the labelers' reliabilities.
    """
    k = len(KINDS)
    weights = np.zeros((k, FEATURES + 2 * SEEN + 1))
    weights[:, -1] = -4.0
    reliability = np.full((k, LABELERS, 2, 3), 1 / 3)
    prior = np.full(k, 0.5)
    for kind in range(k):
        rows = [p for p in patterns if p[0] == kind]
        if not rows:
            continue
        v = _votes(np.array([p[1] for p in rows]))
        n = np.array([p[3] for p in rows], float)
        x = _inputs(np.array([p[1] for p in rows]), np.array([p[2] for p in rows]))
        q = 1 / (1 + np.exp(-((v == 2).sum(1) - 1.5 * (v == 1).sum(1))))
        sure = v[:, 0] == 2
        for _ in range(rounds):
            q = np.where(sure, 0.999, q)
            prior[kind] = np.clip(((n * q).sum() + 1) / (n.sum() + 2), 0.02, 0.98)
            for j in range(LABELERS):
                for vote in range(3):
                    hit = v[:, j] == vote
                    pull = 3.0 if vote == 0 else (2.0 if vote == 2 else 1.0)
                    push = 3.0 if vote == 0 else (1.0 if vote == 2 else 2.0)
                    reliability[kind, j, 1, vote] = (n * q)[hit].sum() + pull
                    reliability[kind, j, 0, vote] = (n * (1 - q))[hit].sum() + push
                reliability[kind, j] /= reliability[kind, j].sum(1, keepdims=True)
            q = _posterior(prior[kind], reliability[kind], v)
        q = np.where(sure, 0.999, q)
        votes, shapes = _every_vote()
        x = np.concatenate([x, _inputs(votes, shapes)])
        q = np.concatenate([q, _posterior(prior[kind], reliability[kind], _votes(votes))])
        h = np.concatenate([n / n.sum() * (1 - UNSEEN), np.full(len(votes), UNSEEN / len(votes))])
        w = weights[kind]
        for _ in range(3000):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 0.5 * (x.T @ (h * (p - q)) + 1e-5 * w)
    return Model(weights, reliability, prior)


def probability(model: Model, kind: str, votes: int, features: int) -> float:
    """What the classifier says of the votes and the shape of a candidate."""
    w = model.weights[KINDS.index(kind)]
    z = w[-1] + sum(w[i] for i in range(FEATURES) if features >> i & 1)
    for j in range(SEEN):
        vote = (votes >> (2 * (j + 1))) & 3
        z += w[FEATURES + (vote - 1) * SEEN + j] if vote else 0.0
    return float(1 / (1 + np.exp(-z)))


def accepted(model: Model, kind: str, votes: int, features: int) -> bool:
    """The classifier decides; the votes count through the posteriors that it learned from."""
    return probability(model, kind, votes, features) >= ACCEPT


def all_spans(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both ordered; the added ones overlap neither base spans nor each other."""
    base = base_spans(text)
    if not text:
        return base, base
    added: list[Span] = []  # ascending and disjoint
    for span, votes, features, is_base in candidates(text, base):
        if not is_base and accepted(model, span.kind, votes, features):
            k = bisect_left(added, span.start, key=lambda s: s.start)
            if (not k or added[k - 1].end <= span.start) and (k == len(added) or span.end <= added[k].start):
                added.insert(k, span)
    return base, ordered([*base, *added]) if added else base


def fit(docs: DataFrame) -> Model:
    """Votes and features of all candidates of all whole texts, summed, then estimated.

    What reaches the driver are counts of (kind, votes, features), whose number of combinations is
    bounded by the labelers, whatever the number of documents.
    """
    import pyarrow as pa

    def count(batches):
        sums: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                for span, votes, features, _ in candidates(text, base_spans(text)):
                    key = (KINDS.index(span.kind), votes, features)
                    sums[key] = sums.get(key, 0) + 1
        if sums:
            cols = [pa.array([k[i] for k in sums], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(sums.values()), pa.int64())], names=["k", "v", "f", "n"])

    small_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(tidy(count), "k long, v long, f long, n long")
    rows = counted.groupBy("k", "v", "f").agg(F.sum("n").alias("n")).collect()
    return estimate(sorted((r.k, r.v, r.f, r.n) for r in rows))


def find(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_spans (all spans).

    Null and empty texts have no spans. Repeated rows are judged one by one. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def make():
        own = Model(*shared.value)

        def judge(texts):
            rows = []
            for text in texts:
                base, every = all_spans(text, own)
                counts = [sum(s.kind == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)))
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7)]

        return judge

    return map_texts(docs, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", keep)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with all spans replaced in text, in the columns and types it had."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def make():
        own = Model(*shared.value)
        return lambda texts: ([t and redacted(t, all_spans(t, own)[1]) for t in texts],)

    name = fresh(docs, "_text")
    others = [c for c in docs.columns if c != "text"]
    clean = map_texts(docs, make, f"`{name}` string", others)
    return clean.select(*[F.col(name).alias("text") if c == "text" else quoted(c) for c in docs.columns])
