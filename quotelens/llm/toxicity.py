"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word's embedding is the scaled sum of hashed vectors of the word and its 4- to 6-byte pieces, so
inflected forms share what their stems have learned. Filters over 1, 2 and 3 consecutive words
respond along the whole text; the largest response of each filter is kept, and a logistic layer
makes one logit of them. Thresholds are calibrated for each language that function words of the
text itself show (no column is read for it) and moved to one common score.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.common import crc_mod, cut, drop, least_errors, map_texts, mix64, small_batches, tidy
from quotelens.llm.links import _by_cell

BUCKETS = 1 << 15
#: Bytes of the hashed pieces of words.
GRAMS = (4, 5, 6)
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: The common threshold that each language's calibrated threshold is moved to.
AT = 0.7
#: Characters of labelled text that one place learns from at a time, and how often places share what they have learned.
PART_CHARS, ROUNDS = 4_000_000, 2
#: Sums of parameters are whole numbers of 1 / FINE, so that their order does not matter; logits are counted by 1 / FINE_LOGIT.
FINE, FINE_LOGIT = 1e6, 1024
WORD = re.compile(r"[^\W_]+")
#: Steps of training at least; rows below which calibration takes turns.
STEPS, SMALL = 8000, 2000
#: Frequent function words that tell the languages apart: our own lists.
MARKS = {
    "en": {"the", "of", "and", "in", "that", "is", "it", "for", "was", "with"},
    "de": {"der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf"},
    "fr": {"les", "et", "des", "du", "une", "est", "dans", "pour", "par", "au"},
    "es": {"que", "el", "los", "se", "las", "por", "con", "una", "su", "del"},
}
LANGS = ("other", *MARKS)


def text_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


MARK_OF = {w: i for i, marks in enumerate(MARKS.values(), 1) for w in marks}


_BASE = np.uint64(0x100000001B3)


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets [position, gram] of the words' bytes, which of them exist, and where each word begins.

    A word is marked as <word>. At each byte begin its grams of GRAMS bytes; in the last column,
    at the first byte, stands the whole word.
    """
    raws = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64)
    firsts = np.cumsum(sizes) - sizes
    left = np.repeat(firsts + sizes, sizes) - np.arange(len(data))  # bytes from here to the word's end
    ids = np.zeros((len(data), len(GRAMS) + 1), np.int64)
    there = np.zeros(ids.shape, bool)
    with np.errstate(over="ignore"):
        h = np.zeros(len(data), np.uint64)
        padded = np.concatenate([data, np.zeros(max(GRAMS), np.uint64)])
        for n in range(1, max(GRAMS) + 1):
            h = h * _BASE + padded[n - 1 : n - 1 + len(data)] + np.uint64(1)
            if n in GRAMS:
                k = GRAMS.index(n)
                ids[:, k] = (mix64(h + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64)
                there[:, k] = left >= n
    ids[firsts, -1] = [zlib.crc32(r) % BUCKETS for r in raws]
    there[firsts, -1] = True
    return ids, there, firsts


class Known:
    """The words of lists of words, numbered, with all buckets in one row: no object for each word. An empty
    list is the one empty word."""

    def __init__(self, docs: list[list[str]]):
        words = sorted({w for d in docs for w in d} | {""})
        ids, there, firsts = gram_hashes(words)
        self.sizes = np.add.reduceat(there.sum(1), firsts)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = ids[there].astype(np.int32)
        index = dict(zip(words, range(len(words))))
        counts = np.array([max(len(d), 1) for d in docs])
        self.words = np.fromiter((index[w] for d in docs for w in d or [""]), np.int32, counts.sum())
        self.at = np.concatenate([[0], np.cumsum(counts)])

    def doc(self, i: int) -> np.ndarray:
        """Numbers of a list's words."""
        return self.words[self.at[i] : self.at[i + 1]]

    def buckets(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, sizes, firsts): the buckets of words, one after the other, and how many and where each word's are."""
        sizes = self.sizes[numbers]
        firsts = np.cumsum(sizes) - sizes
        return self.ids.take(np.repeat(self.starts[numbers] - firsts, sizes) + np.arange(sizes.sum())), sizes, firsts


class Net:
    """Parameters and the forward pass; picklable."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.w = [r.normal(0, 0.1, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for w in self.w:  # the first filter of each width starts at what counts have found
            w[:, 0, 0] = 1.0
        self.b = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = r.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out[::FILTERS] = 2.0
        self.bias = np.float32(-1.0)
        self.shift = np.zeros(len(LANGS), np.float32)

    def vectors(self, vocab: list[str]) -> np.ndarray:
        """One embedding for each word."""
        ids, there, firsts = gram_hashes(vocab)
        at_byte = np.zeros((len(ids), DIM), np.float32)
        for k in range(ids.shape[1]):
            at_byte += self.e[ids[:, k]] * there[:, k : k + 1]
        sizes = np.add.reduceat(there.sum(1), firsts)
        return (np.add.reduceat(at_byte, firsts, axis=0) / np.sqrt(sizes)[:, None]).astype(np.float32)

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter responses at each word; words after the end are zero vectors."""
        out = []
        for w in self.w:
            k = w.shape[0]
            padded = np.vstack([x, np.zeros((k - 1, DIM), np.float32)]) if k > 1 else x
            out.append(sum(padded[o : o + len(x)] @ w[o] for o in range(k)))
        return out

    def judge(self, docs: list[list[str]], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """A logit and an index in LANGS for each list of words; texts without words count as one
        zero vector. The language is the one whose function words are most frequent; none: other."""
        ids, sizes = vocab.number(docs, self)
        gap = max(WIDTHS)
        firsts = np.cumsum(sizes + gap) - sizes - gap
        owner = np.repeat(np.arange(len(docs)), sizes)
        at = firsts[owner] + np.arange(len(ids)) - (np.cumsum(sizes) - sizes)[owner]
        x = np.zeros((int((sizes + gap).sum()), DIM), np.float32)
        x[at] = vocab.table[ids]
        pooled = np.hstack([np.maximum.reduceat(r, firsts, axis=0) for r in self.responses(x)])
        logit = np.maximum(pooled + self.b, 0) @ self.out + self.bias
        marks = np.bincount(owner * len(LANGS) + vocab.mark[ids], minlength=len(docs) * len(LANGS))
        marks = marks.reshape(-1, len(LANGS))
        marks[:, 0] = 0
        return logit, marks.argmax(1)


class Vocabulary:
    """Numbers, embeddings and languages of the words seen; starts again when it holds MOST words."""

    MOST = 150_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, DIM), np.float32)
        self.mark = np.zeros(1024, np.int8)

    def number(self, docs: list[list[str]], net: Net) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, one after the other, and the number of words of each list."""
        if len(self.index) > self.MOST:
            self.clear()
        fresh = list({w for d in docs for w in d} - self.index.keys())
        if fresh:
            at = len(self.index)
            self.index.update(zip(fresh, range(at, at + len(fresh))))
            if at + len(fresh) > len(self.table):
                more = max(len(self.table) * 2, at + len(fresh)) - len(self.table)
                self.table = np.vstack([self.table, np.zeros((more, DIM), np.float32)])
                self.mark = np.concatenate([self.mark, np.zeros(more, np.int8)])
            for a in range(0, len(fresh), 20_000):
                part = fresh[a : a + 20_000]
                self.table[at + a : at + a + len(part)] = net.vectors(part)
            self.mark[at : at + len(fresh)] = [MARK_OF.get(w, 0) for w in fresh]
        sizes = np.array([len(d) for d in docs])
        get = self.index.__getitem__
        return np.fromiter(map(get, chain.from_iterable(docs)), np.int64, sizes.sum()), sizes


def _seen(docs: list[list[str]], y: np.ndarray, known: Known) -> np.ndarray:
    """In how many clean and toxic texts each bucket occurs."""
    seen, own = np.zeros((2, BUCKETS), np.int64), np.zeros(BUCKETS, bool)
    for i, label in enumerate(y):
        if docs[i]:
            own[:] = False
            own[known.buckets(np.unique(known.doc(i)))[0]] = True
            seen[int(label)] += own
    return seen


def _counted(net: Net, seen: np.ndarray, rate: float) -> None:
    """Start the first dimension at how far a bucket's share of toxic texts is from chance, in deviations."""
    rate = max(rate, 1e-6)
    n = seen.sum(0)
    z = (seen[1] - rate * n) / np.sqrt(rate * (1 - rate) * n + 1.0)
    net.e[:, 0] = np.where(z > 4, np.minimum(z / 10, 1.0), 0.0)


def _untaught(seed: int = 7) -> Net:
    """What stands where labels of one class only, or none, are there: every text is clean."""
    net = Net(seed)
    net.bias = np.float32(-4.0)
    net.out[:] = 0
    return net


def train(docs: list[list[str]], y: np.ndarray, seed: int = 7) -> Net:
    """A net that has learned from these texts in one place."""
    if not docs or y.min() == y.max():
        return _untaught(seed)
    net, known = Net(seed), Known(docs)
    _counted(net, _seen(docs, y, known), y.mean())
    _descend(net, y, known, min(12, max(3, STEPS // len(docs))), seed)
    return net


def _descend(net: Net, y: np.ndarray, known: Known, times: int, seed: int) -> np.ndarray:
    """Adagrad on the logistic loss, document by document; only the words that win a filter get a gradient.
    Returns how often each bucket was changed."""
    r, changed = np.random.default_rng(seed), np.zeros(BUCKETS, np.int64)
    acc = {"e": np.full((BUCKETS, DIM), 1e-2, np.float32), "out": np.full(net.out.shape, 1e-2, np.float32), "b": np.full(net.b.shape, 1e-2, np.float32), "w": [np.full(w.shape, 1e-2, np.float32) for w in net.w], "bias": 1e-2}
    for _ in range(times):
        for i in r.permutation(len(y)):
            vocab, index = np.unique(known.doc(i), return_inverse=True)
            flat, sizes, firsts = known.buckets(vocab)
            v = np.add.reduceat(net.e.take(flat, axis=0), firsts, axis=0) / np.sqrt(sizes)[:, None]
            v = v.astype(np.float32)
            rs = _of_words(net.w, v, index)
            top = [q.argmax(0) for q in rs]
            pooled = np.concatenate([q[t, np.arange(FILTERS)] for q, t in zip(rs, top)]) + net.b
            active = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.bias, -30, 30)))
            g = np.float32(p - y[i])
            g_active = g * net.out * (pooled > 0)
            _step(net.out, acc["out"], g * active)
            acc["bias"] += float(g) ** 2
            net.bias -= np.float32(0.05 * g / np.sqrt(acc["bias"]))
            _step(net.b, acc["b"], g_active)
            words, grads = [], []
            for j, w in enumerate(net.w):
                part = g_active[j * FILTERS : (j + 1) * FILTERS]
                gw = np.zeros_like(w)
                for o in range(len(w)):
                    at = top[j] + o
                    ok = (at < len(index)) & (part != 0)
                    word = index[at[ok]]
                    gw[o][:, ok] = (v[word] * part[ok, None]).T
                    words.append(word)
                    grads.append((w[o][:, ok] * part[ok]).T / np.sqrt(sizes[word])[:, None])
                _step(w, acc["w"][j], gw)
            word, grad = np.concatenate(words), np.concatenate(grads)
            if len(word):  # what all filters ask of a bucket is one step
                n = sizes[word]
                own = flat[np.repeat(firsts[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                order = np.argsort(own, kind="stable")
                own, grad = own[order], grad[np.repeat(np.arange(len(n)), n)[order]]
                head = np.flatnonzero(np.diff(own, prepend=-1))
                own, often = own[head], np.diff(np.append(head, len(own)))
                acc["e"][own] += np.add.reduceat(grad**2, head, axis=0)
                net.e[own] -= 0.04 * np.add.reduceat(grad, head, axis=0) / np.sqrt(acc["e"].take(own, axis=0))
                changed[own] += often
    return changed


def _of_words(filters: list[np.ndarray], v: np.ndarray, index: np.ndarray) -> list[np.ndarray]:
    """Net.responses() at each word of a text, from the responses to its distinct words v."""
    z = (v @ np.concatenate([w[o] for w in filters for o in range(len(w))], axis=1)).take(index, axis=0)
    out, at = [], 0
    for w in filters:
        q = z[:, at : at + FILTERS]
        for o in range(1, len(w)):
            q[: len(q) - o] += z[o:, at + o * FILTERS : at + (o + 1) * FILTERS]
        out.append(q)
        at += len(w) * FILTERS
    return out


def _step(p: np.ndarray, acc: np.ndarray, g: np.ndarray, rate: float = 0.03) -> None:
    acc += g**2
    p -= rate * g / np.sqrt(acc)


def calibrate(net: Net, logit: np.ndarray, lang: np.ndarray, y: np.ndarray) -> None:
    """Set each language's shift so that its best threshold on held-out rows becomes the score AT.

    Best: least errors, a clean text taken for toxic counting twice. A language with fewer than
    ten rows of either class takes the threshold of all rows.
    """
    if not len(y) or y.min() == y.max():
        return
    common = least_errors(logit, y, 1.0, 2.0)
    for i in range(len(LANGS)):
        own = lang == i
        few = min(y[own].sum(), (1 - y[own]).sum()) < 10
        net.shift[i] = common if few else least_errors(logit[own], y[own], 1.0, 2.0)


def scores(net: Net, texts: list[str | None], vocab: Vocabulary) -> np.ndarray:
    """0 to 1; AT where the logit is the threshold of the text's language."""
    if not texts:
        return np.zeros(0)
    logit, lang = net.judge([text_words(t) for t in texts], vocab)
    return 1 / (1 + np.exp(-np.clip((logit - net.shift[lang]).astype(np.float64) + np.log(AT / (1 - AT)), -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, chars: int = PART_CHARS) -> Net:
    """Learn from every labelled row and its whole text, but those whose crc32(doc_id) mod 3 is 1, which
    are never read.

    Rows are dealt by hash to parts of about `chars` characters. One part alone is learned from on the
    driver; else every part learns where it is (`learn_parts`). Repeated rows count as often as they are
    there; a doc_id with both labels is two rows."""
    ok = lambda: F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1)
    allowed = labels.filter(ok() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    texts = docs.filter(ok() & F.col("text").isNotNull()).select("doc_id", "text")
    # the size of a part comes from all texts that may have a label, without joining them twice
    size = docs.filter(ok()).agg(F.sum(F.length("text"))).first()[0] or 0
    number = max(1, -(-int(size) // (2 * chars)))  # about every second or third text has a label
    parts = cut(_parts(texts, allowed, number), frees=True)
    try:
        if number > 1:
            return learn_parts(parts)
        got = [x for p in parts.collect() for x in p.rows]
        return learn([text_words(x.text) for x in got], np.array([x.toxic for x in got], dtype=np.float64), [x.doc_id for x in got])
    finally:
        drop(parts)


def _parts(texts: DataFrame, allowed: DataFrame, number: int) -> DataFrame:
    """part, rows (doc_id, toxic, text): the labelled texts, in order. Texts and labels travel once, to their
    part, and meet there, whatever the size of the labels; texts without a label are left behind there."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, StructField, StructType

    small_batches(texts.sparkSession)
    kind, none = texts.schema["doc_id"].dataType, lambda t: F.lit(None).cast(t)
    both = texts.select("doc_id", none("int").alias("toxic"), "text")
    both = both.unionByName(allowed.select(F.col("doc_id").cast(kind).alias("doc_id"), "toxic", none("string").alias("text")))
    both = both.select(F.pmod(F.xxhash64("doc_id"), F.lit(number)).alias("part"), "doc_id", "toxic", "text")
    fields = StructType.fromDDL("toxic int, text string")
    row = StructType([StructField("doc_id", kind), *fields])
    schema = StructType([both.schema["part"], StructField("rows", ArrayType(row))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for t in _by_cell(batches):
            t = t.combine_chunks()
            code = t.column("doc_id").combine_chunks().dictionary_encode().indices.to_numpy()
            toxic = t.column("toxic").fill_null(-1).to_numpy()
            at, label = [], []
            for k in (0, 1):
                has = np.zeros(code.max() + 1, bool)
                has[code[toxic == k]] = True
                at.append(np.flatnonzero((toxic < 0) & has[code]))
                label.append(np.full(len(at[-1]), k, np.int32))
            at, label = np.concatenate(at), np.concatenate(label)
            if len(at):
                order = np.lexsort((at, label, code[at]))
                own = t.take(pa.array(at[order]))
                columns = [own.column("doc_id").combine_chunks(), pa.array(label[order]), own.column("text").combine_chunks()]
                kinds = arrow.field("rows").type.value_type
                rows = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds)], fields=list(kinds))
                rows = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), rows).cast(arrow.field("rows").type)
                yield pa.RecordBatch.from_arrays([own.column("part")[:1].combine_chunks(), rows], schema=arrow)

    dealt = both.repartition("part").sortWithinPartitions("part", "doc_id", "toxic", "text")
    return dealt.mapInArrow(tidy(run), schema)


def _fold(doc_id) -> int:
    return zlib.crc32(f"calibrate{doc_id}".encode()) % 5


def _each_part(parts: DataFrame, make, fields: str, held: bool) -> DataFrame:
    """The rows (lists of columns) that make(words, labels, part) gives of each part's rows: those of the
    fifth that calibrates, or all others."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(parts.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                rows = [x for x in batch.column(1)[i].as_py() if (_fold(x["doc_id"]) == 0) == held]
                if rows:
                    made = make([text_words(x["text"]) for x in rows], np.array([x["toxic"] for x in rows], dtype=np.float64), batch.column(0)[i].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema)], schema=schema)

    return parts.select("part", "rows").mapInArrow(tidy(run), fields)


def _flat(net: Net) -> np.ndarray:
    """The parameters beside the embeddings, in rows of DIM numbers."""
    x = np.concatenate([*(w.ravel() for w in net.w), net.b, net.out, [net.bias]])
    return np.concatenate([x, np.zeros(-len(x) % DIM)]).reshape(-1, DIM)


def _take(net: Net, x: np.ndarray) -> None:
    """The inverse of _flat()."""
    x = x.ravel().astype(np.float32)
    cuts = np.cumsum([*(w.size for w in net.w), net.b.size, net.out.size])
    *ws, net.b, net.out, rest = np.split(x, cuts)
    net.w, net.bias = [v.reshape(w.shape) for v, w in zip(ws, net.w)], rest[0]


def learn_parts(parts: DataFrame, seed: int = 7) -> Net:
    """A net learned from all parts (part, rows of doc_id, toxic, text), where they are.

    Counts are summed over all rows. Then, in each round, every part goes on from the common net, and
    the parts' nets are averaged: an embedding by how often each part changed it, the rest by rows. The
    thresholds come from all rows of the fifth that calibrates, by counts of their logits."""

    def count(docs, y, _):
        seen = _seen(docs, y, Known(docs))
        at = np.flatnonzero(seen.sum(0))
        return [np.append(at, BUCKETS), np.append(seen[0, at], (y == 0).sum()), np.append(seen[1, at], (y == 1).sum())]

    got = _each_part(parts, count, "at int, clean long, toxic long", False).groupBy("at").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).toArrow()
    seen = np.zeros((2, BUCKETS + 1), np.int64)
    seen[:, got.column("at").to_numpy()] = [got.column("c").to_numpy(), got.column("t").to_numpy()]
    if not seen[:, -1].all():
        return _untaught(seed)
    net, n = Net(seed), int(seen[:, -1].sum())
    _counted(net, seen[:, :-1], seen[1, -1] / n)
    times = max(1, min(12, STEPS // n) // ROUNDS)
    xs = [f"x{i}" for i in range(DIM)]
    for k in range(ROUNDS):
        shared = parts.sparkSession.sparkContext.broadcast(net)

        def go_on(docs, y, part, shared=shared, k=k):
            own = pickle.loads(pickle.dumps(shared.value))
            changed = _descend(own, y, Known(docs), times, seed + 1000 * k + int(part) % 1000)
            at, flat = np.flatnonzero(changed), _flat(own)
            weight = np.concatenate([changed[at], np.full(len(flat), len(y))])
            x = np.rint(np.vstack([own.e[at], flat]).astype(np.float64) * weight[:, None] * FINE).astype(np.int64)
            return [np.concatenate([at, BUCKETS + np.arange(len(flat))]), weight, *x.T]

        got = _each_part(parts, go_on, "at int, n long, " + ", ".join(f"{x} long" for x in xs), False)
        got = got.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in xs]).toArrow().sort_by("at")
        at = got.column("at").to_numpy()
        x = np.stack([got.column(c).to_numpy() for c in xs], 1) / (got.column("n").to_numpy()[:, None] * FINE)
        net.e[at[at < BUCKETS]] = x[at < BUCKETS]
        _take(net, x[at >= BUCKETS])
        shared.unpersist()
    shared = parts.sparkSession.sparkContext.broadcast(net)

    def judge(docs, y, _):
        logit, lang = shared.value.judge(docs, Vocabulary())
        return [np.rint(logit * FINE_LOGIT).astype(np.int64), lang, y.astype(int)]

    got = _each_part(parts, judge, "at long, lang int, toxic int", True).groupBy("at", "lang", "toxic").count().toArrow().to_pydict()
    often = np.array(got["count"], dtype=np.int64)
    logit, lang, y = (np.repeat(np.array(got[c]), often) for c in ("at", "lang", "toxic"))
    calibrate(net, logit / FINE_LOGIT, lang, y.astype(np.float64))
    return net


def learn(words: list[list[str]], y: np.ndarray, ids: list[int]) -> Net:
    """A trained and calibrated net. Of a large sample a fifth calibrates; a small one calibrates
    on the logits that each fifth gets from a net trained on the others."""
    if not len(y):
        return train([], y)
    fold = np.array([_fold(i) for i in ids])
    logit, lang = np.zeros(len(y)), np.zeros(len(y), int)
    folds = [0] if len(y) >= SMALL else range(5)
    net = None
    for k in folds:
        own = np.flatnonzero(fold == k)
        rest = np.flatnonzero(fold != k)
        net = train([words[i] for i in rest], y[rest])
        if len(own):
            logit[own], lang[own] = net.judge([words[i] for i in own], Vocabulary())
    tested = np.isin(fold, list(folds))
    if len(folds) > 1:
        net = train(words, y)
    calibrate(net, logit[tested], lang[tested], y[tested])
    return net


_nets: dict = {}


def _net(key, shared):
    if key not in _nets:
        _nets.clear()
        _nets[key] = (shared.value, Vocabulary())
    return _nets[key]


def score(docs: DataFrame, net: Net, keep: list[str], name: str = "score") -> DataFrame:
    """Columns `keep` with the score, called `name`. Null and empty texts are scored as texts without words; every
    text is read whole; repeated rows get equal scores."""
    shared, key = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex

    def make():
        own, vocab = _net(key, shared)
        return lambda texts: (scores(own, texts, vocab),)

    return map_texts(docs, make, f"`{name}` double", keep)
