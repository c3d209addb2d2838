"""Quality: a byte-level convolutional network in numpy.

The UTF-8 bytes of the whole document are cut into overlapping chunks. Learned filters run over
the bytes of each chunk and the largest response of every filter is kept; a small layer reads
those maxima, the largest of its outputs over all chunks is kept, and a logistic layer makes one
probability of them.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.common import crc_mod, least_errors, map_texts

#: Bytes of a chunk and how far the next one begins; a filter's width and its stride.
CHUNK, STEP = 256, 192
WIDTH, STRIDE = 8, 4
DIM, FILTERS, HIDDEN = 6, 24, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1
TRAIN_ROWS, TRAIN_CHARS = 2500, 6_000
#: Steps of training at least; rows below which calibration takes turns.
STEPS, SMALL = 400, 1500
#: The contract's threshold, at which the calibrated threshold stands.
AT = 0.3


def chunks(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks as bytes + 1 with 0 as filling, owner of each chunk, filled share of each chunk).

    Every byte of a text is in a chunk: the last chunk ends where the text ends. An empty or null
    text is one chunk of filling.
    """
    parts, owner, filled = [], [], []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        n = len(raw)
        if n <= CHUNK:
            starts = [0]
        else:
            starts = list(range(0, n - CHUNK, STEP)) + [n - CHUNK]
        for s in starts:
            parts.append(raw[s : s + CHUNK].ljust(CHUNK, b"\xff"))  # 0xff is no byte of UTF-8
            owner.append(i)
            filled.append(min(n - s, CHUNK) / CHUNK if n else 0.0)
    x = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, CHUNK)
    x = (x.astype(np.int16) + 1) % 256
    return x.astype(np.uint8), np.array(owner), np.array(filled, np.float32)


class Net:
    """Parameters and the forward pass; picklable."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = np.float32
        self.e = r.normal(0, 0.5, (256, DIM)).astype(f)
        self.e[0] = 0
        self.w = r.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(f)
        self.u = r.normal(0, 1 / np.sqrt(FILTERS), (FILTERS + 1, HIDDEN)).astype(f)
        self.c = np.zeros(HIDDEN, f)
        self.v = r.normal(0, 0.3, HIDDEN).astype(f)
        self.bias = np.zeros(1, f)
        self.shift = 0.0

    def params(self) -> list[np.ndarray]:
        return [self.e, self.w, self.u, self.c, self.v, self.bias]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each chunk."""
        out = np.empty((len(x), FILTERS), np.float32)
        for a in range(0, len(x), 512):  # bounded memory whatever the text
            part = self.e[x[a : a + 512]]
            flat = np.lib.stride_tricks.as_strided(
                part.reshape(len(part), -1),
                (len(part), PLACES, WIDTH * DIM),
                (part.strides[0], STRIDE * DIM * 4, 4),
            )
            out[a : a + 512] = (flat.reshape(-1, WIDTH * DIM) @ self.w).reshape(len(part), PLACES, FILTERS).max(1)
        return out

    def logits(self, texts: list[str | None]) -> np.ndarray:
        x, owner, filled = chunks(texts)
        z = np.maximum(np.hstack([self.pooled(x), filled[:, None]]) @ self.u + self.c, 0)
        firsts = np.flatnonzero(np.diff(owner, prepend=-1))
        return np.maximum.reduceat(z, firsts, axis=0) @ self.v + self.bias[0]


def train(texts: list[str], y: np.ndarray, batch: int = 32, seed: int = 11) -> Net:
    """Adam on the class-balanced logistic loss over whole documents."""
    net = Net(seed)
    if not len(y) or y.min() == y.max():
        net.v[:] = 0
        net.bias[:] = 4.0 if len(y) and y.min() == 1 else (-4.0 if len(y) else 0.0)
        return net
    r = np.random.default_rng(seed)
    ready = [chunks([t]) for t in texts]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m = [np.zeros_like(p) for p in net.params()]
    s = [np.zeros_like(p) for p in net.params()]
    t = 0
    epochs = min(24, max(8, STEPS * batch // len(y)))
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for a in range(0, len(y), batch):
            own = order[a : a + batch]
            x = np.concatenate([ready[i][0] for i in own])
            filled = np.concatenate([ready[i][2] for i in own])[:, None]
            owner = np.repeat(np.arange(len(own)), [len(ready[i][0]) for i in own])
            firsts = np.flatnonzero(np.diff(owner, prepend=-1))
            emb = net.e[x]
            flat = np.lib.stride_tricks.as_strided(
                emb.reshape(len(emb), -1), (len(emb), PLACES, WIDTH * DIM), (emb.strides[0], STRIDE * DIM * 4, 4)
            )
            resp = flat.reshape(-1, WIDTH * DIM) @ net.w
            resp = resp.reshape(len(emb), PLACES, FILTERS)
            top = resp.argmax(1)
            q = np.hstack([np.take_along_axis(resp, top[:, None, :], 1)[:, 0], filled])
            pre = q @ net.u + net.c
            z = np.maximum(pre, 0)
            doc = np.maximum.reduceat(z, firsts, axis=0)
            p = 1 / (1 + np.exp(-np.clip(doc @ net.v + net.bias[0], -30, 30)))
            g = ((p - y[own]) * weight[own] / len(own)).astype(np.float32)
            gv, gb = doc.T @ g, np.array([g.sum()], np.float32)
            # the chunk that wins a hidden unit carries its gradient
            gz = np.zeros_like(z)
            wins = (z == doc[owner]) & (z > 0)
            share = np.add.reduceat(wins, firsts, axis=0).clip(1)
            gz[:] = wins * (g[:, None] * net.v / share)[owner]
            gu, gc = q.T @ gz, gz.sum(0)
            gq = (gz @ net.u.T)[:, :FILTERS]
            gw = np.zeros_like(net.w)
            ge = np.zeros_like(net.e)
            rows = np.arange(len(emb))
            for f in range(FILTERS):
                at = top[:, f] * STRIDE
                if not gq[:, f].any():
                    continue
                cols = at[:, None] + np.arange(WIDTH)
                won = emb[rows[:, None], cols].reshape(len(emb), -1)
                gw[:, f] = won.T @ gq[:, f]
                np.add.at(ge, x[rows[:, None], cols], gq[:, f, None, None] * net.w[:, f].reshape(WIDTH, DIM))
            ge[0] = 0
            t += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k, (par, grad) in enumerate(zip(net.params(), [ge, gw, gu, gc, gv, gb])):
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.99 * s[k] + 0.01 * grad**2
                par -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)
    return net


def scores(net: Net, texts: list[str | None]) -> np.ndarray:
    """0 to 1, higher: better text; AT at the calibrated threshold."""
    if not texts:
        return np.zeros(0)
    logit = net.logits(texts).astype(np.float64) - net.shift
    return 1 / (1 + np.exp(-np.clip(logit + np.log(AT / (1 - AT)), -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Net:
    """Learn from at most `rows` labelled rows a class of at most `chars` characters, chosen by hash.

    Rows whose crc32(doc_id) mod 5 is 0 are never read. Of documents with one id the one of the least
    text hash counts. A fifth of the sample calibrates.
    """
    allowed = labels.filter("doc_id is not null and quality is not null").filter(crc_mod(F.col("doc_id"), 5) != 0)
    chosen = None
    for c in (0, 1):
        part = allowed.filter(F.col("quality") == c).select("doc_id", "quality").distinct()
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    got = (
        docs.filter(F.col("text").isNotNull() & (F.length("text") <= chars))
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .select("doc_id", "text", "quality")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("text", "ascending")])
    )
    texts = got.column("text").to_pylist()
    y = np.array(got.column("quality").to_pylist(), dtype=np.float64)
    return learn(texts, y, got.column("doc_id").to_pylist())


def learn(texts: list[str], y: np.ndarray, ids: list[int]) -> Net:
    """A trained net whose best threshold (least errors, a good text taken for a bad one counting
    twice) falls on the score AT. Of a large sample a fifth calibrates; a small one calibrates on
    the logits that each fifth gets from a net trained on the others."""
    if not len(y) or y.min() == y.max():
        return train(texts, y)
    fold = np.array([zlib.crc32(f"calibrate{i}".encode()) % 5 for i in ids])
    folds = [0] if len(y) >= SMALL else range(5)
    logit, net = np.zeros(len(y)), None
    for k in folds:
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        net = train([texts[i] for i in rest], y[rest])
        if len(own):
            logit[own] = net.logits([texts[i] for i in own])
    tested = np.isin(fold, list(folds))
    if len(folds) > 1:
        net = train(texts, y)
    if tested.any() and y[tested].min() < y[tested].max():
        net.shift = least_errors(logit[tested], y[tested], 2.0, 1.0)
    return net


_nets: dict = {}


def _net(key, shared):
    if key not in _nets:
        _nets.clear()
        _nets[key] = shared.value
    return _nets[key]


def score(docs: DataFrame, net: Net, keep: list[str]) -> DataFrame:
    """Columns `keep` with score. Null and empty texts are one chunk of filling; every text is read
    whole; repeated rows get equal scores."""
    shared, key = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex

    def make():
        own = _net(key, shared)
        return lambda texts: (scores(own, texts),)

    return map_texts(docs, make, "score double", keep)
