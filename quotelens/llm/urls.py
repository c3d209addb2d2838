"""URL filtering: host and path rules, then a character language-model ratio.

The rules judge the URLs that they fit. Those URLs are also the training text of two smoothed
variable-order Markov models over characters, one for accepted and one for rejected URLs. All
other URLs get the sign of the calibrated, length-normalised log-likelihood difference.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.llm.common import cut, map_texts, mix64

#: (host/path, verdict): fixed values of the query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
ORDERS = 5
STRENGTH = 2.0
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *_LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(host, empty), F.coalesce(path, empty)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits.

    The rules are a fixed list, so they become one expression: no join, no Python.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        on, _, below = text.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + below)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(texts: list[str]):
    """For the bytes of all texts: 64-bit names of contexts and of context+byte, an array per order; owner of each byte."""
    raws = [("\x02" + (t or "") + "\x03").encode() for t in texts]
    data = np.frombuffer(b"".join(raws), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raws])
    owner = np.repeat(np.arange(len(raws)), sizes)
    first = np.cumsum(sizes) - sizes
    offset = np.arange(len(data)) - first[owner]
    context = np.zeros(len(data), np.uint64)
    out = []
    for k in range(ORDERS + 1):
        if k:  # the byte k places back; before the text there is the symbol 0
            back = np.zeros(len(data), np.uint64)
            back[k:] = data[: len(data) - k] + np.uint64(1) if k < len(data) else 0
            back[offset < k] = 0
            with np.errstate(over="ignore"):
                context = mix64(context * np.uint64(257) + back + np.uint64(k))
        with np.errstate(over="ignore"):
            gram = mix64(context + (data + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            out.append((mix64(context + np.uint64(77 + k)).astype(np.int64), gram.astype(np.int64)))
    return out, owner, sizes


def _count_columns(texts, classes):
    """Names of one batch's contexts and grams, and how often each class has them."""
    grams, owner, _ = _grams(texts)
    of = np.tile(np.asarray(classes)[owner], 2 * len(grams))
    names, at = np.unique(np.concatenate([x for pair in grams for x in pair]), return_inverse=True)
    return names, np.bincount(at[of == 0], minlength=len(names)), np.bincount(at[of == 1], minlength=len(names))


def train(urls: DataFrame) -> np.ndarray:
    """Sorted names of all contexts and grams in rows of urls (url, says), and their counts in
    accepted and in rejected urls: three rows of integers.

    Every url counts, and no two contexts or grams share a count. So what reaches the driver grows
    with the distinct contexts and grams: 24 bytes each.
    """
    import pyarrow as pa

    def count(batches):
        for b in batches:
            if b.num_rows:
                says = [0 if x == "allow" else 1 for x in b.column(1).to_pylist()]
                columns = _count_columns(b.column(0).to_pylist(), says)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["k", "allow", "block"])

    rows = urls.select("url", "says").mapInArrow(count, "k long, allow long, block long")
    got = rows.groupBy("k").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).toArrow()
    table = np.stack([got.column(c).to_numpy() for c in ("k", "allow", "block")]).astype(np.int64)
    return table[:, np.argsort(table[0])]


def _counts(model: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Counts of the named contexts or grams, a row for each class."""
    if not model.shape[1]:
        return np.zeros((2, len(names)))
    own, back = np.unique(names, return_inverse=True)
    at = np.minimum(np.searchsorted(model[0], own), model.shape[1] - 1)
    return np.where(model[0][at] == own, model[1:, at], 0)[:, back].astype(float)


def ratios(texts: list[str], model: np.ndarray) -> np.ndarray:
    """log P(url | accepted) - log P(url | rejected), per character."""
    if not texts:
        return np.zeros(0)
    grams, owner, sizes = _grams(texts)
    p = np.full((2, len(owner)), 1 / 257)
    for context, gram in grams:
        seen = _counts(model, context)
        p = (_counts(model, gram) + STRENGTH * p) / (seen + STRENGTH)
    logs = np.log(p)
    return np.bincount(owner, weights=logs[0] - logs[1], minlength=len(texts)) / sizes


_models: dict = {}


def _model(key, shared):
    if key not in _models:
        _models.clear()
        _models[key] = np.frombuffer(shared.value, np.int64).reshape(3, -1)
    return _models[key]


def judge(pages: DataFrame, rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of pages (all but html by default) with host, path, rule, verdict, ratio.

    Three quarters of the ruled urls, by hash, train the models; the rest calibrate the
    threshold, at which the mean of the two error rates is least. Without ruled urls of both
    kinds the threshold is 0 and everything that no rule blocks is allowed. Null urls have an
    empty host and path and are judged by the models as the empty text. Repeated rows are judged
    alike. Columns called like an output column give way.
    """
    made = ("host", "path", "rule", "verdict", "ratio")
    keep = [c for c in (keep or pages.columns) if c.lower() not in (*made, "html")]
    host, path = host_and_path(F.col("url"))
    base = pages.select(*keep, *([] if "url" in keep else ["url"]), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("_says", verdict)
    base = base.withColumn("_text", F.concat("host", "path"))
    ruled = base.filter("_says is not null").select(F.col("_text").alias("url"), F.col("_says").alias("says"))
    held = F.pmod(F.xxhash64("url"), F.lit(4)) == 0
    counts = train(ruled.filter(~held))
    sc = pages.sparkSession.sparkContext
    shared, key = sc.broadcast(counts.tobytes()), uuid.uuid4().hex

    def make():
        model = _model(key, shared)
        return lambda texts: (ratios(texts, model),)

    threshold = _calibrated(map_texts(ruled.filter(held), make, "ratio double", ["says"], column="url"))
    cols = [c for c in base.columns if c != "_text"]
    scored = map_texts(base, make, "ratio double", cols, column="_text")
    by_model = F.when(F.col("ratio") >= F.lit(threshold), "allow").otherwise("block")
    return scored.withColumn("verdict", F.coalesce("_says", by_model)).select(*keep, "host", "path", "rule", "verdict", "ratio")


def _calibrated(scored: DataFrame, bins: int = 4000, wide: float = 10.0) -> float:
    """The threshold with the least mean error, from a histogram of all held-out scores."""
    slot = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("ratio") + wide) / (2 * wide) * bins)))
    rows = scored.groupBy("says", slot.alias("slot")).count().collect()  # at most 2 * bins rows
    hist = {"allow": np.zeros(bins), "block": np.zeros(bins)}
    for r in rows:
        hist[r["says"]][int(r["slot"])] += r["count"]
    if not hist["allow"].sum() or not hist["block"].sum():
        return 0.0
    missed = np.concatenate([[0], np.cumsum(hist["allow"])]) / hist["allow"].sum()
    passed = 1 - np.concatenate([[0], np.cumsum(hist["block"])]) / hist["block"].sum()
    error = missed + passed
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(best[len(best) // 2] / bins * 2 * wide - wide)
