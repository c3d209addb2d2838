"""Pairs of texts that share many rare grams, without a table of all pairs that share one.

Grams are dealt to layers by their hash. A pair that shares t grams shares t / LAYERS or more in some
layer, so pairs are counted inside a layer, where only those that reach this leave; pairs that chance
lets share a few grams never do. What is left is counted in the layers that did not name it. A layer
is cut into parts of the texts: a part holds each list of texts that has one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.operators.tokens import with_words

U = np.uint64
LAYERS = 16
#: Postings that a task gathers before it writes, and pairs that it counts at once.
POSTINGS, PAIRS = 1_500_000, 2_000_000
#: Bytes of input for each block of grams.
BLOCK_BYTES = 8 << 20


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes first: what sorted or small numbers share is compressed well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _joined(table, column: int, kind) -> np.ndarray:
    return np.concatenate([_numbers(x, kind) for x in table.column(column).to_pylist()] or [np.zeros(0, kind)])


def _distinct_grams(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, text of each) of texts as lists of rows of word hashes, each gram once for a text."""
    rows = words.flatten()
    text = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    row = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
    h = rows.flatten().to_numpy(zero_copy_only=False).view(U)
    m = max(len(h) - n + 1, 0)
    with np.errstate(over="ignore"):
        g = np.zeros(m, U)
        for i in range(n):
            g = g * U(0xBF58476D1CE4E5B9) + h[i : m + i]
        for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            g = (g ^ (g >> U(33))) * U(by)
        g ^= g >> U(33)
    whole = row[:m] == row[n - 1 :][:m]
    g, at = g[whole], text[row[:m][whole]]
    order = np.lexsort((g, at))
    g, at = g[order], at[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (at[1:] != at[:-1])
    return g[new], at[new]


def _written(texts: DataFrame, n: int, least: int, share: float, blocks: int) -> DataFrame:
    """block, grams, place, ids, needs: postings of the texts (id, words) by block of grams. A text's need is
    the number of grams that it shares as the smaller of a pair, 0 for the text without an id."""
    names = ["block", "grams", "place", "ids", "needs"]

    def flush(wait: list[tuple]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *(len(ids) for _, _, ids, _ in wait)])
        grams = np.concatenate([g for g, _, _, _ in wait])
        at = np.concatenate([x + b for (_, x, _, _), b in zip(wait, base)])
        ids, needs = np.concatenate([x for _, _, x, _ in wait]), np.concatenate([x for _, _, _, x in wait])
        order = np.argsort(grams)
        grams, at = grams[order], at[order]
        block = ((grams >> U(48)) * U(blocks) >> U(16)).astype(np.int64)
        edges = np.searchsorted(block, np.arange(blocks + 1)).tolist()
        for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if lo < hi:
                own, place = np.unique(at[lo:hi], return_inverse=True)
                blobs = [_planes(x) for x in (grams[lo:hi], place.astype(np.uint16), ids[own], needs[own])]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=names)

    def run(batches):
        wait, held, rows = [], 0, 0
        for b in batches:
            step = 500
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                grams, at = _distinct_grams(part.column(1), n)
                size = np.bincount(at, minlength=part.num_rows)
                needs = np.maximum(max(least, 1), np.ceil(share * size)).astype(np.uint32)
                needs[part.column(0).is_null().to_numpy(zero_copy_only=False)] = 0
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                wait.append((grams, at, ids, needs))
                held, rows = held + len(grams), rows + part.num_rows
                if held > POSTINGS or rows > 65_000:
                    yield from flush(wait)
                    wait, held, rows = [], 0, 0
        if held:
            yield from flush(wait)

    return texts.mapInArrow(run, "block int, grams binary, place binary, ids binary, needs binary")


def _lists(written: DataFrame, most: int, blocks: int, parts: int) -> DataFrame:
    """cell, sizes, ids, needs: for each gram of 2 to `most` texts the list of them, ids ascending, in each
    cell (a part of a layer) that has a text of the list."""
    names = ["cell", "sizes", "ids", "needs"]

    def lists(blobs: list[tuple]) -> Iterator[pa.RecordBatch]:
        place = [_numbers(x[1], np.uint16) for x in blobs]
        grams = np.concatenate([_numbers(x[0], U) for x in blobs])
        ids = np.concatenate([_numbers(x[2], np.int64)[p] for x, p in zip(blobs, place)])
        needs = np.concatenate([_numbers(x[3], np.uint32)[p] for x, p in zip(blobs, place)])
        blobs.clear()
        order = np.lexsort((ids, grams))
        grams, ids, needs = grams[order], ids[order], needs[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        df = np.diff(np.append(first, len(grams)))
        keep = np.repeat((df > 1) & (df <= most), df) & (needs > 0)
        grams, ids, needs = grams[keep], ids[keep], needs[keep]
        if not len(grams):
            return
        new = np.concatenate([[True], grams[1:] != grams[:-1]])
        first, which = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.diff(np.append(first, len(grams)))
        code = np.unique(which * parts + ids % parts)
        which, cell = code // parts, (grams[first[code // parts]] % U(LAYERS)).astype(np.int64) * parts + code % parts
        order = np.argsort(cell, kind="stable")
        which, cell = which[order], cell[order]
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(cell)]):
            own = size[which[lo:hi]]
            at = np.repeat(first[which[lo:hi]] - np.cumsum(own) + own, own) + np.arange(own.sum())
            blob = [_planes(x) for x in (own.astype(np.uint32), ids[at], needs[at])]
            yield pa.RecordBatch.from_arrays([pa.array([cell[lo]], pa.int32()), *(pa.array([x], pa.binary()) for x in blob)], names=names)

    def run(batches):
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for block, *rest in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(block, []).append(tuple(rest))
        for block in sorted(held):
            yield from lists(held.pop(block))

    return written.repartition(blocks, "block").mapInArrow(run, "cell int, sizes binary, ids binary, needs binary")


def _cell(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(size of each list, ids in it, distinct ids, place of each id among them, need of each distinct id)."""
    size, ids = _joined(table, 1, np.uint32).astype(np.int64), _joined(table, 2, np.int64)
    texts, first, place = np.unique(ids, return_index=True, return_inverse=True)
    return size, texts, place, _joined(table, 3, np.uint32)[first].astype(np.int64)


def _runs(cost: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of items whose costs sum to about `most`."""
    total, lo = np.cumsum(cost), 0
    while lo < len(cost):
        hi = max(int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")), lo + 1)
        yield slice(lo, hi)
        lo = hi


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], .. n[0] numbers in a row, then those from start[1], and so on."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _named(table: pa.Table, parts: int) -> pa.Table:
    """a, b, k, need of the pairs of a cell that share enough of its layer's grams to be told of."""
    size, texts, place, need = _cell(table)
    part = table.column(0)[0].as_py() % parts
    least, has = -(-need // LAYERS), np.bincount(place, minlength=len(texts))
    after = np.repeat(np.cumsum(size), size) - np.arange(len(place)) - 1
    src = np.flatnonzero((after > 0) & (texts % parts == part)[place])
    src = src[np.argsort(place[src], kind="stable")]
    cost = np.bincount(place[src], weights=after[src], minlength=len(texts)).astype(np.int64)
    edge = np.searchsorted(place[src], np.arange(len(texts) + 1))
    out = [(np.zeros(0, np.int64),) * 4]
    for s in _runs(cost, PAIRS):
        own = src[edge[s.start] : edge[s.stop]]
        n = after[own]
        a, b = np.repeat(place[own], n), place[_spread(own + 1, n)]
        low = np.minimum(least[a], least[b])
        can = (has[a] >= low) & (has[b] >= low)
        code, k = np.unique(a[can] * len(texts) + b[can], return_counts=True)
        a, b = code // len(texts), code % len(texts)
        ok = k >= np.minimum(least[a], least[b])
        a, b = a[ok], b[ok]
        out.append((texts[a], texts[b], k[ok], np.minimum(need[a], need[b])))
    return pa.table([np.concatenate(x) for x in zip(*out)], names=["a", "b", "k", "need"])


def _counted(table: pa.Table, pairs: pa.Table) -> pa.Table:
    """a, b, k, need: what each pair shares of a cell's grams; a pair that has its k keeps it."""
    pairs = pairs.select(["a", "b", "k", "need"])
    asked = pairs.column("k").is_null().to_numpy()
    if not asked.any() or not table.num_rows:
        return pairs.set_column(2, "k", pairs.column("k").fill_null(0))
    size, texts, place, _ = _cell(table)
    which = np.repeat(np.arange(len(size)), size)
    order = np.argsort(place, kind="stable")
    has = place[order] * len(size) + which[order]  # ascending: lists ascend within a text
    edge = np.searchsorted(place[order], np.arange(len(texts) + 1))
    a, b = (pairs.column(c).to_numpy() for c in "ab")
    at_a, at_b = (np.minimum(np.searchsorted(texts, x), len(texts) - 1) for x in (a, b))
    both = np.flatnonzero(asked & (texts[at_a] == a) & (texts[at_b] == b))
    k = pairs.column("k").fill_null(0).to_numpy().copy()
    n = edge[at_a + 1] - edge[at_a]
    for s in _runs(n[both], PAIRS):
        own = both[s]
        want = has[_spread(edge[at_a[own]], n[own])] % len(size) + np.repeat(at_b[own], n[own]) * len(size)
        hit = has[np.minimum(np.searchsorted(has, want), len(has) - 1)] == want
        k[own] = np.bincount(np.repeat(np.arange(len(own)), n[own]), weights=hit, minlength=len(own)).astype(np.int64)
    return pairs.set_column(2, "k", pa.array(k))


def sharing_pairs(texts: DataFrame, key: str, n: int, least: int, share: float, most: int) -> DataFrame:
    """a, b, shared: pairs a < b that share `least` distinct n-grams, and `share` of the smaller's, of those
    that at most `most` texts have. The key has whole numbers; rows of one key are one text, and those
    without a key count as a text that is in no pair. Grams are told apart by 64-bit hashes."""
    spark, kind = texts.sparkSession, texts.schema[key].dataType
    words = F.array(F.coalesce(F.transform("w", lambda x: F.xxhash64(x)), F.array().cast("array<bigint>")))
    rows = with_words(texts, key).select(F.col(key).cast("long").alias("id"), words.alias("words"))
    if not texts.groupBy(key).count().filter("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"))
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size // BLOCK_BYTES if size < 1 << 46 else 0  # a table of unknown size has a huge one
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), known, 8)
    parts = -(-blocks // (2 * LAYERS))
    lists = _lists(_written(rows, n, least, share, blocks), most, blocks, parts)
    named = lists.groupBy("cell").applyInArrow(lambda t: _named(t, parts), "a long, b long, k long, need long")
    named = named.groupBy("a", "b").agg(F.sum("k").alias("k"), F.count("*").alias("_c"), F.max("need").alias("need"))
    # a layer that did not name a pair has too few of its grams to
    named = named.filter(F.col("k") + (LAYERS - F.col("_c")) * (F.ceil(F.col("need") / LAYERS) - 1) >= F.col("need"))
    whole = F.col("_c") == LAYERS
    layer = F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(LAYERS - 1))))
    open_ = named.select("a", "b", F.when(~whole, F.lit(None)).otherwise(F.col("k")).alias("k"), "need", layer.alias("_l"))
    open_ = open_.withColumn("cell", (F.col("_l") * parts + F.pmod("a", F.lit(parts))).cast("int")).drop("_l")
    counted = lists.groupBy("cell").cogroup(open_.groupBy("cell")).applyInArrow(_counted, "a long, b long, k long, need long")
    pairs = counted.groupBy("a", "b").agg(F.sum("k").alias("shared"), F.max("need").alias("need")).filter("shared >= need")
    return pairs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "shared")
