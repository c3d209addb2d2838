"""Exact similarity classes of texts from candidate keys.

Texts are sets of 64-bit shingle hashes; equal sets are one class from the start, named by a
64-bit hash of the set. A method (adaptive prefixes, MinHash bands) gives each class some keys;
classes that share enough keys are candidates. This module finds the shared keys, links classes
that an exact test confirms, and joins links to components, in two rounds:

1. In every key, each class is tried against the key's leader only; its best leader is tested.
   That already joins the bulk of a group of copies by about one test a member. The leader a
   class was tested against is its hub.
2. Pairs that are still in different components become candidates if they share enough keys. Pairs
   around one hub's component meet in one place with all their keys and sets, so that what they
   share is counted and tested there, and no more links leave it than join its classes; the few
   pairs of different hubs meet by key.

So a group of thousands of near copies never becomes all its pairs, and no link between
different components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelens.llm.common import _pieces, cut, drop, mix64, small_batches, tidy
from quotelens.llm.graph import components

U = np.uint64
#: Ids that a task remembers, so as not to write a copy again.
SEEN = 200_000
#: Characters of text that are shingled at once.
CHARS = 750_000
_TABLE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_B = 0xD1342543DE82EF95
_B_INV = pow(_B, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    if base not in _powers or len(_powers[base]) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 1 << 16), U(base % (1 << 64)))
            p[0] = 1
            _powers[base] = np.cumprod(p, dtype=U)
    return _powers[base][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text).

    A word is a run of bytes other than ASCII white space, with A-Z lower-cased. Its hash is a
    polynomial over its bytes, got from prefix sums, finalised together with its length.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raws, b""]) or b" ", np.uint8)
    upper = (data >= 65) & (data <= 90)
    data = data + upper.astype(np.uint8) * np.uint8(32)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(_TABLE[data] * _power(_B, n), dtype=U)])
        h = (sums[ends] - sums[starts]) * _power(_B_INV, n)[starts]
        h = mix64(h + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))
    limits = np.cumsum([len(r) + 1 for r in raws])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    return h, counts


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; a text with fewer words is one
    shingle, one without words the empty set."""
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    if len(h) >= k:
        with np.errstate(over="ignore"):
            g = np.zeros(len(h) - k + 1, U)
            for i in range(k):
                g = g * U(0xBF58476D1CE4E5B9) + h[i : len(h) - k + 1 + i]
            g = mix64(g)
    out = []
    for n, end in zip(counts, ends):
        if n >= k:
            out.append(np.unique(g[end - n : end - k + 1]))
        elif n:
            with np.errstate(over="ignore"):
                x = U(n)
                for w in h[end - n : end]:
                    x = x * U(0xBF58476D1CE4E5B9) + w
            out.append(mix64(np.array([x])))
        else:
            out.append(np.zeros(0, U))
    return out


def set_id(s: np.ndarray) -> int:
    """64-bit name of a set, the same for equal sets; as a signed long."""
    with np.errstate(over="ignore"):
        x = mix64(mix64(s + U(0x632BE59BD9B4E019)).sum(dtype=U) + U(len(s)))
    return int(x.astype(np.int64))


def batches_of(column: pa.Array, most: int = CHARS) -> Iterator[tuple[int, list]]:
    """(offset, values) of a text column in pieces of about `most` bytes."""
    for at, n in _pieces(column, most):
        yield at, column.slice(at, n).to_pylist()


# --- arrays of a fixed size, summed over all tasks -------------------------------------------

SLICES = 64


def dense_rows(array: np.ndarray, names=("slice", "blob")) -> pa.RecordBatch:
    """An array as compressed slices, to be merged over tasks by merged_dense()."""
    parts = np.split(array, SLICES)
    blobs = [zlib.compress(p.tobytes(), 1) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=list(names))


def merged_dense(rows: DataFrame, dtype, op, last=lambda x: x) -> bytes:
    """The merge of all tasks' arrays. A task streams the parts of its slices into one array of a
    fixed size, so neither a task nor the driver holds more than the array."""
    name, merge, final = np.dtype(dtype).str, op, last

    def run(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(blob), np.dtype(name))
                got[k] = merge(got[k], x) if k in got else x
        if got:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(got), pa.int32()), pa.array([final(x).tobytes() for x in got.values()], pa.binary())],
                names=["slice", "blob"],
            )

    out = rows.repartition(SLICES // 4, "slice").mapInArrow(tidy(run), "slice int, blob binary").collect()
    parts = dict((r.slice, r.blob) for r in out)
    return b"".join(parts[k] for k in sorted(parts))


# --- a filter of ids ---------------------------------------------------------------------------

FILTER_BITS = 1 << 25


def _bits(ids: np.ndarray) -> list[np.ndarray]:
    h = mix64(ids.astype(np.int64).view(U))
    return [(h % U(FILTER_BITS)).astype(np.int64), ((h >> U(25)) % U(FILTER_BITS)).astype(np.int64)]


def id_filter(ids: DataFrame, column: str) -> bytes:
    """A Bloom filter of a fixed size over all ids. It only saves work: what passes wrongly falls
    out of the join that follows, however full the filter is. Tasks send the places of their bits, slice
    by slice, and each slice is put together in one place."""
    wide = FILTER_BITS // SLICES

    def places(batches):
        few: list[np.ndarray] = []
        dense = None
        for b in batches:
            few += _bits(b.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, few)) > 1_000_000:
                dense = np.zeros(FILTER_BITS, bool) if dense is None else dense
                dense[np.concatenate(few)] = True
                few = []
        at = np.unique(np.concatenate(few)) if few else np.zeros(0, np.int64)
        if dense is not None:
            dense[at] = True
            at = np.flatnonzero(dense)
        edges = np.searchsorted(at, np.arange(SLICES + 1) * wide).tolist()
        for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if lo < hi:
                blob = (at[lo:hi] - k * wide).astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=["slice", "blob"])

    def merge(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k not in got:
                    got[k] = np.zeros(wide, bool)
                got[k][np.frombuffer(blob, np.uint32)] = True
        for k, x in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], names=["slice", "blob"])

    sent = ids.select(column).mapInArrow(tidy(places), "slice int, blob binary")
    out = sent.repartition(SLICES // 4, "slice").mapInArrow(tidy(merge), "slice int, blob binary").collect()
    parts = {r.slice: r.blob for r in out}
    return b"".join(parts.get(k, bytes(wide // 8)) for k in range(SLICES)) if parts else b""


def passes(blob: bytes, ids: np.ndarray) -> np.ndarray:
    if not blob:
        return np.zeros(len(ids), bool)
    x = np.frombuffer(blob, np.uint8)
    ok = np.ones(len(ids), bool)
    for i in _bits(ids):
        ok &= (x[i >> 3] >> (7 - (i & 7)) & 1).astype(bool)
    return ok


# --- keys ----------------------------------------------------------------------------------------

KEY_SCHEMA = "block int, key binary, doc binary, pos binary, id binary, n binary, need binary, rare binary"
_KEY_NAMES = ["block", "key", "doc", "pos", "id", "n", "need", "rare"]


def by_block(block: np.ndarray) -> np.ndarray:
    """The order of ascending blocks; numbers of 16 bits are sorted by radix."""
    small = not len(block) or int(block.max()) < 65_536
    return np.argsort(block.astype(np.uint16) if small else block, kind="stable")


class KeyWriter:
    """Gathers (key, class) in a task and writes them by block of keys.

    Inside a block, a key is 32 bits of its hash and a class is a number in a small table, so a
    posting takes 8 bytes. Two keys that meet in those bits only add candidates. pos is a key's
    place in the class's order of keys; rare (0 to 255) is the share of its set that is rare. Classes of
    add_many() have unordered keys, and neither pos, need nor rare is written.
    """

    def __init__(self, blocks: int, most: int = 600_000):
        self.blocks, self.most = blocks, most
        self._clear()

    def _clear(self):
        self.keys, self.docs, self.pos, self.ids, self.ns, self.needs, self.rare, self.size = [], [], [], [], [], [], [], 0

    def add(self, sid: int, n: int, need: int, rare: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.size + len(keys) > self.most or len(self.ids) == 65_535:
            yield from self.flush()
        self.keys.append(keys)
        self.docs.append(np.full(len(keys), len(self.ids), np.uint16))
        self.pos.append(np.minimum(np.arange(len(keys)), 65_535).astype(np.uint16))
        self.ids.append(sid)
        self.ns.append(n)
        self.needs.append(need)
        self.rare.append(rare)
        self.size += len(keys)

    def add_many(self, ids: np.ndarray, ns: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Classes with a row of unordered keys each; a writer takes these or those of add()."""
        for a in range(0, len(ids), 30_000):
            s = slice(a, a + 30_000)
            part = keys[s]
            if len(self.ids) + len(part) > 65_535 or self.size + part.size > self.most:
                yield from self.flush()
            self.docs.append(np.repeat(np.arange(len(self.ids), len(self.ids) + len(part)), part.shape[1]).astype(np.uint16))
            self.keys.append(part.reshape(-1))
            self.ids += ids[s].tolist()
            self.ns += ns[s].tolist()
            self.size += part.size

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        keys, docs = np.concatenate(self.keys), np.concatenate(self.docs)
        pos = np.concatenate(self.pos) if self.pos else np.zeros((len(keys), 0), np.uint16)
        block = ((keys >> U(40)) % U(self.blocks)).astype(np.int64)
        order = by_block(block)
        keys, docs, pos, block = keys[order].astype(np.uint32), docs[order], pos[order], block[order]
        table = [np.array(x, t) for x, t in ((self.ids, np.int64), (self.ns, np.uint32), (self.needs, np.uint8), (self.rare, np.uint8))]
        cuts = np.flatnonzero(np.diff(block)) + 1
        rows = []
        for lo, hi in zip(np.concatenate([[0], cuts]).tolist(), np.append(cuts, len(block)).tolist()):
            if lo < hi:
                own, local = np.unique(docs[lo:hi], return_inverse=True)
                rows.append((int(block[lo]), keys[lo:hi].tobytes(), local.astype(np.uint16).tobytes(), pos[lo:hi].tobytes(), *(x[own].tobytes() if len(x) else b"" for x in table)))
        self._clear()
        for a in range(0, len(rows), 16):
            cols = list(zip(*rows[a : a + 16]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                names=_KEY_NAMES,
            )


def _shared(blobs: list[tuple], least: float) -> tuple[np.ndarray, ...] | None:
    """Postings of a block whose key has two classes or more, by key, size and class, and the
    place of each one's leader.

    The leader is the key's class with the smallest rare share (a copy with the fewest changes of
    its own) if the sizes allow a match, else the key's first class that is large enough.
    """
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    for key, doc, pos, sid, n, need, rare in blobs:
        d = np.frombuffer(doc, np.uint16)
        plain = [np.full(len(d), x, t) for x, t in ((1, np.uint8), (0, np.uint16), (0, np.uint8))]
        more = plain if not need else [np.frombuffer(need, np.uint8)[d], np.frombuffer(pos, np.uint16), np.frombuffer(rare, np.uint8)[d]]
        parts = (np.frombuffer(key, np.uint32), np.frombuffer(sid, np.int64)[d], np.frombuffer(n, np.uint32)[d], *more)
        for c, x in zip(cols, parts):
            c.append(x)
    keys, ids, ns, needs, pos, rare = map(np.concatenate, cols)
    cols.clear()
    order = np.lexsort((ids, ns, keys))
    keys, ids, ns, needs, pos, rare = (x[order] for x in (keys, ids, ns, needs, pos, rare))
    keep = np.ones(len(keys), bool)  # a class may come from several tasks
    keep[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    group = np.cumsum(np.diff(keys.astype(np.int64), prepend=-1) != 0) - 1
    keep &= np.bincount(group, weights=keep)[group] > 1
    if not keep.any():
        return None
    keys, ids, ns, needs, pos, rare = (x[keep] for x in (keys, ids, ns, needs, pos, rare))
    group = np.cumsum(np.diff(keys.astype(np.int64), prepend=-1) != 0) - 1
    first = np.flatnonzero(np.diff(group, prepend=-1))
    clean = np.lexsort((np.arange(len(keys)), rare, group))[first][group]
    place = (group.astype(np.int64) << 32) | ns.astype(np.int64)
    wanted = (group.astype(np.int64) << 32) | np.ceil(ns * least - 1e-9).astype(np.int64)
    large_enough = np.searchsorted(place, wanted)
    fits = np.minimum(ns, ns[clean]) >= np.maximum(ns, ns[clean]) * least - 1e-9
    return keys, ids, ns, needs, pos, np.where(fits, clean, large_enough)


def shared_keys(written: DataFrame, blocks: int, least: float) -> DataFrame:
    """key, id, n, need, pos, leader (null for a leader) of all postings whose key has several classes.

    Rows without classes (a null id) hold short names of one block, see short_names(); of those that
    come twice or more there is a row with a null key and the name as id.
    """

    def run(batches):
        blobs: dict[int, list[tuple]] = {}
        names: dict[int, list[bytes]] = {}
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for block, *rest in zip(*cols):
                if rest[3] is None:
                    names.setdefault(block, []).append(rest[0])
                else:
                    blobs.setdefault(block, []).append(tuple(rest))
        for block in sorted(names):
            x = np.frombuffer(b"".join(names.pop(block)), np.uint32)
            x = np.sort(x)
            again = np.unique(x[1:][x[1:] == x[:-1]]).astype(np.int64) | (np.int64(block) << 32)
            for a in range(0, len(again), 50_000):
                ids = pa.array(again[a : a + 50_000])
                none = [pa.nulls(len(ids), t) for t in _SHARED]
                yield pa.RecordBatch.from_arrays([none[0], ids, *none[2:]], names=_SHARED_NAMES)
        for block in sorted(blobs):
            got = _shared(blobs.pop(block), least)
            if got is None:
                continue
            keys, ids, ns, needs, pos, leader = got
            whole = (np.int64(block) << 32) | keys.astype(np.int64)
            own = leader == np.arange(len(ids))
            for a in range(0, len(ids), 50_000):
                s = slice(a, a + 50_000)
                cols = [whole[s], ids[s], ns[s].astype(np.int64), needs[s].astype(np.int32), pos[s].astype(np.int32)]
                arrays = [pa.array(c, t) for c, t in zip(cols, _SHARED)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids[leader[s]], pa.int64(), mask=own[s])], names=_SHARED_NAMES)

    return written.repartition(blocks, "block").mapInArrow(tidy(run), "key long, id long, n long, need int, pos int, leader long")


_SHARED_NAMES = ["key", "id", "n", "need", "pos", "leader"]
_SHARED = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]


def short_names(ids: np.ndarray, blocks: int) -> np.ndarray:
    """Names of 32 bits and a block for 64-bit ids, as longs: enough to tell which ids may come twice."""
    x = ids.astype(np.int64).view(U)
    block = ((x >> U(32) & U(0xFFFF)) * U(blocks)) >> U(16)
    return (block << U(32) | (x & U(0xFFFFFFFF))).astype(np.int64)


def name_rows(names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Short names as rows of KEY_SCHEMA, one for each block."""
    names = np.sort(names)
    block = names >> 32
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    low = names.astype(np.uint32)
    blobs = [x.tobytes() for x in np.split(low, heads[1:])]
    for a in range(0, len(heads), 16):
        part = blobs[a : a + 16]
        none = pa.nulls(len(part), pa.binary())
        at = pa.array(block[heads[a : a + 16]].astype(np.int32))
        yield pa.RecordBatch.from_arrays([at, pa.array(part, pa.binary()), *[none] * 6], names=_KEY_NAMES)


# --- tests and components --------------------------------------------------------------------------


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = common_of(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


#: Bytes of a packed hash.
WIDTH = 8


def pack(s: np.ndarray) -> bytes:
    """A sorted set of hashes as bytes; all 64 bits stay, so tests compare whole hashes."""
    return s.astype("<u8").tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def signature(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits for each of the sets that begin at `at` in a row of hashes: bit i is set if a hash has
    i as its upper six bits. A bit that only one of two sets has is an element of only that one."""
    return np.bitwise_or.reduceat(U(1) << (sets >> U(58)), at).view(np.int64) if len(at) else np.zeros(0, np.int64)


def common_of(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted distinct arrays."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, common, linked: the size of the intersection, and whether the exact test passes."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_a", "_b")

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n = np.array([len(x) // WIDTH + len(y) // WIDTH for x, y in zip(a, b)], np.int64)
            common = np.array([common_of(unpack(x), unpack(y)) for x, y in zip(a, b)], np.int64)
            ok = 100 * common >= percent * (n - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common), pa.array(ok)], names=["a", "b", "common", "linked"])

    return both.mapInArrow(tidy(run), "a long, b long, common long, linked boolean")


def tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that pass the exact test."""
    return compared(pairs, sets, percent).filter("linked").select("a", "b")


#: Pairs that a task gives out at once, and members of a key or group that meet in one task.
PAIRS, MEET = 200_000, 1_000
#: Two keys of one class can fall on one 32-bit key; bounds from counts of keys allow for as many.
SLACK = 2
_CLASS = ("id", "n", "need", "c", "g", "reach", "rest", "hub", "common", "sig")


def _facts(shared: DataFrame, percent: int, signatures: DataFrame | None) -> DataFrame:
    """id, n, need, reach, rest, sig of each class that shares a key. Without signatures the keys are
    prefixes, and sig has all bits, which says nothing; with them the keys have no order.

    reach bounds what a class shares with any other: a key in its prefix that nobody else has is
    shared with nobody, so of the n elements only the shared keys and those behind the prefix
    (rest of them) count, and none before its first shared key.
    """
    facts = shared.groupBy("id").agg(
        F.max("n").alias("n"), F.max("need").alias("need"), F.min("pos").alias("_pos"), F.count("*").alias("_keys")
    )
    n, ordered = F.col("n"), signatures is None
    facts = facts.withColumn("sig", F.lit(-1).cast("long")) if ordered else facts.join(signatures, "id")
    facts = facts.withColumn("rest", F.ceil(n * percent / 100).cast("long") - F.col("need") if ordered else n)
    reach = F.least(n - F.col("_pos"), F.col("rest") + F.col("_keys") + SLACK) if ordered else n
    return facts.withColumn("reach", reach).drop("_pos", "_keys")


def _worth_a_test(best: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bounds allow a link."""
    side = lambda x: facts.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "reach", "sig")))
    both = best.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    total, more = (F.col("n_a") + F.col("n_b")) * percent, 100 + percent
    own = lambda x, y: F.col(f"n_{x}") - F.bit_count(F.col(f"sig_{x}").bitwiseAND(F.bitwise_not(f"sig_{y}")))
    most = F.least("reach_a", "reach_b", own("a", "b"), own("b", "a"))
    return both.filter(total <= most * more).select("a", "b")


def _classes(facts: DataFrame, labels: DataFrame, known_hubs: DataFrame) -> DataFrame:
    """The facts of each class with its component c, its hub, what it shares with the hub (-1 where
    that was not counted) and its group g, the component of the hub."""
    facts = facts.join(labels, "id", "left").join(known_hubs, "id", "left")
    facts = facts.withColumn("c", F.coalesce("component", "id")).drop("component")
    common = F.when(F.col("hub").isNull(), F.col("n")).otherwise(F.coalesce("common", F.lit(-1)))
    facts = facts.withColumn("common", common).withColumn("hub", F.coalesce("hub", "id"))
    of_hub = labels.select(F.col("id").alias("hub"), F.col("component").alias("_g"))
    return facts.join(of_hub, "hub", "left").withColumn("g", F.coalesce("_g", "hub")).select(*_CLASS)


def _can_link(x: dict, i, j, percent: int) -> np.ndarray:
    """Whether classes i and j (places in the columns x) can be a link that is not known yet."""
    total = (x["n"][i] + x["n"][j]) * percent  # against (100 + percent) times what both share
    more = 100 + percent
    ok = (x["c"][i] != x["c"][j]) & (x["hub"][i] != x["id"][j]) & (x["hub"][j] != x["id"][i])
    low, high = np.minimum(x["n"][i], x["n"][j]), np.maximum(x["n"][i], x["n"][j])
    ok &= low * 100 >= high * percent
    ok &= total <= np.minimum(x["reach"][i], x["reach"][j]) * more
    # what both share lies in a common hub or outside of it
    inside = np.minimum(x["common"][i], x["common"][j])
    outside = np.minimum(x["n"][i] - x["common"][i], x["n"][j] - x["common"][j])
    ok &= (x["hub"][i] != x["hub"][j]) | (inside < 0) | (total <= (inside + outside) * more)
    # an element whose bit the other class lacks is not shared
    own_i = np.bitwise_count(x["sig"][i] & ~x["sig"][j]).astype(np.int64)
    own_j = np.bitwise_count(x["sig"][j] & ~x["sig"][i]).astype(np.int64)
    most = np.minimum(x["n"][i] - own_i, x["n"][j] - own_j)
    return ok & (total <= most * more)


def _least_keys(x: dict, i, j, percent: int) -> np.ndarray:
    """How many keys a link of classes i and j shares at least: their need, and all of the overlap
    that cannot lie behind the prefixes."""
    overlap = -(-(x["n"][i] + x["n"][j]) * percent // (100 + percent))
    return np.maximum(np.minimum(x["need"][i], x["need"][j]), overlap - np.maximum(x["rest"][i], x["rest"][j]) - SLACK)


def _cells(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows dealt to cells, all rows of a cell together and in a row: of the `parts` of a key, part p
    meets part q in the cell (min, max). side tells the parts of a cell apart; in a cell of one part
    all meet."""
    whole = rows.filter("parts = 1").withColumn("cell", F.xxhash64(key)).withColumn("side", F.lit(0).cast("long"))
    large = rows.filter("parts > 1").withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    large = large.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), 1).otherwise(2)
    large = large.withColumn("cell", F.xxhash64(key, F.least("p", "q"), F.greatest("p", "q"))).withColumn("side", side.cast("long"))
    return whole.unionByName(large.drop("p", "q")).repartition(blocks, "cell").sortWithinPartitions("cell")


def _by_cell(batches) -> Iterator[pa.Table]:
    """The rows of each cell, from batches that have them in a row."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cell = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), b.num_rows]
        if held and held[0].column(0)[0].as_py() != cell[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def crossing_links(
    shared: DataFrame, classes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, blocks: int, scanned: bool
) -> DataFrame:
    """(a, b): links that join all classes of different components that can be joined: such classes share as
    many keys as a link must. A key or group with more than MEET classes is dealt out as pairs of parts.
    With scanned, sets() reads whole texts again, and sets are the bulk: keys are counted first without them, and
    only classes of a pair that can still be a link send theirs. Else sets are small, and pairs of different
    groups are tested where their key is."""
    postings = cut(_open_postings(shared, classes, percent), frees=scanned)  # sets of texts are the bulk: no shuffle waits beside them
    if not scanned:
        known = sets(postings.select("id"))
        between = _between_groups(postings, classes, percent, blocks, known)
        out = cut(_inside_groups(postings, classes, percent, blocks, known).unionByName(between))
        drop(postings)
        return out
    pairs = cut(_between_groups(postings, classes, percent, blocks), frees=True)
    mates = cut(_inside_groups(postings, classes, percent, blocks).distinct(), frees=True)
    known = cut(sets(_ends(pairs).unionByName(mates)), frees=True)
    few = postings.join(mates, "id", "left_semi")
    out = cut(_inside_groups(few, classes, percent, blocks, known).unionByName(tested(pairs, known, percent)))
    drop(postings, pairs, mates, known)
    return out


def _open_postings(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """key, id, g, inside, between, m: postings that can still tell of a link, inside a group or between
    groups; m classes have the key. One shuffle by key serves all windows.

    A partner of n elements needs (n + own n) * percent <= reach * (100 + percent), and has at least
    percent of the own n; where the least n of the key is above what this allows, there is none.
    """
    narrow = shared.select("key", "id").join(classes.select("id", "g", "c", "n", "reach"), "id").repartition("key")
    by_key, by_group = Window.partitionBy("key"), Window.partitionBy("key", "g")
    largest = F.col("reach") * (100 + percent) / percent - F.col("n") + F.lit(1e-6)
    narrow = narrow.withColumn("_low", F.greatest(F.min("n").over(by_key), F.ceil(F.col("n") * percent / 100))).filter(F.col("_low") <= largest)
    rows = narrow.select(
        "key", "id", "g", F.count("*").over(by_key).alias("m"),
        (F.min("g").over(by_key) != F.max("g").over(by_key)).alias("between"),
        (F.min("c").over(by_group) != F.max("c").over(by_group)).alias("inside"),
    )
    return rows.filter("inside or between")


def _inside_groups(postings: DataFrame, classes: DataFrame, percent: int, blocks: int, sets: DataFrame | None = None) -> DataFrame:
    """Links of one group. A class comes to a cell once, with all its keys and its set, so pairs are counted
    and tested there, those that share most keys first. A pair that links have joined needs no test, so a
    cell gives fewer links than it has classes. Without sets, the classes of pairs that would be tested: a
    cell gives each of its classes once at most."""
    own = postings.filter("inside").groupBy("id").agg(F.collect_list("key").alias("keys"))
    rows = classes.join(own, "id")
    parts = rows.groupBy("g").agg(F.ceil(F.count("*") / MEET).cast("int").alias("parts"))
    rows = rows.join(parts, "g")
    rows = rows if sets is None else rows.join(sets.select("id", "set"), "id")
    rows = _cells(rows, "g", blocks).select("cell", "side", *_CLASS, "keys", *([] if sets is None else ["set"]))
    test = sets is not None

    def run(batches):
        for t in _by_cell(batches):
            if t.num_rows < 2:
                continue
            x = {c: t.column(c).to_numpy().astype(np.int64) for c in ("side", *_CLASS)}
            lists = t.column("keys").combine_chunks()
            owner = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
            key = lists.flatten().to_numpy()
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            k = np.zeros((t.num_rows, t.num_rows), np.int32)
            two = first[size == 2]
            np.add.at(k, (owner[two], owner[two + 1]), 1)
            for lo, m in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                at = owner[lo : lo + m]
                k[np.ix_(at, at)] += 1
            i, j = np.nonzero(np.triu(k, 1))
            if not len(i):
                continue
            ok = (x["side"][i] != x["side"][j]) | (x["side"][i] == 0)
            i, j = i[ok], j[ok]
            ok = k[i, j] >= _least_keys(x, i, j, percent)
            i, j = i[ok], j[ok]
            ok = _can_link(x, i, j, percent)
            i, j = i[ok], j[ok]
            if not test:
                yield pa.RecordBatch.from_arrays([pa.array(x["id"][np.unique(np.concatenate([i, j]))])], names=["id"])
                continue
            links = _joining(i, j, k[i, j], x["c"], t.column("set").to_pylist(), percent)
            a, b = x["id"][links[:, 0]], x["id"][links[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long" if test else "id long")


def _joining(i: np.ndarray, j: np.ndarray, keys: np.ndarray, component: np.ndarray, packed: list[bytes], percent: int) -> np.ndarray:
    """Pairs (i, j) that pass the exact test, in rows: enough to join all places that any of the pairs join."""
    label, out = component.copy(), []
    order = np.argsort(-keys, kind="stable")
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        if label[a] != label[b] and similar(unpack(packed[a]), unpack(packed[b]), percent):
            label[label == label[b]] = label[a]
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _between_groups(postings: DataFrame, classes: DataFrame, percent: int, blocks: int, sets: DataFrame | None = None) -> DataFrame:
    """Pairs of different groups, met by key and counted over keys. With sets, links of different groups: pairs
    are tested where they meet, and a cell gives fewer links than it has classes."""
    rows = postings.filter("between").select("key", "id", F.ceil(F.col("m") / MEET).cast("int").alias("parts")).join(classes, "id")
    rows = rows if sets is None else rows.join(sets.select("id", "set"), "id")
    rows = _cells(rows, "key", blocks).select("cell", "side", *_CLASS, *([] if sets is None else ["set"]))
    test = sets is not None

    def run(batches):
        wait, held = [], 0
        for t in _by_cell(batches):
            if t.num_rows < 2:
                continue
            x = {c: t.column(c).to_numpy().astype(np.int64) for c in ("side", *_CLASS)}
            if (x["g"] == x["g"][0]).all():
                continue
            order = np.argsort(x["n"], kind="stable")
            x = {c: v[order] for c, v in x.items()}
            tops = np.searchsorted(x["n"], x["n"] * 100 / percent + 1e-9, side="right")
            met: list[tuple] = []
            for i in range(len(order) - 1):
                # sizes ascend, so matches of i end where they become too large
                j = np.arange(i + 1, tops[i])
                j = j[(x["g"][j] != x["g"][i]) & ((x["side"][j] != x["side"][i]) | (x["side"][j] == 0))]
                j = j[_can_link(x, np.full(len(j), i), j, percent)] if len(j) else j
                if len(j) and test:
                    met.append((np.full(len(j), i), j))
                elif len(j):
                    least = _least_keys(x, np.full(len(j), i), j, percent)
                    wait.append((np.minimum(x["id"][j], x["id"][i]), np.maximum(x["id"][j], x["id"][i]), least))
                    held += len(j)
                if held >= PAIRS:
                    yield _counted(wait)
                    wait, held = [], 0
            if met:
                i, j = (np.concatenate(y) for y in zip(*met))
                packed = t.column("set").take(pa.array(order)).to_pylist()
                links = _joining(i, j, np.zeros(len(i)), x["c"], packed, percent)
                a, b = x["id"][links[:, 0]], x["id"][links[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        if held:
            yield _counted(wait)

    if test:
        return rows.mapInArrow(tidy(run), "a long, b long")
    given = rows.mapInArrow(tidy(run), "a long, b long, least long, k long")
    return given.groupBy("a", "b").agg(F.sum("k").alias("k"), F.max("least").alias("least")).filter("k >= least").select("a", "b")


def _counted(wait: list[tuple]) -> pa.RecordBatch:
    a, b, least = (np.concatenate(x) for x in zip(*wait))
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    k = np.diff(np.append(at, len(a)))
    return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(least[at]), pa.array(k)], names=["a", "b", "least", "k"])


def linked(
    shared: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, blocks: int, signatures: DataFrame | None = None
) -> DataFrame:
    """id, component of the classes that links join: the two rounds of the module's account.

    sets gives (id, set) of at least the classes of its one-column argument. The keys are prefixes,
    or, where signatures gives (id, sig), just keys.
    """
    facts = cut(_facts(shared, percent, signatures))
    votes = shared.filter("leader is not null").groupBy(F.col("id").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("k"))
    best = cut(votes.groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b")))
    tests = cut(_worth_a_test(best, facts, percent))
    tries = cut(compared(tests, sets(_ends(tests)), percent), frees=signatures is None)
    first = tries.filter("linked").select("a", "b")
    labels = cut(components(first))
    counted = tries.select(F.col("a").alias("_a"), "common")
    known_hubs = best.join(counted, F.col("a") == F.col("_a"), "left").select(F.col("a").alias("id"), F.col("b").alias("hub"), "common")
    classes = cut(_classes(facts, labels, known_hubs))
    rest = crossing_links(shared, classes, sets, percent, blocks, signatures is None)
    out = cut(components(first.unionByName(rest)))
    drop(facts, best, tests, tries, labels, classes, rest)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def map_sets(docs: DataFrame, column: str, make: Callable, schema: str, carry: list[str] = ()) -> DataFrame:
    """mapInArrow over pieces of a text column: make() gives (each(offset-free values, carried
    columns), last()), both yielding record batches."""
    small_batches(docs.sparkSession)
    source = docs.select(*carry, column)

    def run(batches):
        each, last = make()
        for b in batches:
            text = b.column(len(carry))
            for at, values in batches_of(text):
                yield from each(values, [b.column(i).slice(at, len(values)) for i in range(len(carry))])
        yield from last()

    return source.mapInArrow(tidy(run), schema)


def sets_of(docs: DataFrame, column: str, wanted: bytes, k: int = 5) -> DataFrame:
    """id, set (packed) of the classes that pass the filter, each once."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def make():
        blob, seen = shared.value, set()

        def each(values, _):
            sets = [s for s in shingle_sets(values, k) if len(s)]
            ids = np.array([set_id(s) for s in sets], np.int64)
            rows = []
            for s, i, good in zip(sets, ids.tolist(), passes(blob, ids)):
                if good and i not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(i)
                    rows.append((i, pack(s)))
            for a in range(0, len(rows), 2_000):
                part = rows[a : a + 2_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())], names=["id", "set"]
                )

        return each, lambda: iter(())

    return map_sets(docs, column, make, "id long, set binary").groupBy("id").agg(F.first("set").alias("set"))
