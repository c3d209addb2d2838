"""Repeated passages by paragraph MinHash banding.

A paragraph here is the unit that copies share even where they stand in the middle of a line: a
sentence, cut further after words whose hash says so, so that unpunctuated text is cut too and
copies are cut alike. Paragraphs of MIN_UNIT words or more are sets of 5-word shingles. MinHash
bands (BANDS of ROWS minima) are tuned for recall: a pair at Jaccard 0.75 meets in a band with
probability 1 - (1 - 0.75^2)^6 = 0.993, equal paragraphs always. Paragraphs that collide are
verified by exact Jaccard similarity and joined to components; in each component the first
occurrence stays and the others are removals. Runs of repeated paragraphs shorter than MIN_RUN
words (a common line or phrase) are left alone.

A passage that begins and ends inside paragraphs may hold no whole one. So all windows of MIN_RUN
words are compared as well, by equality: what two documents share word for word over MIN_RUN words
or more is reported to its exact ends, wherever it stands and however it is punctuated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelens.llm import links
from quotelens.llm.common import cut, drop, mix64, tidy
from quotelens.llm.links import U

BANDS, ROWS = 6, 2
K = 5
#: Words of a paragraph that is compared; of a run that is reported; of a gap inside a run.
MIN_UNIT, MIN_RUN, GAP = 6, 20, 8
#: Different shingles that a paragraph needs so that an unequal set can be similar to it.
LEAST = 3
#: One word in so many ends a paragraph without being the end of a sentence.
CUT = 32


class Units:
    """The paragraphs of a list of texts, as arrays."""

    def __init__(self, texts: list[str | None]):
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join([*raws, b""]) or b" ", np.uint8)
        h, counts = self.h, self.counts = links.word_hashes(texts)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff((~space).astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        stop = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0, bool)
        lines = np.concatenate([[0], np.cumsum((data == 10) | (data == 13))])
        owner = np.repeat(np.arange(len(texts)), counts)
        last = np.zeros(len(h), bool)
        if len(h):
            last[:-1] = (lines[starts[1:]] > lines[ends[:-1]]) | (owner[1:] != owner[:-1])
            last[-1] = True
            line = last.copy()
            last |= stop | (mix64(h) % U(CUT) == 0)
            # a short sentence goes with the next one of its line
            ends_at = np.flatnonzero(last)
            short = np.diff(ends_at, prepend=-1) < MIN_UNIT
            last[ends_at[short]] = line[ends_at[short]]
        self.first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(h) else np.zeros(0, int)
        size = np.diff(np.append(self.first, len(h)))
        doc = owner[self.first] if len(h) else np.zeros(0, int)
        base = np.cumsum(counts) - counts
        keep = size >= MIN_UNIT
        number = np.arange(len(size))
        firsts_of_doc = np.searchsorted(doc, np.arange(len(texts)))
        self.doc, self.size, self.start = doc[keep], size[keep], (self.first - base[doc])[keep]
        self.number = (number - firsts_of_doc[doc])[keep]
        self.first = self.first[keep]
        self._shingles(h)

    def _shingles(self, h: np.ndarray) -> None:
        """Shingles of all units in a row, in text order, and where each unit's begin; n, the number of
        different ones; ids."""
        if not len(self.first):
            self.g, self.at, self.n, self.ids = np.zeros(0, U), np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
            return
        with np.errstate(over="ignore"):
            g = _rolled(h, K)
            n = self.size - K + 1
            self.at = np.cumsum(n) - n
            owner = np.repeat(np.arange(len(n)), n)
            self.g = g[np.arange(len(owner)) + (self.first - self.at)[owner]]
            # one sort of plain numbers tells repeats; a piece has fewer than 2^20 units
            marks = np.sort(owner.astype(U) << U(44) | self.g >> U(20))
            again = (marks[1:][marks[1:] == marks[:-1]] >> U(44)).astype(np.int64)
            self.n = n - np.bincount(again, minlength=len(n))
            # a class is a set with its repeats: equal sets with other repeats meet in all bands
            sums = np.add.reduceat(mix64(self.g + U(0x632BE59BD9B4E019)), self.at)
            self.ids = mix64(sums + n.astype(U)).astype(np.int64)
            self.ends = self.at + n

    def keys(self, which: np.ndarray) -> np.ndarray:
        """Band keys, one row for each of the units `which`."""
        out = np.zeros((len(self.ids), BANDS), U)
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                key = np.full(len(self.ids), U(b + 1))
                for r in range(ROWS):
                    c = mix64(np.array([b * ROWS + r + 1], U))[0] | U(1)
                    key = mix64(key * U(0xBF58476D1CE4E5B9) + np.minimum.reduceat(self.g * c, self.at))
                out[:, b] = key
        return out[which]

    def set(self, i: int) -> np.ndarray:
        return np.unique(self.g[self.at[i] : self.ends[i]])


def _new(ids: np.ndarray, seen: set) -> np.ndarray:
    """Places of ids not seen before in this task, one for each id."""
    _, first = np.unique(ids, return_index=True)
    out = [i for i in first.tolist() if int(ids[i]) not in seen]
    if len(seen) > links.SEEN:
        seen.clear()
    seen.update(ids[out].tolist())
    return np.array(sorted(out), int)


def first_scan(docs: DataFrame, blocks: int) -> DataFrame:
    """Band keys of all paragraph classes, and the short names of all paragraphs and of the windows'
    marks, at most two of a name from one batch (more tell nothing new): one scan gives both."""

    def make():
        out, seen, wait = links.KeyWriter(blocks, 300_000), set(), []

        def pour():
            if wait:
                names = np.concatenate(wait)
                wait.clear()
                yield from links.name_rows(names)

        def each(values, _):
            u = Units(values)
            if len(u.ids):
                at = _new(u.ids, seen)
                at = at[(u.n[at] >= LEAST) | (u.n[at] < (u.ends - u.at)[at])]
                if len(at):
                    yield from out.add_many(u.ids[at], u.n[at], u.keys(at))
            mark, owner, *_ = _windows(u)
            for ids in (u.ids, mark[_heads(mark, owner)]):
                names = np.sort(links.short_names(ids, blocks))
                third = np.zeros(len(names), bool)
                third[2:] = names[2:] == names[:-2]
                wait.append(names[~third])
            if sum(map(len, wait)) > 500_000:
                yield from pour()

        def last():
            yield from out.flush()
            yield from pour()

        return each, last

    return links.map_sets(docs, "text", make, links.KEY_SCHEMA)


def last_scan(docs: DataFrame, wanted: bytes, blocks: int) -> DataFrame:
    """doc_id, number, start, n_words, id of paragraphs whose class passes the filter, and with a null
    doc_id the packed places (block, rows) of the windows that pass."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    names = ["doc_id", "number", "start", "n_words", "id", "block", "rows"]

    def make():
        blob, wait = shared.value, []

        def pour():
            if wait:
                rows = np.concatenate(wait)
                wait.clear()
                for b in _packed(rows, "id", blocks):
                    none = [pa.nulls(b.num_rows, pa.int64())] * 5
                    yield pa.RecordBatch.from_arrays([*none, *b.columns], names=names)

        def each(values, carried):
            u = Units(values)
            doc_ids = carried[0].cast(pa.int64())
            ok = np.flatnonzero(links.passes(blob, links.short_names(u.ids, blocks))) if len(u.ids) else []
            if len(ok):
                doc = doc_ids.take(pa.array(u.doc[ok]))
                cols = [pa.array(x[ok].astype(np.int64)) for x in (u.number, u.start, u.size, u.ids)]
                yield pa.RecordBatch.from_arrays([doc, *cols, pa.nulls(len(ok), pa.int32()), pa.nulls(len(ok), pa.binary())], names=names)
            mark, owner, pos, at = _windows(u)
            heads = _heads(mark, owner)
            there = links.passes(blob, links.short_names(mark[heads], blocks)) if len(heads) else np.zeros(0, bool)
            ok = np.flatnonzero(np.repeat(there, np.diff(np.append(heads, len(mark)))))
            if len(ok):
                rows = np.empty(len(ok), _PLACE)
                rows["id"], rows["pos"] = _rolled(u.h, MIN_RUN)[at[ok]].astype(np.int64), pos[ok]
                rows["doc"] = doc_ids.to_numpy(zero_copy_only=False)[owner[ok]]
                wait.append(rows)
                if sum(map(len, wait)) > 150_000:
                    yield from pour()

        return each, pour

    return links.map_sets(docs, "text", make, "doc_id long, number long, start long, n_words long, id long, block int, rows binary", ["doc_id"])


def sets_of(docs: DataFrame, wanted: bytes) -> DataFrame:
    """id, set (packed), sig of the paragraph classes that pass the filter, each once."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def make():
        blob, seen = shared.value, set()

        def each(values, _):
            u = Units(values)
            ok = np.flatnonzero(links.passes(blob, u.ids)) if len(u.ids) else []
            if len(ok):
                at = ok[_new(u.ids[ok], seen)]
                if len(at):
                    sig = links.signature(u.g, u.at)[at]
                    packed = pa.array([links.pack(u.set(i)) for i in at.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(u.ids[at]), packed, pa.array(sig)], names=["id", "set", "sig"])

        return each, lambda: iter(())

    found = links.map_sets(docs, "text", make, "id long, set binary, sig long")
    return found.groupBy("id").agg(F.first("set").alias("set"), F.first("sig").alias("sig"))


def repeated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row for each repeated paragraph: doc_id, number, start, n_words, class_id, first_doc, removed.

    number counts the document's paragraphs, start its words. Rows with a null number are words that
    no reported paragraph has, but that stand word for word, in a run of MIN_RUN or more, in documents
    of two different ids; their class_id names the first window and first_doc holds the first
    occurrence of all windows that begin in the run. Of other rows, class_id is the component of
    similar paragraphs; first_doc holds its first occurrence (least doc_id, then number), which
    stays; all others are removed. A paragraph counts as repeated if its component occurs in
    documents of two different ids. Null, empty and blank texts have no paragraphs; rows with a
    null doc_id are left out, as nothing could be removed from them by id; repeated rows count
    once. Whole texts are read; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    # every word has a window: more blocks than partitions elsewhere keep tasks small
    blocks = 2 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    met = cut(links.shared_keys(first_scan(docs, blocks), blocks, percent / 100), frees=True)
    shared, often = met.filter("key is not null"), met.filter("key is null").select("id")
    # paragraphs are small, so the sets of all that share a key are kept: one scan serves both rounds
    sets = cut(sets_of(docs, links.id_filter(shared.select("id").distinct(), "id")), frees=True)
    labels = links.linked(shared, lambda _: sets.select("id", "set"), percent, blocks, sets.select("id", "sig"))
    # a paragraph or window repeats by occurring twice itself, a paragraph also by a link to another one
    wanted = links.id_filter(_short(labels, blocks).unionByName(often), "id")
    found = cut(last_scan(docs, wanted, blocks), frees=True)
    drop(met, sets)
    runs = shared_runs(found.filter("doc_id is null").select("block", "rows"), blocks)
    found = found.filter("doc_id is not null").drop("block", "rows")
    places = found.dropDuplicates(["doc_id", "number"]).join(labels, "id", "left")
    places = places.withColumn("class_id", F.coalesce("component", "id")).drop("component", "id")
    groups = places.groupBy("class_id").agg(
        F.min(F.struct("doc_id", "number")).alias("_first"), F.max("doc_id").alias("_top")
    ).filter("_first.doc_id <> _top")
    rows = places.join(groups, "class_id")
    by = Window.partitionBy("doc_id").orderBy("start")
    end = F.lag(F.col("start") + F.col("n_words")).over(by)
    rows = rows.withColumn("_new", (end.isNull() | (F.col("start") - end > GAP)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(by))
    words = F.sum("n_words").over(Window.partitionBy("doc_id", "_run"))
    rows = rows.withColumn("_words", words).filter(F.col("_words") >= MIN_RUN)
    stays = (F.col("_first.doc_id") == F.col("doc_id")) & (F.col("_first.number") == F.col("number"))
    rows = rows.select(
        "doc_id", "number", "start", "n_words", "class_id", F.col("_first.doc_id").alias("first_doc"), (~stays).alias("removed")
    )
    rows = cut(rows)
    return rows.unionByName(_outside(runs, rows))


def _short(ids: DataFrame, blocks: int) -> DataFrame:
    """The short names of ids, as links.short_names() gives them."""
    block = F.shiftright(F.shiftrightunsigned("id", 32).bitwiseAND(0xFFFF) * blocks, 16)
    return ids.select(F.shiftleft(block, 32).bitwiseOR(F.col("id").bitwiseAND(0xFFFFFFFF)).alias("id"))


def _outside(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """The parts of the runs that no reported paragraph covers."""
    taken = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n_words")).alias("b")))).alias("_taken")
    )
    end = F.col("start") + F.col("n_words")
    inside = F.filter(F.coalesce("_taken", F.array().cast("array<struct<a:long,b:long>>")), lambda t: (t["b"] > F.col("start")) & (t["a"] < end))
    parts = F.arrays_zip(
        F.concat(F.array("start"), F.transform("_in", lambda t: t["b"])).alias("a"), F.concat(F.transform("_in", lambda t: t["a"]), F.array(end)).alias("b")
    )
    left = runs.join(taken, "doc_id", "left").withColumn("_in", inside).withColumn("_part", F.explode(parts)).filter("_part.a < _part.b")
    return left.select(
        "doc_id", F.lit(None).cast("long").alias("number"), F.col("_part.a").alias("start"), (F.col("_part.b") - F.col("_part.a")).alias("n_words"), "class_id", "first_doc", "removed"
    )


#: Words of a gram; of the grams of a window, the least one marks it.
GRAM = 10


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n words in a row: a polynomial over their hashes, got from prefix sums."""
    if len(h) < n:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(h * links._power(links._B, len(h)), dtype=U)])
        return mix64((sums[n:] - sums[:-n]) * links._power(links._B_INV, len(h))[: len(h) - n + 1])


def _windows(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mark, text, first word in the text, first word of all) of every window of MIN_RUN words.

    Equal windows have equal marks, and neighbours mostly share theirs. So marks tell which windows
    may come twice, at a fraction of the names.
    """
    n = np.maximum(u.counts - MIN_RUN + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(pos):
        return np.zeros(0, np.int64), owner, pos, pos
    at = (np.cumsum(u.counts) - u.counts)[owner] + pos
    low, width = _rolled(u.h, GRAM), 1
    while width < MIN_RUN - GRAM + 1:  # the least of `width` grams in a row
        step = min(width, MIN_RUN - GRAM + 1 - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low[at].astype(np.int64), owner, pos, at


def _heads(mark: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where runs of windows of one text that share a mark begin."""
    return np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])])) if len(mark) else np.zeros(0, int)


_PLACE = np.dtype([("id", "<i8"), ("doc", "<i8"), ("pos", "<u4")])
_FOUND = np.dtype([("id", "<i8"), ("doc", "<i8"), ("pos", "<u4"), ("first", "<i8"), ("stays", "u1")])
_PACKED = "block int, rows binary"


def _packed(rows: np.ndarray, by: str, blocks: int):
    """Records as one blob a block of the field `by`."""
    block = (mix64(rows[by].view(U) if rows[by].flags.c_contiguous else rows[by].copy().view(U)) >> U(40)) % U(blocks)
    order = links.by_block(block)
    rows, block = rows[order], block[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    heads = block[np.concatenate([[0], cuts]).astype(int)]
    for a in range(0, len(heads), 16):
        parts = np.split(rows, cuts)[a : a + 16]
        yield pa.RecordBatch.from_arrays([pa.array(heads[a : a + 16].astype(np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "rows"])


def _unpacked(batches, kind) -> Iterator[np.ndarray]:
    """The records of each block."""
    blobs: dict[int, list[bytes]] = {}
    for b in batches:
        for k, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            blobs.setdefault(k, []).append(rows)
    for k in sorted(blobs):
        yield np.frombuffer(b"".join(blobs.pop(k)), kind)


def shared_runs(placed: DataFrame, blocks: int) -> DataFrame:
    """doc_id, start, n_words, class_id, first_doc, removed: runs of words all of whose windows of
    MIN_RUN words stand in documents of two different ids. Windows meet by id, so no pair is formed.

    placed has the packed places of the windows that a filter lets pass: those that occur once stay
    at home. The others travel to the block of their id and then to the block of their document. A
    run ends where the first occurrences move to another document, or where the run itself becomes
    the first occurrence.
    """

    def meet(batches):
        for rows in _unpacked(batches, _PLACE):
            ids = rows["id"].copy()
            order = np.argsort(ids)
            ids, doc, pos = ids[order], rows["doc"][order], rows["pos"][order]
            head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            size = np.diff(np.append(head, len(ids)))
            first, top = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
            ok = np.repeat(first != top, size)
            first = np.repeat(first, size)
            at_first = np.where(doc == first, pos, np.uint32(0xFFFFFFFF))
            stays = at_first == np.repeat(np.minimum.reduceat(at_first, head), size)
            out = np.empty(ok.sum(), _FOUND)
            for f, x in (("id", ids), ("doc", doc), ("pos", pos), ("first", first), ("stays", stays & (doc == first))):
                out[f] = x[ok]
            if len(out):
                yield from _packed(out, "doc", blocks)

    def join(batches):
        for rows in _unpacked(batches, _FOUND):
            rows = rows[np.lexsort((rows["pos"], rows["doc"]))]
            twice = np.zeros(len(rows), bool)  # rows of one doc_id that come again
            twice[1:] = (rows["doc"][1:] == rows["doc"][:-1]) & (rows["pos"][1:] == rows["pos"][:-1])
            rows = rows[~twice]
            doc, pos = rows["doc"], rows["pos"].astype(np.int64)
            new = np.ones(len(rows), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
            for f in ("first", "stays"):
                new[1:] |= rows[f][1:] != rows[f][:-1]
            head = np.flatnonzero(new)
            end = pos[np.append(head[1:], len(rows)) - 1] + MIN_RUN
            start = pos[head]
            same = doc[head][1:] == doc[head][:-1]
            start[1:] = np.where(same, np.maximum(start[1:], end[:-1]), start[1:])
            for a in range(0, len(head), 50_000):
                s = slice(a, a + 50_000)
                h = head[s]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.astype(np.int64)) for x in (doc[h], start[s], end[s] - start[s], rows["id"][h], rows["first"][h])), pa.array(rows["stays"][h] == 0)],
                    names=["doc_id", "start", "n_words", "class_id", "first_doc", "removed"],
                )

    met = placed.repartition(blocks, "block").mapInArrow(tidy(meet), _PACKED)
    found = "doc_id long, start long, n_words long, class_id long, first_doc long, removed boolean"
    return met.repartition(blocks, "block").mapInArrow(tidy(join), found)
