"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles have one order for all documents: rare ones first, by a sketch of counts over the whole
corpus. If two sets of sizes m and n have Jaccard similarity t or more, then for every l the first
m - ceil(t m) + l shingles of one and the first n - ceil(t n) + l of the other have l in common.
Each document chooses its own l: lengthening the prefix by one costs the postings of one more
shingle and saves the candidates that share only l. Two documents with different l are candidates
from the smaller l on, as the prefix for a smaller l is part of that for a larger one. Candidates
are confirmed by the exact intersection of their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from quotelens.llm import links
from quotelens.llm.common import cut, drop, fresh, map_texts, mix64, quoted
from quotelens.llm.links import U

#: Counters of the sketch (a fixed number), and the longest extension of a prefix.
COUNTERS = 1 << 22
MOST_NEED = 4
#: What one posting and one candidate test cost, relative to each other.
POSTING, TEST = 1.0, 40.0


def first_pass(docs: DataFrame, k: int, carry: list[str] = ("doc_id",)) -> tuple[DataFrame, bytes]:
    """(row table with the columns `carry`, n, id; sketch): one scan gives both, so the texts are read once.

    The sketch has a count class (8 log2 of the count + 1) for each counter, over one copy of a
    text per task. A row table row is a row of docs; id is null where there are no words.
    """
    schema = StructType([StructField(c, docs.schema[c].dataType) for c in carry])
    schema = schema.add("n", "long").add("id", "long").add("slice", "integer").add("blob", "binary")
    names, kinds = schema.names, [to_arrow_type(docs.schema[c].dataType) for c in carry]

    def make():
        counts = np.zeros(COUNTERS, np.uint32)
        wait: list[np.ndarray] = []
        seen: set[int] = set()

        def pour():
            if wait:
                at = (np.concatenate(wait) >> U(42)).astype(np.int64)
                np.add(counts, np.bincount(at, minlength=COUNTERS).astype(np.uint32), out=counts)
                wait.clear()

        def each(values, carried):
            sets = links.shingle_sets(values, k)
            ids = [links.set_id(s) if len(s) else None for s in sets]
            for s, i in zip(sets, ids):
                if i is not None and i not in seen:
                    if len(seen) > links.SEEN:
                        seen.clear()
                    seen.add(i)
                    wait.append(s)
            if sum(map(len, wait)) > 2_000_000:
                pour()
            none = pa.nulls(len(values), pa.int32())
            own = [x.cast(t) for x, t in zip(carried, kinds)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), none, pa.nulls(len(values), pa.binary())],
                names=names,
            )

        def last():
            pour()
            if counts.any():
                d = links.dense_rows(counts)
                nothing = [pa.nulls(d.num_rows, t) for t in (*kinds, pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*nothing, d.column(0), d.column(1)], names=names)

        return each, last

    both = cut(links.map_sets(docs, "text", make, schema, list(carry)))
    rows = both.filter("slice is null").select(*carry, "n", "id")
    classes = lambda x: np.minimum(255, np.round(8 * np.log2(x.astype(np.float64) + 1))).astype(np.uint8)
    sketch = links.merged_dense(both.filter("slice is not null").select("slice", "blob"), np.uint32, np.add, classes)
    rows._cut_path = both._cut_path
    return rows, sketch


def prefix(s: np.ndarray, sketch: np.ndarray, df: np.ndarray, total: float, percent: int) -> tuple[np.ndarray, int]:
    """(prefix, need) of a set: the need with the least estimated cost, and the shingles for it.

    df estimates the sets that hold a shingle; a random set shares a number of prefix shingles
    that is about Poisson with mean sum(df) / total, so total * P(need or more) candidates are to
    be tested.
    """
    order = np.lexsort((mix64(s), sketch[(s >> U(42)).astype(np.int64)]))
    s = s[order]
    n = len(s)
    base = n - (n * percent + 99) // 100
    top = min(MOST_NEED, n - base)
    cost_of = np.cumsum(df[(s[: base + top] >> U(42)).astype(np.int64)])
    best, least = 1, np.inf
    for need in range(1, top + 1):
        postings = cost_of[base + need - 1]
        mean = postings / total
        below, term = 0.0, np.exp(-mean)
        for i in range(need):
            below += term
            term *= mean / (i + 1)
        # what a shared posting costs falls on every document, so rare shingles are nearly free
        cost = POSTING * (base + need + postings) + TEST * total * max(0.0, 1 - below)
        if cost < least:
            best, least = need, cost
    return s[: base + best], best


def write_prefixes(docs: DataFrame, sketch: bytes, total: int, k: int, percent: int, blocks: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def make():
        levels = np.frombuffer(shared.value, np.uint8)
        if not len(levels):
            levels = np.zeros(COUNTERS, np.uint8)
        counts = 2 ** (np.arange(256) / 8) - 1
        noise = float(counts[int(np.median(levels))])
        df = np.maximum(counts - noise, 0.05).astype(np.float32)[levels]
        rare = levels <= np.ceil(8 * np.log2(noise + 3 * np.sqrt(noise) + 3))
        out, seen = links.KeyWriter(blocks), set()

        def each(values, _):
            for s in links.shingle_sets(values, k):
                if not len(s):
                    continue
                i = links.set_id(s)
                if i in seen:
                    continue
                if len(seen) > links.SEEN:
                    seen.clear()
                seen.add(i)
                keys, need = prefix(s, levels, df, float(max(total, 1)), percent)
                share = rare[(s >> U(42)).astype(np.int64)].mean()
                yield from out.add(i, len(s), need, int(255 * share), mix64(keys))

        return each, out.flush

    return links.map_sets(docs, "text", make, links.KEY_SCHEMA)


def linked_sets(docs: DataFrame, k: int = 5, percent: int = 75, carry: list[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): per row of docs the columns `carry`, n (size of its set) and id (its set's name, null
    for an empty one); and id, component of the sets that links join."""
    spark = docs.sparkSession
    rows, sketch = first_pass(docs, k, carry)
    total = rows.filter("id is not null").agg(F.approx_count_distinct("id")).first()[0]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    written = write_prefixes(docs, sketch, total, k, percent, blocks)
    shared = cut(links.shared_keys(written, blocks, percent / 100), frees=True)
    labels = links.linked(shared, lambda ids: links.sets_of(docs, "text", links.id_filter(ids, "id"), k), percent, blocks)
    drop(shared)
    return rows, labels


def near_classes(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id.

    Whole texts, A-Z lower-cased, words split at ASCII white space. component_id is the least
    doc_id that links reach, the document's own included. A text without words (null, empty or
    blank) has an empty set, no links, and its own doc_id as component. Repeated rows and texts
    with equal sets are linked with each other (equal sets are known by a 64-bit hash of the
    sorted set); rows with a null doc_id take the component of their class, or null. An empty
    table gives no rows. Other columns are ignored, whatever they are called.
    """
    rows, labels = linked_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent)
    firsts = rows.filter("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"))
    classes = firsts.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id"))
    roots = classes.groupBy("c").agg(F.min("least").alias("root"))
    # only classes with links need the second look; copies of one text have their least already
    moved = classes.filter("component is not null").join(roots, "c").select(F.col("id").alias("_i"), "root")
    named = firsts.join(moved, F.col("id") == F.col("_i"), "left")
    named = named.select(F.col("id").alias("_id"), F.coalesce("root", "least").alias("component"))
    # a class of very many copies is one row here; the rows of docs that meet it can be split
    out = rows.join(named, F.col("id") == F.col("_id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each group of linked rows: of those with the least doc_id, the one of the
    shortest text, then of the least (by 64 characters, and a hash of the row).

    Rows with a null doc_id all stay. Rows whose text has no words are linked with nothing but rows equal
    to them. Repeated rows are one group. Rows that share a doc_id but are not linked are told apart by their
    texts. All columns stay, whatever they are called. An empty table gives no rows.

    Which row stays is found over narrow columns, with partial minima before each shuffle; then the
    texts are dealt once, by set and row, so a group of very many copies is spread over all tasks.
    """
    own, row, size, head, set_, kept_row = (fresh(docs, c) for c in ("_own", "_row", "_size", "_head", "_set", "_stays"))
    hashable = [quoted(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    marked = docs.withColumn(row, F.xxhash64(*hashable)).withColumn(size, F.length("text")).withColumn(head, F.substring("text", 1, 64))
    keyed = marked.filter("doc_id is not null")
    rows, labels = linked_sets(keyed.select("doc_id", size, head, row, "text"), k, percent, ["doc_id", size, head, row])
    best = lambda by, x: x.groupBy(by).agg(F.min("_key").alias("_key"))
    keys = rows.filter("id is not null").select("id", F.struct("doc_id", size, head, row, F.col("id").alias(set_)).alias("_key"))
    groups = best("id", keys).join(labels, "id", "left").select(F.coalesce("component", "id").alias("_group"), "_key")
    stays = best("_group", groups).select(F.col(f"_key.{set_}").alias(set_), F.col(f"_key.{row}").alias(kept_row))
    made = lambda: lambda texts: ([links.set_id(s) if len(s) else None for s in links.shingle_sets(texts, k)],)
    named = map_texts(keyed, made, f"`{own}` long", [*docs.columns, row])
    kept = named.join(stays, (F.col(own) == F.col(set_)) & (F.col(row) == F.col(kept_row)), "left_semi").dropDuplicates([own, row])
    empty = named.filter(F.col(own).isNull()).dropDuplicates(["doc_id", row])
    return kept.select(*map(quoted, docs.columns)).unionByName(empty.select(*map(quoted, docs.columns))).unionByName(docs.filter("doc_id is null"))
