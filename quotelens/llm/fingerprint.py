"""Document fingerprints by order MinHash, in DataFrame operations only.

A document's items are its word k-mers, each with its occurrence number, so that repeats count.
For each of M hash functions the minimal items are selected (L of them: the minima of L disjoint
hash classes), put back in the order of the text, and hashed as a tuple. Two documents share an
entry only if they share those items in the same order, so the share of equal entries falls both
with replaced and with moved text, as the edit distance does.

The hash functions are h(item) XOR c_j with fixed constants: the minimum picks the item whose hash
shares the longest prefix with c_j, any item being equally likely. An item's hash keeps its upper
bits and carries the position in the lower ones, so one minimum over a long gives both.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens.llm.common import cut

#: Words of an item; entries of a fingerprint; items of an entry.
K, M, L = 2, 16, 2
#: Bits for the position of an item: texts up to 268 million words, which a row of Spark cannot exceed
#: as an array of words, keep exact order.
POSITION_BITS = 28
#: Rows that one window frame holds, about; and runs that one frame of runs holds.
RUN = 256


def constants(n: int) -> list[int]:
    """n fixed 64-bit constants with the position bits clear, spread evenly by their upper bits."""
    out = []
    for j in range(n):
        x = int.from_bytes(hashlib.sha256(f"order-minhash-{j}".encode()).digest()[:8], "big")
        x = (x >> 8) | (int(f"{j % 256:08b}"[::-1], 2) << 56)
        x = (x >> POSITION_BITS) << POSITION_BITS
        out.append(x - (1 << 64) if x >= 1 << 63 else x)
    return out


def following(runs: DataFrame) -> DataFrame:
    """_run, _to: the next run that exists; the last one leads to the first. Two levels of windows,
    so that a single task sees one row for RUN * RUN ids."""
    runs = runs.select("_run").distinct().withColumn("_super", F.floor(F.col("_run") / RUN))
    inner = runs.withColumn("_to", F.lead("_run").over(Window.partitionBy("_super").orderBy("_run")))
    heads = runs.groupBy("_super").agg(F.min("_run").alias("_head"))
    order = Window.orderBy("_super")
    nexts = heads.select(
        F.col("_super").alias("_s"), F.coalesce(F.lead("_head").over(order), F.first("_head").over(order)).alias("_jump")
    )
    return inner.join(nexts, F.col("_super") == F.col("_s")).select("_run", F.coalesce("_to", "_jump").alias("_to"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, _run, _at, _next: the text of the next higher doc_id (of the lowest, after the highest).

    Rows are dealt out by runs of ids, as wide as holds RUN rows where ids are spread evenly, dense or
    sparse; the texts are shuffled once, and only the first text of each run travels to the run
    before. Rows with equal ids follow each other in the order of text.
    """
    id_ = F.col("doc_id").cast("double")
    width = docs.agg(F.greatest(F.lit(1.0), (F.max(id_) - F.min(id_) + 1) * RUN / F.count("doc_id"))).first()[0] or 1.0
    run = F.coalesce(F.floor(id_ / width), F.lit(-(1 << 56)))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), run.alias("_run"))
    first = base.groupBy("_run").agg(F.min(F.struct("doc_id", "text")).alias("_h"))
    heads = (
        following(base.select("_run")).alias("f")
        .join(first.alias("h"), F.col("f._to") == F.col("h._run"))
        .select(F.col("f._run").alias("_r"), F.col("h._h.text").alias("_head"))
    )
    near = Window.partitionBy("_run").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = base.withColumn("_lead", F.lead("text").over(near)).withColumn("_at", F.row_number().over(near))
    return rows.join(heads, F.col("_run") == F.col("_r")).select("doc_id", "text", "_run", "_at", F.coalesce("_lead", "_head").alias("_next"))


def edited(text: Column, nxt: Column) -> Column:
    """The text with its last floor(n/2) characters replaced by the first as many (or all) of the next."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(nxt, F.lit(1), half))


def items(text: Column) -> Column:
    """Hashes of the word k-mers of a text, in text order; fewer words than K give one item, none give none."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def grams(w):
        n = F.size(w)
        several = F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.xxhash64(a, b))
        one = F.transform(w, lambda a: F.xxhash64(a))
        return F.when(n > 1, several).otherwise(one)

    # a one-element transform evaluates the words once
    return F.transform(F.array(words), grams)[0]


def fingerprints(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and fp, an array of M hashes; rows without words have no row here.

    texts must have unique keys and should be partitioned by some of them: then numbering the
    occurrences and taking the minima happen where the rows are, without a further shuffle.
    """
    exploded = texts.select(*keys, F.posexplode(items(F.col(column))).alias("_p", "_h"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_h").orderBy("_p"))
    numbered = exploded.select(*keys, "_p", F.xxhash64("_h", nth).alias("_x"))
    mask = F.lit(-(1 << POSITION_BITS))
    kept = numbered.withColumn("_y", F.col("_x").bitwiseAND(mask)).withColumn("_q", F.col("_x").bitwiseAND(F.lit(L - 1)))
    minima = []
    for j, c in enumerate(constants(M)):
        # the position must not change the order of hashes: XOR touches the upper bits only
        value = F.col("_y").bitwiseXOR(F.lit(c)).bitwiseOR(F.col("_p"))
        for q in range(L):
            minima.append(F.min(F.when(F.col("_q") == q, value)).alias(f"_m{j}_{q}"))
    got = kept.groupBy(*keys).agg(*minima)
    at = lambda c: F.col(c).bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    item = lambda c, j: F.col(c).bitwiseAND(mask)
    entries = []
    for j in range(M):
        a, b = f"_m{j}_0", f"_m{j}_1"
        swap = F.coalesce(at(a) > at(b), F.lit(False))
        entries.append(
            F.when(swap, F.xxhash64(item(b, j), item(a, j))).otherwise(F.xxhash64(item(a, j), item(b, j)))
        )
    return got.select(*keys, F.array(*entries).alias("fp"))


def text_of(fp: Column) -> Column:
    """A fingerprint as text: its hashes in hexadecimal; that of a text without words is empty."""
    return F.coalesce(F.concat_ws("", F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0"))), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries; 1 for two texts without words, 0 if only one has none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (
        F.when(a.isNull() & b.isNull(), F.lit(1.0))
        .when(a.isNull() | b.isNull(), F.lit(0.0))
        .otherwise(same / F.lit(float(M)))
    )


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null and empty texts have an empty fingerprint. With a single row the next document is the row
    itself. Repeated ids are documents of their own, next to each other. Null ids come first.
    Equal texts have equal fingerprints. Other columns are ignored.
    """
    both = with_next(docs).withColumn("_edited", edited(F.col("text"), F.col("_next")))
    facts = both.select(
        "doc_id", "_run", "_at", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256")
    )
    keys = ["_run", "_at", "_side"]
    sides = both.select("_run", "_at", F.posexplode(F.array("text", "_edited")).alias("_side", "_text"))
    fp = fingerprints(sides, keys, "_text")
    pick = lambda k: F.first(F.when(F.col("_side") == k, F.col("fp")), ignorenulls=True)
    two = fp.groupBy("_run", "_at").agg(pick(0).alias("_f"), pick(1).alias("_g"))
    # everything above is dealt by _run, so this join moves nothing
    rows = facts.join(two, ["_run", "_at"], "left")
    nxt = _next_fp(rows)
    return nxt.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of(F.col("_f")).alias("fingerprint"),
        text_of(F.col("_g")).alias("edited_fingerprint"),
        likeness(F.col("_f"), F.col("_g")).alias("near_edited"),
        likeness(F.col("_f"), F.col("_nf")).alias("near_next"),
    )


def _next_fp(rows: DataFrame) -> DataFrame:
    """rows with _nf, the fingerprint of the next row; the first row of a run serves the run before."""
    rows = cut(rows)
    near = Window.partitionBy("_run").orderBy("_at")
    heads = rows.filter("_at = 1").select("_run", F.struct("_f").alias("_head"))
    nexts = following(heads).alias("l").join(heads.alias("h"), F.col("l._to") == F.col("h._run")).select(F.col("l._run").alias("_r"), "_head")
    led = rows.withColumn("_lead", F.lead(F.struct("_f")).over(near)).join(nexts, F.col("_run") == F.col("_r"))
    return led.withColumn("_nf", F.coalesce("_lead", "_head")["_f"])
