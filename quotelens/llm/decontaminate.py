"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The alphabet is the benchmark's vocabulary; a document word outside it is symbol 0. Patterns are
the windows of the benchmark items (10 words; an item with fewer words is one shorter window).
Per pattern length there is one matcher: a shift table over blocks of two words says how far the
search may jump, a zero shift opens the bucket of patterns with that last block, and a direct
comparison of all words confirms. Nothing is decided by a hash alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm.common import fresh, lower_az, map_texts, quoted

#: Words of a benchmark that may be broadcast, about 600 MB of text.
BIGGEST = 100_000_000
#: A-Z is already lower-cased when this applies.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    """Words of a whole text, A-Z lower-cased; null has none."""
    return WORD.findall(lower_az(text)) if text else []


def windows(item_words: list[str], width: int = 10) -> list[tuple[str, ...]]:
    """All windows of `width` consecutive words; fewer words than that, but some, are one window."""
    if not item_words:
        return []
    if len(item_words) < width:
        return [tuple(item_words)]
    return [tuple(item_words[i : i + width]) for i in range(len(item_words) - width + 1)]


class WuManber:
    """Patterns of one length m, as tuples of symbols > 0."""

    BLOCK = 2

    def __init__(self, patterns: dict[tuple[int, ...], list[int]]):
        self.m = m = len(next(iter(patterns)))
        self.block = b = min(self.BLOCK, m)
        self.far = m - b + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for p, items in patterns.items():
            for end in range(b, m + 1):
                key, jump = p[end - b : end], m - end
                if self.shift.get(key, self.far) > jump:
                    self.shift[key] = jump
            self.bucket.setdefault(p[m - b :], []).append((p, items))

    def search(self, text: list[int]) -> Iterator[tuple[int, list[int]]]:
        """Every position at which a pattern begins, with the pattern's items."""
        m, b, far, n = self.m, self.block, self.far, len(text)
        shift, bucket = self.shift.get, self.bucket
        end = m
        while end <= n:
            if not text[end - 1]:  # a foreign word: no window spans it
                end += m
                continue
            key = tuple(text[end - b : end])
            jump = shift(key, far)
            if jump:
                end += jump
                continue
            start = end - m
            for p, items in bucket[key]:
                if all(text[start + i] == x for i, x in enumerate(p)):
                    yield start, items
            end += 1


class Matcher:
    """The windows of one block of benchmark items, a Wu-Manber matcher for each window length."""

    def __init__(self, items: list[tuple[int, str]], width: int = 10):
        self.symbol: dict[str, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for item, text in items:
            for w in windows(words(text), width):
                p = tuple(self.symbol.setdefault(x, len(self.symbol) + 1) for x in w)
                owners = by_length.setdefault(len(p), {}).setdefault(p, [])
                if item not in owners:
                    owners.append(item)
        self.matchers = [WuManber(p) for _, p in sorted(by_length.items())]

    def find(self, doc_words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Covered word ranges [start, end), disjoint and ascending, and the items that occur."""
        get = self.symbol.get
        text = [get(w, 0) for w in doc_words]
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for x in self.matchers:
            for start, items in x.search(text):
                spans.append((start, start + x.m))
                found.update(items)
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges as disjoint ascending ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The benchmark in blocks of about block_words words, dealt by a hash of the item."""
    clean = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    total = clean.agg(F.sum(F.length("text"))).first()[0] or 0
    if total > BIGGEST * 6:
        raise ValueError("the benchmark is too large to broadcast: search for it in parts, one after another")
    n = max(1, -(-int(total) // (block_words * 5)))
    return [clean.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


_matchers: dict = {}


def _matcher(key, shared, width):
    """One matcher per worker and block, built when first used."""
    if key not in _matchers:
        if len(_matchers) > 2:
            _matchers.clear()
        _matchers[key] = Matcher(shared.value, width)
    return _matchers[key]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 500_000, keep: list[str] | None = None,
    names: tuple[str, str, str] = ("hit_spans", "items", "n_words"),
) -> DataFrame:
    """The columns `keep` of docs (all by default) with hit_spans, items and n_words, or what `names` calls them.

    hit_spans holds the disjoint ranges of words that windows cover, items the sorted item ids.
    Whole texts are searched. Null and empty texts have no words and no hits; null items or item
    texts are no patterns; an empty benchmark hits nothing. Repeated rows are judged one by one.
    The benchmark is a query set: only blocks of a bounded size are broadcast, and each further
    block adds one pass over the rows in the same stage, without a shuffle. All blocks of a benchmark
    are broadcast by the time the rows are read, so its size is the bound: BIGGEST words.
    A column of docs that is called like an output column gives way to it.
    """
    spark: SparkSession = docs.sparkSession
    keep = [c for c in (keep or docs.columns) if c.lower() not in names]
    spans, items, n_words = names
    old = fresh(docs, "_spans"), fresh(docs, "_items")
    fields = f"`{spans}` array<array<long>>, `{items}` array<long>, `{n_words}` long"
    blocks = benchmark_blocks(benchmark, block_words)
    out = docs
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(sorted((r[0], r[1]) for r in block.collect()))
        key, more = uuid.uuid4().hex, k < len(blocks) - 1

        def make(shared=shared, key=key):
            matcher = _matcher(key, shared, width)

            def search(texts):
                found_spans, found_items, counts = [], [], []
                for text in texts:
                    w = words(text)
                    s, f = matcher.find(w)
                    found_spans.append(merged(s))
                    found_items.append(sorted(f))
                    counts.append(len(w))
                return found_spans, found_items, counts

            return search

        carried = list(dict.fromkeys([*keep, "text"])) if more else keep
        if k:  # what the blocks before have found is carried along
            out = out.withColumnsRenamed({spans: old[0], items: old[1]}).drop(n_words)
            out = map_texts(out, make, fields, [*carried, *old])
            out = out.withColumn(items, F.array_sort(F.array_union(quoted(items), old[1])))
            out = out.withColumn(spans, _merge_spans(F.concat(quoted(spans), old[0]))).drop(*old)
        else:
            out = map_texts(out, make, fields, carried)
    return out.select(*map(quoted, keep), *map(quoted, names))


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 500_000) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs, with all columns they had."""
    names = tuple(fresh(docs, c) for c in ("hit_spans", "items", "n_words"))
    found = find_leaks(docs, benchmark, width, block_words, names=names)
    return found.filter(F.size(quoted(names[1])) == 0).select(*map(quoted, docs.columns))


def _merge_spans(spans):
    """Union of ranges in an array column, as merged() does it."""

    def add(out, s):
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & (s[0] <= F.try_element_at(last, F.lit(2)))
        wider = F.concat(
            F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
            F.array(F.array(F.try_element_at(last, F.lit(1)), F.greatest(F.try_element_at(last, F.lit(2)), s[1]))),
        )
        return F.when(joins, wider).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<bigint>>"), lambda o, s: add_safe(o, s, add))


def add_safe(out, s, add):
    """add(), but an empty result so far just takes the first range."""
    return F.when(F.size(out) == 0, F.array(s)).otherwise(add(out, s))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from what find_leaks() returns."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def items_sha(items) -> str:
    """What items_sha256 holds, in plain Python."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
