"""Entries of a ledger and passages of a corpus: which are kept, preferred, doubted and held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions import text as T
from quotelens.operators.tokens import grams


def tier(canonical: Column, book: Column, weak: Column) -> Column:
    """The order in which equal matches are preferred: fixed text, collection, book, book of weak texts."""
    no = lambda x: F.coalesce(x, F.lit(False))
    return F.when(no(canonical), 0).when(no(book) & no(weak), 3).when(no(book), 2).otherwise(1)


def doubtful(status: Column, manual: Column, cued: Column, tier: Column, matched: Column, most: int = 10) -> Column:
    """Entries to look at again: found in wording without a cue, in few words, in a collection or a book."""
    return status.isin("verbatim", "partial") & ~F.coalesce(manual, F.lit(False)) & ~F.coalesce(cued, F.lit(False)) & (tier > 0) & matched.between(1, most)


def shown(status: Column, flags: Column, verdict: Column, only: str | None = None, flagged: bool = False, unreviewed: bool = False) -> Column:
    """The filters of a list of entries: of one status, with flags, without a review."""
    out = F.lit(True) if only is None else status == only
    out = out & (F.size(F.coalesce(flags, F.array().cast("array<string>"))) > 0) if flagged else out
    return out & verdict.isNull() if unreviewed else out


def weak_only(kind: Column, collections: Column, sound: list[str]) -> Column:
    """Every recorded grading is weak and no collection of `sound` has the text."""
    return (kind == "weak") & ~F.arrays_overlap(F.coalesce(collections, F.array().cast("array<string>")), F.array(*map(F.lit, sound)))


def usable_passages(df: DataFrame, text: str, least: int, preamble: str | None = None, opens: Column | None = None) -> DataFrame:
    """df with words (normalised) and why: null for passages to index, else missing or too_short.

    A passage that opens a chapter (`opens`) and begins with the preamble loses it, if words are left."""
    w = T.words(T.norm_en(F.col(text)))
    if preamble is not None:
        head = T.words(T.norm_en(F.lit(preamble)))
        begins = (F.lit(True) if opens is None else F.coalesce(opens, F.lit(False))) & (F.slice(w, F.lit(1), F.size(head)) == head) & (F.size(w) > F.size(head))
        w = F.when(begins, F.slice(w, F.size(head) + 1, F.size(w))).otherwise(w)
    n = F.size("words")
    return df.withColumn("words", w).withColumn("why", F.when(n == 0, "missing").when(n < least, "too_short"))


def left_out(passages: DataFrame, source: str) -> DataFrame:
    """source, why, n of the passages that are not indexed."""
    return passages.filter("why is not null").groupBy(source, "why").agg(F.count("*").alias("n"))


def owners(spans: DataFrame, key: str) -> DataFrame:
    """key, n, a, b of the spans that own their words in a cited document: in order of (a, b, n), each that
    begins after the end of the last owner (ends are inclusive). spans has key, n, a, b."""
    rows = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("a", "b", "n")]))).alias("s"))
    none = F.array().cast("array<struct<a:bigint,b:bigint,n:bigint>>")
    free = lambda kept, x: F.coalesce(x["a"] > F.try_element_at(kept, F.lit(-1))["b"], F.lit(True))
    kept = F.aggregate("s", none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return rows.select(key, F.explode(kept).alias("x")).select(key, "x.n", "x.a", "x.b")


def rebased(positions: Column, offset: Column) -> Column:
    """Positions after a prefix of `offset` words is taken away; null if one of them lies in the prefix."""
    moved = F.transform(positions, lambda p: p - offset)
    return F.when(~F.exists(moved, lambda p: p < 0), moved)


def held_out(passages: DataFrame, fragments: DataFrame, key: str, q: str, size: int = 4) -> DataFrame:
    """key of passages that share a run of `size` words with any fragment: what must leave a corpus before
    the fragments can count as foreign to it. An equi-join on grams, each once on either side."""
    wanted = grams(fragments, q, (size,)).select("gram").distinct()
    return grams(passages, key, (size,)).join(wanted, "gram", "left_semi").select(key).distinct()


def without(passages: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """passages that are not blocked; a null key is never blocked."""
    return passages.join(blocked.select(key).distinct(), key, "left_anti")


def graded(grades: DataFrame, names: DataFrame, grade: str) -> DataFrame:
    """grades with shown: the translation of a cleaned grade, or the grade as it is. names has key, name; it
    is a list of wordings, which the join may broadcast by its size."""
    clean = F.trim(F.regexp_replace(F.lower(F.col(grade)), r"[^a-z]+", " "))
    n = names.select(F.col("key").alias("_key"), F.col("name").alias("_name"))
    out = grades.withColumn("_clean", clean).join(n, F.col("_clean") == F.col("_key"), "left")
    return out.select(*grades.columns, F.coalesce("_name", F.col(grade)).alias("shown"))
