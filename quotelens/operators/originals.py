"""Originals: the words as they were printed, beside the words that are searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions import text as T

EDGES = r"^[\s\"«»“”.,،؛:]+|[\s\"«»“”.,،؛:]+$"


def pieces(text: Column) -> Column:
    """The text between white space, as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+"), lambda x: x != "")


def word_places(piece: Column) -> Column:
    """Places of the pieces that hold a word; the others are punctuation that stands alone."""
    marked = F.transform(piece, lambda x, i: F.when(T.norm_en(x) != "", i))
    return F.filter(marked, lambda i: i.isNotNull())


def shown_words(piece: Column, at: Column) -> Column:
    """One text for each word: punctuation that stands alone goes with the word before it, at the very
    beginning with the first word."""
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(at, i))
    end = lambda i: F.coalesce(F.get(at, i + 1), F.size(piece))
    return F.transform(at, lambda _, i: F.array_join(F.slice(piece, start(i) + 1, end(i) - start(i)), " "))


def exact(piece: Column, at: Column, words: Column) -> Column:
    """Whether the words of the text are the searched words, one by one."""
    return F.transform(at, lambda a: T.norm_en(F.get(piece, a))) == words


def original_range(piece: Column, at: Column, a: Column, b: Column) -> Column:
    """The original from word a to word b, with the punctuation between them; a straight quotation mark
    whose partner lies outside is left out with all the others. Empty outside the text."""
    first, last = F.get(at, a), F.get(at, b)
    cut = F.array_join(F.slice(piece, first + 1, last - first + 1), " ")
    bare = F.replace(cut, F.lit('"'), F.lit(""))
    tidy = F.array_join(F.filter(F.split(bare, " "), lambda x: x != ""), " ")
    odd = (F.length(cut) - F.length(bare)) % 2 == 1
    return F.when((a >= 0) & (b >= a) & (b < F.size(at)), F.when(odd, tidy).otherwise(cut)).otherwise("")


def placements(want: Column, words: Column) -> Column:
    """All places where a sequence of words stands. Only places of its first word are compared."""
    n = F.size(want)
    marked = F.transform(words, lambda x, i: F.when((x == F.get(want, F.lit(0))) & (F.slice(words, i + 1, n) == want), i))
    return F.when(n > 0, F.filter(marked, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))


def unambiguous(places: Column, n: Column, shown: Column) -> Column:
    """Whether the originals of all places are the same, letter for letter; false without any place."""
    first = F.slice(shown, F.coalesce(F.get(places, F.lit(0)), F.lit(0)) + 1, n)
    return (F.size(places) > 0) & F.forall(places, lambda p: F.slice(shown, p + 1, n) == first)


def source_wording(text: Column, most: int = 60) -> Column:
    """What a footnote quotes: at most `most` words, bare of punctuation at the edges, then an ellipsis."""
    ws = pieces(text)
    body = F.regexp_replace(F.array_join(F.slice(ws, F.lit(1), F.lit(most)), " "), EDGES, "")
    return F.when(body == "", "").when(F.size(ws) > most, F.concat(body, F.lit(" …"))).otherwise(body)


def source_spelling(compared: Column, said: Column, source: Column) -> Column:
    """The source's spelling in place of what was transcribed, only if the compared words are the words that
    stand there; else null."""
    bare = F.regexp_replace(source, EDGES, "")
    return F.when((compared != "") & (compared == said) & (bare != ""), bare)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as offsets of a page's scripts count."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def said_positions(ops: Column) -> Column:
    """Source positions that an alignment's operations cover; ops are (kind, src, n), src null where there is
    no source, n null for one word. Left-out words are not said."""
    held = F.filter(ops, lambda d: d["src"].isNotNull() & (d["kind"] != "del"))
    return F.flatten(F.transform(held, lambda d: F.sequence(d["src"], d["src"] + F.greatest(F.coalesce(d["n"], F.lit(1)), F.lit(1)) - 1)))


def counted_list(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, line: "item count" of each item, the most frequent first, then by name. The items of a group are
    names of collections, few by nature; counts are summed before they meet."""
    counts = df.groupBy(*by, item).agg(F.count("*").alias("_n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(item).alias("x"))))
    return counts.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: F.concat_ws(" ", r["x"], (-r["n"]).cast("string"))), ", ").alias("line"))
