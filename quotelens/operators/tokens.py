"""Tokens, n-grams, document frequencies and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions import text as T


def with_words(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    """key, w: the normalised words of each text, as an array."""
    return df.select(key, T.words(T.norm_en(F.col(col))).alias("w"))


def tokens(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    """key, pos, tok. The array is exploded where the row is: positions need no window or shuffle."""
    return with_words(df, key, col).select(key, F.posexplode("w").alias("pos", "tok"))


def _grams(w: Column, n: int) -> Column:
    at = F.sequence(F.lit(0), F.size(w) - n)
    gram = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])
    return F.when(F.size(w) >= n, F.transform(at, gram)).otherwise(F.array().cast("array<string>"))


def grams(df: DataFrame, key: str, sizes=(2, 3), col: str = "text") -> DataFrame:
    """key, n, pos, gram of all n-grams."""
    base = with_words(df, key, col)
    each = [base.select(key, F.lit(n).alias("n"), F.posexplode(_grams(F.col("w"), n)).alias("pos", "gram")) for n in sizes]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def document_frequency(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    """tok, df: in how many texts a word occurs. Repeats go before the shuffle, in the row."""
    once = with_words(df, key, col).select(F.explode(F.array_distinct("w")).alias("tok"))
    return once.groupBy("tok").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    """ln n - ln df; a word that no text has counts as one of one text."""
    return F.log(n) - F.log(F.coalesce(df, F.lit(1)))


def postings(passages: DataFrame, key: str, sizes=(2, 3), most: int = 255) -> DataFrame:
    """n, gram, key, df for grams that at most `most` passages have. The bound is part of the
    semantics and keeps any later join on a gram bounded."""
    once = grams(passages, key, sizes).select("n", "gram", key).distinct()
    counts = once.groupBy("n", "gram").agg(F.count("*").alias("df")).filter(F.col("df") <= most)
    return once.join(counts, ["n", "gram"])


def dropped_grams(passages: DataFrame, key: str, sizes=(2, 3), most: int = 255) -> DataFrame:
    """n, gram, df of the grams that the bound leaves out."""
    once = grams(passages, key, sizes).select("n", "gram", key).distinct()
    return once.groupBy("n", "gram").agg(F.count("*").alias("df")).filter(F.col("df") > most)
