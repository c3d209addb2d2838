"""Chunks, prefixes, ranges of units, votes, corrections and summaries of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(n: Column, size: int = 110, overlap: int = 20, least: int = 8) -> Column:
    """Array of (a, b) of the chunks of n words: `size` words that overlap by `overlap`; a last chunk that
    would bring fewer than `least` new words goes with the one before it."""
    step = size - overlap
    more = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    merges = (more > 0) & (n - (size + (more - 1) * step) < least)
    last = F.when(merges, more - 1).otherwise(more)
    starts = F.sequence(F.lit(0), last)
    end = lambda i: F.when(i == last, n).otherwise(i * step + size)
    return F.when(n > 0, F.transform(starts, lambda i: F.struct((i * step).cast("int").alias("a"), end(i).cast("int").alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def prefixes(words: Column, lengths=(9, 16, 24)) -> Column:
    """The first 9, 16 and 24 words as texts, each different one once."""
    texts = F.transform(F.array(*[F.lit(k) for k in lengths]), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    return F.filter(F.array_distinct(texts), lambda t: t != "")


def quantised(vector: Column, dims: int, top: int = 127) -> Column:
    """The first `dims` numbers of a vector as whole numbers of -top to top; zeros for a zero vector."""
    part = F.transform(F.slice(vector, 1, dims), lambda x: x.cast("double"))
    most = F.array_max(F.transform(part, F.abs))
    return F.transform(part, lambda x: F.when(most > 0, F.round(x / most * top)).otherwise(0.0).cast("int"))


def containing(fragments: DataFrame, texts: DataFrame, q: str, key: str, most: int = 255) -> DataFrame:
    """q, key of texts in which all words of a fragment stand in a row.

    Candidates come from the fragment's first 3-gram that at most `most` texts have; a fragment all of
    whose 3-grams are more frequent takes its rarest one. Fragments need three words."""
    from quotelens.operators.tokens import grams, with_words

    g = grams(texts, key, (3,)).select(key, "gram").distinct()
    p = grams(fragments, q, (3,)).select(q, F.col("pos").alias("_off"), "gram")
    p = p.join(g.join(p.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("_df")), "gram")
    pick = F.min_by("gram", F.struct((F.col("_df") > most).cast("int"), F.when(F.col("_df") > most, F.col("_df")).otherwise(F.col("_off"))))
    seed = p.groupBy(q).agg(pick.alias("gram"))
    joined = lambda df, k, name: with_words(df, k).select(k, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias(name))
    found = seed.join(g, "gram").select(q, key)
    return found.join(joined(fragments, q, "_f"), q).join(joined(texts, key, "_t"), key).filter(F.col("_t").contains(F.col("_f"))).select(q, key)


def current_reviews(entries: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """entries with verdict and stale: a review holds while the entry's sig is the reviewed one."""
    r = reviews.select(F.col(key).alias("_k"), F.col("sig").alias("_sig"), "verdict")
    out = entries.join(r, F.col(key) == F.col("_k"), "left")
    same = F.col("sig") == F.col("_sig")
    return out.select(*entries.columns, F.when(same, F.col("verdict")).alias("verdict"), F.coalesce(~same, F.lit(False)).alias("stale"))


def by_printed_number(asked: DataFrame, units: DataFrame, q: str, book: str) -> DataFrame:
    """q, unit of each question (q, book, number, base): the units with that printed number, else those
    with its base number, the least unit first if several have it.

    Only the least unit of a number, and of a base number, can be an answer, and equal questions have
    equal answers. So distinct numbers look for the least units, and a question then meets one row,
    however many units have its number."""
    per = units.groupBy(F.col(book).alias("_b"), F.col("base").alias("_base"), F.col("number").alias("_n")).agg(F.min("unit").alias("_own"))
    near = per.groupBy("_b", "_base").agg(F.min("_own").alias("_near"))
    keys = asked.select(F.col(book).alias("_b"), F.col("base").alias("_base"), F.col("number").alias("_n")).distinct()
    known = keys.join(near, ["_b", "_base"]).join(per, ["_b", "_base", "_n"], "left")
    best = F.struct(F.when(F.col("_own").isNotNull(), 0).otherwise(1).alias("r"), F.coalesce("_own", "_near").alias("unit"))
    known = known.select("_b", "_base", "_n", best.alias("x"))
    same = (F.col(book) == F.col("_b")) & (F.col("base") == F.col("_base")) & F.col("number").eqNullSafe(F.col("_n"))
    return asked.join(known, same).groupBy(q).agg(F.min("x").alias("x")).select(q, "x.unit", (F.col("x.r") == 0).alias("exact"))


def unit_texts(ranges: DataFrame, units: DataFrame, key: str, group: str, joiner: str = " * ") -> DataFrame:
    """key, n, text of ranges of units (group, first, last), in order. A range becomes its units first, so
    the join is on equality."""
    each = ranges.select(key, group, F.explode(F.sequence("first", "last")).alias("unit"))
    rows = each.join(units, [group, "unit"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("unit", "text"))).alias("u"))
    return rows.select(key, F.size("u").alias("n"), F.array_join(F.transform("u", lambda x: x["text"]), joiner).alias("text"))


def idf_share(pairs: DataFrame, words: DataFrame, idf: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """a, b, share: of the words of a, weighed by idf, how much b has. words has key, tok, each once."""
    w = words.join(idf, "tok")
    whole = w.groupBy(key).agg(F.sum("idf").alias("_whole")).withColumnRenamed(key, a)
    left = pairs.join(w.withColumnRenamed(key, a), a)
    both = left.join(words.select(F.col(key).alias(b), "tok"), [b, "tok"]).groupBy(a, b).agg(F.sum("idf").alias("_in"))
    out = pairs.join(whole, a).join(both, [a, b], "left")
    return out.select(a, b, F.round(F.when(F.col("_whole") > 0, F.coalesce("_in", F.lit(0.0)) / F.col("_whole")).otherwise(0.0), 5).alias("share"))


def gram_votes(hits: DataFrame, q: str, p: str, k: int = 3) -> DataFrame:
    """q, p, votes, rank: passages by the words of the grams that they share, each gram as often as it
    stands in the question; the k best, smaller ids first if tied."""
    votes = hits.groupBy(q, p).agg(F.sum("n").alias("votes"))
    rank = F.row_number().over(Window.partitionBy(q).orderBy(F.desc("votes"), p))
    return votes.withColumn("rank", rank).filter(F.col("rank") <= k)


def strong_matches(scored: DataFrame) -> DataFrame:
    """Candidates by meaning that stand on their own: three rare words or more and a score of 16, with
    three words only from 20 on. scored has rare and score."""
    return scored.filter((F.col("rare") >= 3) & (F.col("score") >= 16) & ((F.col("rare") >= 4) | (F.col("score") >= 20)))


def agreeing_windows(top: DataFrame, doc: str, win: str, pid: str, k: int = 3) -> DataFrame:
    """doc, win, pid, agrees: whether the window before or after has a window's best passage among its
    k best. top has doc, win (0, 1, ...), pid, rank."""
    near = top.filter(F.col("rank") <= k).select(F.col(doc).alias("_d"), F.explode(F.array(F.col(win) - 1, F.col(win) + 1)).alias("_w"), F.col(pid).alias("_p")).distinct()
    best = top.filter("rank = 1").select(doc, win, pid)
    hit = (F.col(doc) == F.col("_d")) & (F.col(win) == F.col("_w")) & (F.col(pid) == F.col("_p"))
    return best.join(near, hit, "left").select(doc, win, pid, F.col("_p").isNotNull().alias("agrees"))


def threshold_sweep(scores: DataFrame, thresholds: list[float], score: str, truth: Column) -> DataFrame:
    """threshold, found, right, precision, recall for a short fixed list of thresholds: one pass over the
    scores, one row each."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    rows = scores.select(F.col(score).alias("_s"), truth.alias("_t"), t)
    hit = F.col("_s") >= F.col("threshold")
    out = rows.groupBy("threshold").agg(F.count_if(hit).alias("found"), F.count_if(hit & F.col("_t")).alias("right"), F.count_if("_t").alias("all"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return out.select("threshold", "found", "right", ratio("right", "found").alias("precision"), ratio("right", "all").alias("recall"))


def corrected(words: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """key, pos, w, back: words after corrections, with the place of the word each comes from.

    fixes has key, pos, w (the new words as one text; empty removes the word). A word that becomes several
    shares its place. New places follow the old ones, a running number per text."""
    f = fixes.select(F.col(key).alias("_k"), F.col("pos").alias("_p"), F.col("w").alias("_w"))
    all_ = words.join(f, (F.col(key) == F.col("_k")) & (F.col("pos") == F.col("_p")), "left")
    new = F.filter(F.split(F.coalesce("_w", "w"), " "), lambda x: x != "")
    rows = all_.select(key, F.col("pos").alias("back"), F.posexplode(new).alias("_i", "w"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("back", "_i")) - 1).select(key, "pos", "w", "back")


def only_second(first: DataFrame, second: DataFrame, key: str, tolerance: float = 1.5) -> DataFrame:
    """Entries of the second ledger that none of the first stands for: no entry of the same key whose time,
    widened by the tolerance, meets theirs. Entries have key, s, e."""
    f = first.select(F.col(key).alias("_k"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    return second.join(f, (F.col(key) == F.col("_k")) & (F.col("s") <= F.col("_e") + tolerance) & (F.col("_s") <= F.col("e") + tolerance), "left_anti")


def share_summary(df: DataFrame, block: list[str], group: list[str], hit: Column) -> DataFrame:
    """block, k, n, pooled, mean, least, most: the pooled share of hits, and mean, least and greatest of the
    shares of the groups."""
    per = df.groupBy(*block, *group).agg(F.count_if(hit).alias("_k"), F.count("*").alias("_n")).withColumn("_s", F.col("_k") / F.col("_n"))
    out = per.groupBy(*block).agg(F.sum("_k").alias("k"), F.sum("_n").alias("n"), F.avg("_s").alias("mean"), F.min("_s").alias("least"), F.max("_s").alias("most"))
    r = lambda c: F.round(c, 6)
    return out.select(*block, "k", "n", r(F.col("k") / F.col("n")).alias("pooled"), *[r(F.col(c)).alias(c) for c in ("mean", "least", "most")])


def next_filled(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with filled: a value, or that of the next row where it is missing."""
    return df.withColumn("filled", F.coalesce(F.col(value), F.lead(value).over(Window.partitionBy(key).orderBy(order))))


def weighted_vectors(words: DataFrame, vectors: DataFrame, key: str, tok: str = "tok") -> DataFrame:
    """key, known, vector: the unit vector of the weighed sum of a text's word vectors (tok, weight,
    vector); null where fewer than two words are known. Numbers are summed by dimension, in the plan."""
    rows = words.join(vectors, tok).select(key, "weight", F.posexplode("vector").alias("_i", "_x"))
    sums = rows.groupBy(key, "_i").agg(F.sum(F.col("weight") * F.col("_x")).alias("_s"), F.count("*").alias("_n"))
    v = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_v"), F.max("_n").alias("known"))
    v = v.withColumn("_v", F.transform("_v", lambda x: x["_s"]))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return v.select(key, "known", F.when((F.col("known") >= 2) & (norm > 0), F.transform("_v", lambda x: x / norm)).alias("vector"))
