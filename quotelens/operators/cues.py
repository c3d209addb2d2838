"""Cues: where quotations are announced, named, blessed and graded; all word lists are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs_of(words: DataFrame, key: str, members: list[str], most: int = 9) -> DataFrame:
    """key, pos, n of runs of words of a list (a blessing, say), cut after `most` words.

    words has key, pos, tok. Words of the list that follow each other differ from their rank by a
    constant, which names the run."""
    hit = words.filter(F.col("tok").isin(*members))
    by = Window.partitionBy(key).orderBy("pos")
    hit = hit.withColumn("_run", F.col("pos") - F.row_number().over(by))
    place = F.row_number().over(Window.partitionBy(key, "_run").orderBy("pos")) - 1
    return hit.withColumn("_cut", F.floor(place / most)).groupBy(key, "_run", "_cut").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).select(key, "pos", "n")


def reach(cues: DataFrame, places: DataFrame, key: str, most: int = 45) -> DataFrame:
    """places (key, pos) with announced (within `most` tokens after the beginning of a leading cue's end,
    or before a trailing one) and distance to the last cue before them.

    One ordered pass over cues and places together: no pair is formed. cues has key, pos, end, trailing."""
    c = cues.select(key, F.when(F.col("trailing"), F.col("pos")).otherwise(F.col("end")).alias("at"), F.lit(0).alias("_o"), "pos", "end", "trailing")
    p = places.select(key, F.col("pos").alias("at"), F.lit(1).alias("_o"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("boolean").alias("trailing"))
    both = c.unionByName(p)
    before = Window.partitionBy(key).orderBy("at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy("at", F.desc("_o")).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_lead", F.max(F.when(~F.col("trailing"), F.col("end"))).over(before)).withColumn("_trail", F.min(F.when(F.col("trailing"), F.col("pos"))).over(after))
    lead = F.coalesce(F.col("at") < F.col("_lead") + most, F.lit(False))
    trail = F.coalesce((F.col("_trail") > F.col("at")) & (F.col("at") >= F.col("_trail") - most), F.lit(False))
    return both.filter("_o = 1").select(key, F.col("at").alias("pos"), (lead | trail).alias("announced"), (F.col("at") - F.col("_lead")).alias("distance"))


def next_leading(cues: DataFrame, key: str) -> DataFrame:
    """cues with next_pos: where the next leading cue of the document that begins later does, or null."""
    later = Window.partitionBy(key).orderBy("pos").rangeBetween(1, Window.unboundedFollowing)
    return cues.withColumn("next_pos", F.min(F.when(~F.col("trailing"), F.col("pos"))).over(later))


def unanswered(cues: DataFrame, cites: DataFrame, key: str, answer: int = 16) -> DataFrame:
    """Leading cues that no citation answers: none covers a token from the cue's end up to `answer`
    tokens on, or up to the next leading cue. cites has key, ts, te."""
    c = next_leading(cues, key).filter(~F.col("trailing"))
    c = c.withColumn("_to", F.least(F.col("end") + answer, F.coalesce("next_pos", F.col("end") + answer)))
    s = cites.select(F.col(key).alias("_k"), "ts", "te")
    return c.join(s, (F.col(key) == F.col("_k")) & (F.col("ts") < F.col("_to")) & (F.col("te") > F.col("end")), "left_anti").drop("_to")


#: A spoken reference: a unit by number, or by a name of the list, then its verses.
def references(text: Column, unit: str, part: str, names: list[str]) -> Column:
    """Array of (unit, name, first, last) of spoken references in a normalised text: "<unit> 2 <part> 5 to 7",
    "<unit> <name>"; numbers that are missing are null, and a range that runs backwards is turned round."""
    called = "|".join(sorted(names, key=len, reverse=True)) or "$^"
    pattern = rf"\b{unit} (?:number )?(?:([0-9]{{1,3}})|({called}))(?: {part}s? (?:number )?([0-9]{{1,3}})(?: (?:to|through|until) ([0-9]{{1,3}}))?)?\b"
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    num = lambda x, g: F.try_to_number(F.nullif(F.regexp_extract(x, pattern, g), F.lit("")), F.lit("999")).cast("int")

    def one(x: Column) -> Column:
        a, b = num(x, 3), F.coalesce(num(x, 4), num(x, 3))
        name = F.nullif(F.regexp_extract(x, pattern, 2), F.lit(""))
        return F.struct(num(x, 1).alias("unit"), name.alias("name"), F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))

    return F.transform(whole, one)


def spoken_gradings(words: DataFrame, key: str, subjects: list[str], gradings: dict[str, str], near: int = 4) -> DataFrame:
    """key, pos, kind of words that grade, if one of the subjects stands at most `near` words before.

    words has key, pos, tok, every word of a text; gradings maps a word to its kind."""
    by = Window.partitionBy(key).orderBy("pos").rowsBetween(-near, -1)
    subject = F.max(F.col("tok").isin(*subjects)).over(by)
    kind = F.lit(None).cast("string")
    for w, k in gradings.items():
        kind = F.when(F.col("tok") == w, k).otherwise(kind)
    rows = words.withColumn("_s", subject).withColumn("kind", kind)
    return rows.filter("_s and kind is not null").select(key, "pos", "kind")


def collections_named(words: DataFrame, key: str, verbs: list[str], names: list[str], joiner: str = "and", most: int = 8) -> DataFrame:
    """key, pos, names: collections named after a verb ("reported by a and b"), a list of at most `most`.

    A list goes on over joiners; it ends at the first other word."""
    by = Window.partitionBy(key).orderBy("pos")
    kind = F.when(F.col("tok").isin(*verbs), "v").when(F.col("tok").isin(*names), "n").when(F.col("tok") == joiner, "j")
    w = words.withColumn("_k", kind).filter("_k is not null")
    fresh = (F.col("_k") == "v") | F.coalesce(F.col("pos") - F.lag("pos").over(by) != 1, F.lit(True))
    w = w.withColumn("_g", F.sum(fresh.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("_k") == "v", F.col("pos")))
    got = F.array_sort(F.collect_list(F.when(F.col("_k") == "n", F.struct("pos", "tok"))))
    out = w.groupBy(key, "_g").agg(first.alias("pos"), F.slice(F.transform(got, lambda x: x["tok"]), 1, most).alias("names"))
    return out.filter("pos is not null and size(names) > 0").select(key, "pos", "names")


def topic_words(words: Column, stop: list[str], most: int = 8) -> Column:
    """The different words of a question that are not stop words, the first `most` of them."""
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop))), 1, most)


def time_tolerance(words: DataFrame, key: str, base: float = 3.0, most: float = 30.0, even: float = 0.6) -> DataFrame:
    """key, tolerance: `base` seconds for real word times; where most neighbours last equally long without
    a gap, their times were spread over windows, and the tolerance is the longest of these, `most` at most.

    words has key, i, s, e. Texts with fewer than eight words have the base."""
    by = Window.partitionBy(key).orderBy("i")
    a, b = F.lag("s").over(by), F.lag("e").over(by)
    w = words.withColumn("_a", a).withColumn("_b", b)
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull()
    d, own = F.col("_b") - F.col("_a"), F.col("e") - F.col("s")
    flat = known & (F.abs(d - own) < 0.025) & (F.abs(F.col("s") - F.col("_b")) < 0.015) & (d > 0)
    w = w.withColumn("_known", known).withColumn("_flat", F.coalesce(flat, F.lit(False)))
    run = F.sum((~F.col("_flat")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    runs = w.withColumn("_run", run).groupBy(key, "_run").agg(
        F.min(F.when(F.col("_flat"), F.col("_a"))).alias("_s"), F.max(F.when(F.col("_flat"), F.col("e"))).alias("_e"),
        F.count_if("_flat").alias("_n"), F.count_if("_known").alias("_m"), F.count("*").alias("_all"),
    )
    out = runs.groupBy(key).agg(F.max(F.col("_e") - F.col("_s")).alias("_l"), F.sum("_n").alias("_n"), F.sum("_m").alias("_m"), F.sum("_all").alias("_all"))
    spread = (F.col("_all") >= 8) & (F.col("_m") > 0) & (F.col("_n") >= even * F.col("_m"))
    wide = F.least(F.lit(most), F.greatest(F.lit(base), F.floor(F.coalesce("_l", F.lit(0.0)) + 0.5).cast("double")))
    return out.select(key, F.when(spread, wide).otherwise(F.lit(base)).alias("tolerance"))
