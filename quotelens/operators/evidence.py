"""Judging matches from counted evidence: the verdict table, filters, flags, gradings, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed thresholds of the verdict table.
CLOSE, CHANGED, PARTLY, SOME, MISHEARD = 0.86, 0.10, 0.55, 0.4, 0.20
LEAST_WORDS, CONTENT, CONTENT_CUE, FUNCTION_SHARE = 5, 3, 2, 0.5


def least_evidence(canonical: Column, cue: Column) -> Column:
    """Evidence that a match needs: less of a canonical text, and less after a cue."""
    return F.when(canonical, F.when(cue, 7.0).otherwise(16.0)).otherwise(F.when(cue, 12.0).otherwise(20.0))


def verdicts(m: DataFrame) -> Column:
    """verbatim, partial, lead, echo or reject for rows of counts; the first rule that holds decides.

    Columns of m. The strict counts of an alignment: asr, near, joined, diff, ins, del, matched, inf,
    evidence. The counts by sound, with what sounds alike as equal: d_q, d_changed, d_cols, d_run,
    d_matched, d_inf, d_content, d_evidence, d_content_evidence. Booleans: canonical (a fixed text),
    book, cue (a cue is near), near_cue (nothing much between), bracket (marks or a reference announce
    it), direct (right after a strong cue), starts (with the text, or where speech is reported), whole,
    closed (a sentence or a naming of the source ends it), anchored (found from a cue, not from
    seeds), formula (only formulas agree), chain and comment (the rejecting filters below).
    open_tail counts particles at the end that begin the next clause.
    """
    c = F.col
    changed = c("diff") + c("ins") + c("del")
    exact = (changed == 0) & (c("asr") + c("near") == 0)
    strict = (changed == 0) & (c("asr") + c("near") <= MISHEARD * c("matched"))
    told = F.when(strict, "verbatim").otherwise("partial")
    announced = c("cue") | c("bracket")
    run_of_fixed = c("canonical") & exact & (c("joined") == 0)
    content = F.when(c("near_cue") | c("bracket") | run_of_fixed, CONTENT_CUE).otherwise(CONTENT)
    plain = c("d_content_evidence") + FUNCTION_SHARE * (c("d_evidence") - c("d_content_evidence"))
    evidence = F.when(announced | ~c("canonical"), c("d_evidence")).otherwise(plain)
    least = least_evidence(c("canonical"), c("cue"))
    words = c("d_inf") - F.when(c("book"), c("open_tail")).otherwise(0)
    enough = lambda more, times: (words >= LEAST_WORDS + more) & (c("d_content") >= content) & (evidence >= least * times)
    close = (c("d_q") >= CLOSE) & (c("d_changed") <= CHANGED * c("d_cols")) & (c("d_run") >= F.least(F.lit(4), c("d_matched")))
    short = ~c("canonical") & ~c("book") & c("direct") & exact & (c("evidence") >= 5.0) & c("closed")
    short = short & (c("starts") | ((c("inf") >= 3) & (c("evidence") >= 12.0)))
    refused = (c("inf") < 2) | c("chain") | c("comment") | (c("formula") & c("canonical"))
    return (
        F.when(refused, "reject")
        .when(~c("formula") & close & enough(0, 1.0), told)
        .when(~c("formula") & close & c("canonical") & c("whole") & c("cue") & (c("d_evidence") >= 2.5), told)
        .when(~c("formula") & (c("d_q") >= PARTLY) & (c("d_run") >= 3) & enough(1, 1.25), "partial")
        .when(~c("formula") & short, F.when(c("whole"), "verbatim").otherwise("partial"))
        .when(~c("formula") & ~c("anchored") & (c("d_q") >= SOME) & (c("d_run") >= 3) & enough(0, 1.5), "lead")
        .when(~c("canonical") & ~c("book") & ~c("anchored") & exact & (c("inf") >= LEAST_WORDS) & (c("evidence") >= 16.0), "echo")
        .otherwise("reject")
    )


def lexicon_share(words: Column, strong: list[str], weak: list[str]) -> Column:
    """Share of words that transmit or connect, strong ones counting twice; 0 without words."""
    n = lambda some: F.size(F.filter(words, lambda w: w.isin(*some))) if some else F.lit(0)
    return F.when(F.size(words) > 0, (2 * n(strong) + n(weak)) / F.size(words)).otherwise(F.lit(0.0))


def is_chain(words: Column, strong: list[str], weak: list[str], share: float = 0.34) -> Column:
    """Whether words are a chain of transmitters rather than a text."""
    return lexicon_share(words, strong, weak) >= share


def alert_flags(weak_only: Column, fabricated: Column, agrees: Column, tail: Column, spoken_weak: Column, textual: Column, graded_weak: Column) -> Column:
    """What makes an entry worth a second look, as an array: weak or mush (found in books of weak texts
    only), weakmention, attr, tail, grade, dweak."""
    no = lambda x: F.coalesce(x, F.lit(False))
    first = F.when(no(weak_only), F.when(no(fabricated), "weak").otherwise("mush")).when(no(fabricated), "weakmention")
    return F.array_compact(
        F.array(
            first,
            F.when(agrees == F.lit(False), "attr"),
            F.when(no(tail), "tail"),
            F.when(no(spoken_weak), "grade"),
            F.when(~no(weak_only) & no(textual) & no(graded_weak), "dweak"),
        )
    )


def grade_summary(grades: DataFrame, keys: list[str], grade: str, by: str, order: str) -> DataFrame:
    """keys, kind, grade, judges of each source: strong or weak if all gradings that say so agree, mixed
    if they differ, none without any. grade is the most frequent one, first seen if tied."""
    from quotelens.functions.text import grade_class

    known = grades.withColumn("_c", grade_class(F.col(grade)))
    said = known.filter("_c <> 'neutral'")
    per = said.groupBy(*keys, "_c", grade).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    most = per.groupBy(*keys, "_c").agg(F.max_by(grade, F.struct(F.col("_n"), -F.col("_first"), F.col(grade))).alias("_g"))
    judges = said.groupBy(*keys, "_c").agg(F.countDistinct(by).alias("_j"))
    sides = most.join(judges, [*keys, "_c"]).groupBy(*keys).agg(
        F.max(F.when(F.col("_c") == "strong", F.col("_g"))).alias("_s"), F.max(F.when(F.col("_c") == "weak", F.col("_g"))).alias("_w"), F.sum("_j").alias("judges")
    )
    kind = F.when(F.col("_s").isNotNull() & F.col("_w").isNotNull(), "mixed").when(F.col("_s").isNotNull(), "strong").when(F.col("_w").isNotNull(), "weak")
    out = known.select(*keys).distinct().join(sides, keys, "left")
    both = F.when(kind == "mixed", F.concat_ws(" / ", "_s", "_w")).otherwise(F.coalesce("_s", "_w"))
    return out.select(*keys, F.coalesce(kind, F.lit("none")).alias("kind"), both.alias("grade"), F.coalesce("judges", F.lit(0)).alias("judges"))


def attribution_code(said: Column, found: Column, elsewhere: Column) -> Column:
    """What a spoken naming of collections says against where the text stands: collection_ok,
    collection_other_wording (there in another wording), collection_partial or collection_mismatch;
    null if nothing was named."""
    missing = F.array_except(said, found)
    absent = F.array_except(missing, elsewhere)
    some = (F.size(F.array_intersect(said, found)) > 0) | (F.size(F.array_intersect(missing, elsewhere)) > 0)
    return (
        F.when(F.size(F.coalesce(said, F.array())) == 0, F.lit(None).cast("string"))
        .when(F.size(missing) == 0, "collection_ok")
        .when(F.size(absent) == 0, "collection_other_wording")
        .when(some, "collection_partial")
        .otherwise("collection_mismatch")
    )


def reference_code(said: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, code: ref_ok if a spoken unit range meets a found one of the same unit, else ref_mismatch.
    said and found have key, unit, a, b."""
    other = found.select(F.col(key).alias("_k"), F.col("unit").alias("_u"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    meet = (F.col(key) == F.col("_k")) & (F.col("unit") == F.col("_u")) & (F.col("a") <= F.col("_b")) & (F.col("_a") <= F.col("b"))
    hit = said.join(other, meet, "left_semi").select(key).distinct().withColumn("_ok", F.lit(True))
    return said.select(key).distinct().join(hit, key, "left").select(key, F.when(F.col("_ok"), "ref_ok").otherwise("ref_mismatch").alias("code"))


def link_audit(rows: DataFrame, group: list[str], order: list[str], counter: str) -> DataFrame:
    """rows with unsafe: an address (group and counter) that comes twice, a counter that steps back or
    stands still, and every row of a group from where its counter begins again at 1."""
    by = Window.partitionBy(*group).orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(counter).over(before)
    out = rows.withColumn("_top", top).withColumn("_twice", F.count("*").over(Window.partitionBy(*group, counter)) > 1)
    out = out.withColumn("_one", (F.col("_top").isNotNull() & (F.col(counter) == 1)).cast("int"))
    restarted = F.max("_one").over(by.rowsBetween(Window.unboundedPreceding, 0)) == 1
    back = F.coalesce(F.col(counter) <= F.col("_top"), F.lit(False))
    return out.withColumn("unsafe", F.col("_twice") | restarted | back).drop("_top", "_twice", "_one")


def preferred(matches: DataFrame, by: list[str]) -> DataFrame:
    """The preferred source of each group: least tier, best share, most evidence, least stable rank."""
    order = F.struct(F.col("tier"), -F.col("q"), -F.col("evidence"), F.col("stable_rank"))
    cols = [c for c in matches.columns if c not in by]
    return matches.groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("_m")).select(*by, "_m.*")


def alternates(matches: DataFrame, by: list[str], ref: str, most: int = 40) -> DataFrame:
    """The other places to show: one a reference, in the order of tier and stable rank, at most `most`."""
    one = matches.withColumn("_r", F.row_number().over(Window.partitionBy(*by, ref).orderBy("tier", "stable_rank"))).filter("_r = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("tier", "stable_rank", ref))).filter(F.col("place") <= most).drop("_r")


def one_source(cites: DataFrame, places: DataFrame, doc: str, reach: int = 500) -> DataFrame:
    """doc, cite, pid: the place of each citation that holds most of what was said within `reach` tokens.

    cites has doc, cite, ts; places doc, cite, pid, size, first (the place it had): equally good places.
    Another place must hold strictly more than the first. Places meet by document and place, in
    slots of `reach` tokens, so the join stays near the diagonal."""
    p = places.join(cites, [doc, "cite"])
    near = p.select(F.col(doc).alias("_d"), F.col("pid").alias("_p"), F.col("ts").alias("_t"), F.col("size").alias("_s"), F.floor(F.col("ts") / reach).alias("_slot"))
    mine = p.withColumn("slot", F.explode(F.array(*[F.floor(F.col("ts") / reach) + k for k in (-1, 0, 1)])))
    on = (F.col(doc) == F.col("_d")) & (F.col("pid") == F.col("_p")) & (F.col("slot") == F.col("_slot")) & (F.abs(F.col("ts") - F.col("_t")) <= reach)
    held = mine.join(near, on).groupBy(doc, "cite", "pid", "first").agg(F.sum("_s").alias("held"))
    best = F.max_by("pid", F.struct("held", F.col("first").cast("int"), -F.col("pid")))
    return held.groupBy(doc, "cite").agg(best.alias("pid"))


def attach_gradings(gradings: DataFrame, hosts: DataFrame, doc: str, back: int = 40, ahead: int = 8) -> DataFrame:
    """doc, g, host, place: the citation that each spoken grading goes with: the last one that ends at
    most `back` tokens before it, else the first one that begins at most `ahead` tokens after it.

    gradings has doc, g, pos, end; hosts doc, host, ts, te. They meet in slots of `back` tokens."""
    slot = lambda x: F.floor(x / back)
    h = hosts.withColumn("_slot", F.explode(F.array_distinct(F.array(slot(F.col("te")), slot(F.col("ts")))))).withColumnRenamed(doc, "_d")
    g = gradings.withColumn("slot", F.explode(F.array(*[slot(F.col("pos")) + k for k in (-1, 0, 1)])))
    both = g.join(h, (F.col(doc) == F.col("_d")) & (F.col("slot") == F.col("_slot")))
    before = (F.col("te") <= F.col("pos") + 1) & (F.col("pos") - F.col("te") <= back)
    after = (F.col("ts") >= F.col("end") - 1) & (F.col("ts") - F.col("end") <= ahead)
    rows = both.filter(before | after).withColumn("place", F.when(before, "after").otherwise("before"))
    order = F.struct((F.col("place") == "before").cast("int"), F.when(before, -F.col("te")).otherwise(F.col("ts")), "host")
    return rows.groupBy(doc, "g").agg(F.min_by(F.struct("host", "place"), order).alias("x")).select(doc, "g", "x.host", "x.place")


def conflicting(a: DataFrame, b: DataFrame, key: str, tolerance: float = 3.0, overlap: float = 0.3, slot: float = 60.0) -> DataFrame:
    """a_id, b_id, time: entries of two ledgers that may be one quotation: equal key, a common source
    position, and times that meet within the tolerance. Entries have id, key, lo, hi, s, e."""
    x = a.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "lo", "hi", "s", "e")], F.col(key).alias("_k"))
    y = b.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "lo", "hi", "s", "e")], F.col(key).alias("_l"))
    cells = lambda s, e, more: F.explode(F.sequence(F.floor((F.col(s) - more) / slot), F.floor((F.col(e) + more) / slot)))
    both = x.withColumn("_c", cells("a_s", "a_e", tolerance)).join(y.withColumn("_f", cells("b_s", "b_e", 0)), (F.col("_k") == F.col("_l")) & (F.col("_c") == F.col("_f")))
    shared = F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo") + 1
    over = F.least("a_e", "b_e") - F.greatest("a_s", "b_s")
    shorter = F.least(F.col("a_e") - F.col("a_s"), F.col("b_e") - F.col("b_s"))
    ok = (shared >= 1) & (over >= -tolerance) & (over + tolerance >= overlap * shorter)
    time = F.when(shorter > 0, F.least(F.lit(1.0), over / shorter)).otherwise(F.when(over >= 0, 1.0).otherwise(0.0))
    return both.filter(ok).select("a_id", "b_id", F.round(time, 6).alias("time")).distinct()
