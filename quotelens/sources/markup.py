"""Books in line markup: headings (###), paragraphs (#), continuations (~~) and page marks inside lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions import text as T

#: A mark closes its page; marks of the edition's own counting are no words.
PAGE, MILESTONE = r"PageV(\d+)P(\d+)", r"\bms\d+\b"
HEADER_END = "#META#Header#End#"
HEADING_WORDS = 14


def markup_paragraphs(books: DataFrame, key: str, col: str, toc: str | None = None) -> DataFrame:
    """key, para, heading, volume, page, text: paragraphs of books, with the page on which the first word is
    printed: that of the next valid mark. Pages are 0 where fewer than two marks, or fewer than half
    of them, are valid. Lines under a heading that matches `toc` are left out. A heading of more than
    14 words is none. Texts without words give no paragraphs. Windows run over the segments of one book.
    """
    body = F.element_at(F.split(F.col(col), HEADER_END), -1)
    lines = books.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("_i", "_line")).filter(F.trim("_line") != "")
    marked = F.regexp_replace("_line", PAGE, "\u0001V$1P$2\u0001")
    segs = lines.select(key, "_i", F.col("_line").startswith("### ").alias("_h"), F.col("_line").startswith("# ").alias("_s"), F.posexplode(F.split(marked, "\u0001")).alias("_k", "_seg"))
    is_page = F.col("_seg").rlike(r"^V\d+P\d+$")
    number = lambda g: F.regexp_extract("_seg", r"^V(\d+)P(\d+)$", g).cast("int")
    segs = segs.withColumn("_mark", is_page).withColumn("_page", F.when(is_page & (number(2) > 0), F.struct(number(1).alias("v"), number(2).alias("p"))))
    stripped = F.regexp_replace(F.regexp_replace("_seg", r"^(###\s[#|\s]*|#\s|~~)", ""), MILESTONE, " ")
    segs = segs.withColumn("_words", F.when(is_page, "").otherwise(T.norm_en(F.when(F.col("_k") == 0, stripped).otherwise(F.regexp_replace("_seg", MILESTONE, " ")))))
    in_order = Window.partitionBy(key).orderBy("_i", "_k")
    upto, ahead = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(key)
    n = F.size(T.words(F.col("_words")))
    title = F.when(F.col("_h") & (n > 0) & (n <= HEADING_WORDS), F.col("_words"))
    segs = segs.withColumn("heading", F.coalesce(F.last(title, ignorenulls=True).over(upto), F.lit("")))
    segs = segs.withColumn("_next", F.first("_page", ignorenulls=True).over(ahead))
    segs = segs.withColumn("_valid", F.count("_page").over(whole)).withColumn("_marks", F.count_if("_mark").over(whole))
    text = segs.filter(~F.col("_h") & (F.col("_words") != ""))
    if toc is not None:
        text = text.filter(~F.col("heading").rlike(toc))
    before = F.lag("heading").over(in_order)
    # a line that begins with a mark has its words in a later segment: the first one with words starts the paragraph
    first = F.col("_s") & (F.coalesce(F.lag("_i").over(in_order), F.lit(-1)) != F.col("_i"))
    starts = first | before.isNull() | (before != F.col("heading"))
    text = text.withColumn("para", F.sum(starts.cast("int")).over(upto) - 1)
    usable = (F.col("_valid") >= 2) & (2 * F.col("_valid") >= F.col("_marks"))
    page = lambda x: F.when(usable, F.coalesce(F.col(f"_next.{x}"), F.lit(0))).otherwise(0)
    text = text.withColumn("_at", F.struct(page("v").alias("v"), page("p").alias("p")))
    rows = text.groupBy(key, "para").agg(
        F.min_by("heading", F.struct("_i", "_k")).alias("heading"), F.min_by("_at", F.struct("_i", "_k")).alias("_at"),
        F.array_sort(F.collect_list(F.struct("_i", "_k", "_words"))).alias("_w"),
    )
    return rows.select(key, "para", "heading", F.col("_at.v").alias("volume"), F.col("_at.p").alias("page"), F.array_join(F.transform("_w", lambda x: x["_words"]), " ").alias("text"))
