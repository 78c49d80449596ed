"""Page layout from words (page_id, word_id, x0, x1, top, bottom, page_width): columns, lines, tokens, paragraphs.

All windows are keyed by page, so a page's words are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.functions import urls as U

LINE_STEP = 2.5
PARAGRAPH_GAP = 12.0


def column_splits(words: DataFrame) -> DataFrame:
    """page_id, split: the middle of the widest gap between sorted word centres, where it separates two columns."""
    page = Window.partitionBy("page_id")
    rows = words.select("page_id", "page_width", ((F.col("x0") + F.col("x1")) / 2).alias("center"), "word_id")
    rows = rows.withColumn("next", F.lead("center").over(page.orderBy("center", "word_id"))).withColumn("words", F.count(F.lit(1)).over(page))
    rows = rows.withColumn("rank", F.row_number().over(page.orderBy("center", "word_id")))
    gap = F.col("next") - F.col("center")
    widest = rows.where("next IS NOT NULL").withColumn("n", F.row_number().over(page.orderBy(gap.desc(), "center", "word_id"))).where("n = 1")
    middle = (F.col("center") + F.col("next")) / 2
    fits = (gap >= 0.15 * F.col("page_width")) & middle.between(0.35 * F.col("page_width"), 0.65 * F.col("page_width"))
    sides = (F.col("rank") >= 0.25 * F.col("words")) & (F.col("words") - F.col("rank") >= 0.25 * F.col("words"))
    return widest.where(fits & sides).select("page_id", middle.alias("split"))


def with_columns(words: DataFrame) -> DataFrame:
    """words with col: 0, or 1 right of the page's split."""
    rows = words.join(column_splits(words), "page_id", "left")
    return rows.withColumn("col", F.when((F.col("x0") + F.col("x1")) / 2 > F.col("split"), 1).otherwise(0)).drop("split")


def with_lines(words: DataFrame, step: float = LINE_STEP) -> DataFrame:
    """words (with col) with line: a new one where the top moves by more than `step` from the word before."""
    order = Window.partitionBy("page_id", "col").orderBy("top", "x0", "word_id")
    opens = F.when(F.abs(F.col("top") - F.lag("top").over(order)) > step, 1).otherwise(0)
    return words.withColumn("opens", opens).withColumn("line", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def tokens(lines: DataFrame) -> DataFrame:
    """page_id, col, line, token, x0, x1, words: words of a line joined unless the gap is over max(1, 0.6 * median width)."""
    line = Window.partitionBy("page_id", "col", "line")
    order = line.orderBy("x0", "word_id")
    limit = F.greatest(F.lit(1.0), 0.6 * F.median(F.col("x1") - F.col("x0")).over(line))
    rows = lines.withColumn("limit", limit).withColumn("opens", F.when(F.col("x0") - F.lag("x1").over(order) > F.col("limit"), 1).otherwise(0))
    rows = rows.withColumn("token", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("page_id", "col", "line", "token").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("words"))


def line_text(lines: DataFrame) -> DataFrame:
    """page_id, col, line, top, bottom, text: the words (with text) of each line from left to right, blank ones left out."""
    words = F.sort_array(F.collect_list(F.struct("x0", "word_id", F.trim("text").alias("text"))))
    joined = F.array_join(F.filter(F.transform(words, lambda w: w["text"]), lambda t: t != ""), " ")
    return lines.groupBy("page_id", "col", "line").agg(F.min("top").alias("top"), F.max_by("bottom", F.struct("top", "x0", "word_id")).alias("bottom"), joined.alias("text"))


def paragraph_text(lines: DataFrame, gap: float = PARAGRAPH_GAP, clean: bool = False) -> DataFrame:
    """page_id, col, pos, text: paragraphs of words with text, by column; broken URLs and short headings take what follows them.

    clean: each paragraph is cleaned first, and those that the clean-up drops are left out."""
    order = Window.partitionBy("page_id", "col").orderBy("line")
    rows = line_text(lines).withColumn("opens", F.when(F.col("top") - F.lag("bottom").over(order) > gap, 1).otherwise(0))
    rows = rows.withColumn("paragraph", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("text <> ''")
    per = rows.groupBy("page_id", "col", "paragraph").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("text"))
    if clean:
        per = per.withColumn("text", U.clean_paragraph("text")).where("text <> ''")
    held = per.groupBy("page_id", "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]).alias("texts"))
    return held.select("page_id", "col", F.posexplode(T.merge_headings(T.merge_broken_urls("texts"))).alias("pos", "text"))


def paragraphs(lines: DataFrame, gap: float = PARAGRAPH_GAP) -> DataFrame:
    """page_id, col, paragraph, lines, words: a new paragraph where a line starts more than `gap` under the last word of the line before."""
    per = lines.groupBy("page_id", "col", "line").agg(F.min("top").alias("top"), F.max_by("bottom", F.struct("top", "x0", "word_id")).alias("bottom"), F.count(F.lit(1)).alias("words"))
    order = Window.partitionBy("page_id", "col").orderBy("line")
    per = per.withColumn("opens", F.when(F.col("top") - F.lag("bottom").over(order) > gap, 1).otherwise(0))
    per = per.withColumn("paragraph", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return per.groupBy("page_id", "col", "paragraph").agg(F.count(F.lit(1)).alias("lines"), F.sum("words").alias("words"))
