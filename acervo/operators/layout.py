"""Page layout from word boxes: ``doc_id, page_no, seq, text, x0, x1, top, bottom, height, page_w, page_h``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def boxes(docs: DataFrame, per_page: int = 300, per_line: int = 10) -> DataFrame:
    """Word boxes laid out from plain texts by a fixed rule: every third document has two columns, every seventh words at the right edge."""
    w = docs.select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")), " ")).alias("seq", "text"))
    at = F.col("seq") % per_page
    line, col = F.floor(at / per_line), at % per_line
    two = F.when((F.col("doc_id") % 3 == 0) & (col >= per_line / 2), 40.0).otherwise(0.0)
    edge = F.when((F.col("doc_id") % 2 == 0) & (line % 3 == 0), 480.0).otherwise(560.0)
    x0 = F.when(F.col("doc_id") % 7 != 0, 50.0 + col * 50 + (line % 3) * 6 + two).when(col == 9, edge).otherwise(50.0 + col * 36 + two)
    height = F.when(F.col("seq") % 97 == 0, 18.0).when(line % 11 == 0, 14.0).otherwise(10.0 + (F.col("doc_id") % 2) * 0.4)
    top = 60.0 + 14 * line + (F.col("seq") % 2) * 0.5
    return w.select("doc_id", (F.floor(F.col("seq") / per_page) + 1).cast("int").alias("page_no"), "seq", "text", x0.alias("x0"), (x0 + F.when(F.col("doc_id") % 7 == 0, 34.0).otherwise(46.0)).alias("x1"), top.alias("top"), (top + height).alias("bottom"), height.alias("height"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"))


def font_tiers(words: DataFrame) -> DataFrame:
    """``doc_id, h1, h2``: of the distinct heights below 40 (rounded half to even) on pages 1 to 5 the largest, and the one at three quarters."""
    sizes = words.where("page_no <= 5").select("doc_id", F.bround("height").cast("int").alias("h")).where("h < 40")
    lists = sizes.groupBy("doc_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    return lists.select("doc_id", F.array_max("hs").alias("h1"), F.get("hs", F.floor(F.size("hs") * 0.75).cast("int")).alias("h2"))


def tagged_runs(words: DataFrame) -> DataFrame:
    """``doc_id, run, tag, words, text``: runs of words of one tag (h1, h2 or p by the tiers), in reading order.

    Tiers, runs and texts are formed within one partitioning by document; documents without tiers give no run.
    """
    h = F.bround("height").cast("int")
    of = W.partitionBy("doc_id")
    w = of.orderBy("page_no", "seq")
    rows = words.select("doc_id", "page_no", "seq", "text", h.alias("h")).withColumn("hs", F.array_sort(F.collect_set(F.when((F.col("page_no") <= 5) & (F.col("h") < 40), F.col("h"))).over(of))).where("size(hs) > 0")
    h1, h2 = F.array_max("hs"), F.get("hs", F.floor(F.size("hs") * 0.75).cast("int"))
    tagged = rows.withColumn("tag", F.when(F.col("h") >= h1, "h1").when(F.col("h") >= h2, "h2").otherwise("p")).drop("hs")
    runs = tagged.withColumn("new", (F.coalesce(F.lag("tag").over(w), F.lit("")) != F.col("tag")).cast("int")).withColumn("run", F.sum("new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "seq", "text"))), lambda x: x["text"]), " ")
    return runs.groupBy("doc_id", "run").agg(F.first("tag").alias("tag"), F.count("*").alias("words"), joined.alias("text"))


def _line() -> Column:
    return F.bround(F.col("top") / 2) * 2


def char_gap(words: DataFrame, gap: float = 12.0, ratio: float = 0.35) -> DataFrame:
    """``doc_id, page_no, wide, gapped, two_columns``: lines (2-point buckets) over 40 % of the page with a gap between a quarter and three quarters.

    A page whose words at the right edge (a quarter of its width) are over 5 % of all and within a tenth of the width has
    one column. All steps work within one partitioning by page.
    """
    page, by_line = W.partitionBy("doc_id", "page_no"), W.partitionBy("doc_id", "page_no", "line")
    right = F.when(F.col("x0") >= 0.75 * F.col("page_w"), F.col("x0"))
    rows = words.select("doc_id", "page_no", "seq", "x0", "x1", "page_w", _line().alias("line")).repartition("doc_id", "page_no")
    edge = (F.count(right).over(page) / F.count("*").over(page) > 0.05) & (F.max(right).over(page) - F.min(right).over(page) < 0.1 * F.col("page_w"))
    rows = rows.withColumn("edge", F.coalesce(edge, F.lit(False)))
    rows = rows.withColumn("n", F.count("*").over(by_line)).withColumn("left", F.min("x0").over(by_line)).withColumn("span", F.max("x0").over(by_line) - F.col("left"))
    rows = rows.where((F.col("n") >= 4) & (F.col("span") >= 0.4 * F.col("page_w")))
    prev = F.lag("x1").over(by_line.orderBy("x0", "seq"))
    rows = rows.withColumn("hit", F.coalesce((F.col("x0") - prev >= gap) & ((prev - F.col("left")) / F.col("span")).between(0.25, 0.75), F.lit(False)))
    lines = rows.groupBy("doc_id", "page_no", "line").agg(F.bool_or("hit").alias("hit"), F.bool_or("edge").alias("edge"))
    pages = lines.groupBy("doc_id", "page_no").agg(F.count("*").alias("wide"), F.count_if("hit").alias("gapped"), F.bool_or("edge").alias("edge"))
    return pages.select("doc_id", "page_no", "wide", "gapped", (~F.col("edge") & (F.col("wide") >= 3) & (F.col("gapped") / F.col("wide") >= ratio)).alias("two_columns"))


def histogram_valley(words: DataFrame, bins: int = 20, threshold: float = 0.35) -> DataFrame:
    """``doc_id, page_no, words, split_x, right_spike, two_columns``: a near-empty middle bin of word centres with ten words or more on either side.

    Pages of fewer than 25 words have no row. Where one bin of the right three tenths holds over 60 % of ten words or more there, the page has one column.
    """
    width = F.col("page_w") / bins
    b = F.least(F.floor((F.col("x0") + F.col("x1")) / 2 / width), F.lit(bins - 1)).cast("int")
    counts = words.select("doc_id", "page_no", "page_w", b.alias("b")).groupBy("doc_id", "page_no", "page_w").agg(F.count("*").alias("n"), *[F.count_if(F.col("b") == i).alias(f"b{i}") for i in range(bins)])
    arr = F.array(*[F.col(f"b{i}") for i in range(bins)])
    rows = counts.where("n >= 25").select("doc_id", "page_no", "page_w", "n", arr.alias("h"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    middle, right = F.slice("h", int(bins * 0.3) + 1, int(bins * 0.7) - int(bins * 0.3)), F.slice("h", int(bins * 0.7) + 1, bins)
    rows = rows.withColumn("low", F.array_min(middle)).withColumn("at", F.array_position(middle, F.array_min(middle)).cast("int") + int(bins * 0.3) - 1)
    rows = rows.withColumn("right_spike", (total(right) >= 10) & (F.array_max(right) > 0.6 * total(right)))
    rows = rows.withColumn("lhs", total(F.slice("h", F.lit(1), F.col("at")))).withColumn("rhs", total(F.slice("h", F.col("at") + 2, F.lit(bins) - F.col("at") - 1)))
    two = ~F.col("right_spike") & (F.col("low") < threshold * F.array_max("h")) & (F.col("lhs") >= 10) & (F.col("rhs") >= 10)
    return rows.select("doc_id", "page_no", F.col("n").alias("words"), F.when(two, (F.col("at") + 0.5) * F.col("page_w") / bins).alias("split_x"), "right_spike", two.alias("two_columns"))


def page_columns(words: DataFrame, few: int = 250) -> DataFrame:
    """``doc_id, page_no, words, split_x, two_columns`` per page: either detector, but gaps alone do not count beside a right spike on a page of ``few`` words or fewer."""
    sizes = words.groupBy("doc_id", "page_no").agg(F.count("*").alias("words"))
    a = char_gap(words).select("doc_id", "page_no", F.col("two_columns").alias("a"))
    b = histogram_valley(words).select("doc_id", "page_no", "split_x", "right_spike", F.col("two_columns").alias("b"))
    rows = sizes.join(a, ["doc_id", "page_no"], "left").join(b, ["doc_id", "page_no"], "left").na.fill(False, ["a", "b", "right_spike"])
    gaps = F.col("a") & ~(F.col("right_spike") & ~F.col("b") & (F.col("words") <= few))
    return rows.select("doc_id", "page_no", "words", "split_x", (gaps | F.col("b")).alias("two_columns"))


def document_vote(pages: DataFrame) -> DataFrame:
    """``doc_id, pages, two_columns`` of ``doc_id, page_no, words, two_columns``: over those of the first five pages with 25 words or more: none no, one or two any, else above 60 %."""
    counted = (F.col("page_no") <= 5) & (F.col("words") >= 25)
    votes = pages.groupBy("doc_id").agg(F.count_if(counted).alias("pages"), F.count_if(counted & F.col("two_columns")).alias("yes"))
    return votes.select("doc_id", "pages", F.when(F.col("pages") <= 2, F.col("yes") > 0).otherwise(F.col("yes") / F.col("pages") > 0.6).alias("two_columns"))


def column_text(words: DataFrame, pages: DataFrame, footer: float = 0.94) -> DataFrame:
    """``doc_id, page_no, text``: lines in order, words below ``footer`` of the page left out; on pages of two columns the left one first.

    pages: ``doc_id, page_no, split_x, two_columns``; without ``split_x`` a page is split in its middle. A line that spans the
    split without a gap there (20 points or 3.5 % of the width) is of full width and stays with the left column.
    """
    kept = words.where(F.col("bottom") < footer * F.col("page_h")).select("doc_id", "page_no", "seq", "text", "x0", "x1", "page_w", _line().alias("line"))
    rows = kept.join(pages.select("doc_id", "page_no", "split_x", "two_columns"), ["doc_id", "page_no"], "left")
    rows = rows.withColumn("sx", F.when(F.col("two_columns"), F.coalesce("split_x", F.col("page_w") / 2)))
    by_line = W.partitionBy("doc_id", "page_no", "line")
    prev = F.lag("x1").over(by_line.orderBy("x0", "seq"))
    apart = F.coalesce((F.col("x0") - prev >= F.greatest(F.lit(20.0), 0.035 * F.col("page_w"))) & F.col("sx").between(prev, F.col("x0")), F.lit(False))
    rows = rows.withColumn("apart", apart)
    spans = (F.count("*").over(by_line) >= 2) & (F.min("x0").over(by_line) < F.col("sx")) & (F.max("x1").over(by_line) > F.col("sx")) & ~F.bool_or("apart").over(by_line)
    rows = rows.withColumn("col", F.when(F.col("sx").isNull() | spans, 0).otherwise(((F.col("x0") + F.col("x1")) / 2 >= F.col("sx")).cast("int")))
    joined = lambda of, by, sign: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, of))), lambda x: x[of]), sign)
    lines = rows.groupBy("doc_id", "page_no", "col", "line").agg(joined("text", ("x0", "seq"), " ").alias("text"))
    columns = lines.groupBy("doc_id", "page_no", "col").agg(joined("text", ("line",), "\n").alias("text"))
    return columns.groupBy("doc_id", "page_no").agg(joined("text", ("col",), "\n\n").alias("text"))


def image_profile(images: DataFrame, dpi: float = 150.0) -> DataFrame:
    """``doc_id, images, page_sized, kept``: images that fill 80 % of a page both ways are skipped, equal sizes kept once per document."""
    full = (F.col("w") / dpi * 72 >= 0.8 * F.col("page_w")) & (F.col("h") / dpi * 72 >= 0.8 * F.col("page_h"))
    rows = images.withColumn("full", full).withColumn("n", F.row_number().over(W.partitionBy("doc_id", "w", "h").orderBy("page_no", "img_seq")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("images"), F.count_if("full").alias("page_sized"), F.count_if(~F.col("full") & (F.col("n") == 1)).alias("kept"))


def long_document_vote(pages: DataFrame, long: int = 50) -> DataFrame:
    """``doc_id, pages, two_columns`` of ``doc_id, page_no, words, two_columns``: a vote of all first five pages, but in documents of
    more than ``long`` pages of which two or more of these have fewer than 25 words, of the others alone, if there are any."""
    first = F.col("page_no") <= 5
    full = first & (F.col("words") >= 25)
    sums = pages.groupBy("doc_id").agg(F.max("page_no").alias("last"), F.count_if(first).alias("n"), F.count_if(first & F.col("two_columns")).alias("yes"), F.count_if(full).alias("n_full"), F.count_if(full & F.col("two_columns")).alias("yes_full"))
    apart = (F.col("last") > long) & (F.col("n") - F.col("n_full") >= 2) & (F.col("n_full") > 0)
    n, yes = F.when(apart, F.col("n_full")).otherwise(F.col("n")), F.when(apart, F.col("yes_full")).otherwise(F.col("yes"))
    return sums.select("doc_id", n.alias("pages"), F.when(n <= 2, yes >= 1).otherwise(yes / n > 0.6).alias("two_columns"))


def image_verdict(images: DataFrame) -> DataFrame:
    """Adds ``coverage`` (percent of the page) and ``verdict`` to ``w, h, page_w, page_h, tag`` in points: full pages, artifacts and small
    images are skipped, figures and other images that are not large processed, the rest uncertain."""
    coverage = F.col("w") * F.col("h") / (F.col("page_w") * F.col("page_h")) * 100
    tag = F.coalesce("tag", F.lit(""))
    large = (F.col("w") > 0.6 * F.col("page_w")) | (F.col("h") > 0.6 * F.col("page_h"))
    verdict = F.when(coverage > 80, "full page").when(tag == "Artifact", "artifact").when((F.col("w") < 100) | (F.col("h") < 50), "small").when(tag == "Figure", "figure").when(~large, "content").otherwise("uncertain")
    return images.withColumn("coverage", coverage).withColumn("verdict", verdict)


#: What in a list of fonts goes with text that cannot be read.
SUSPICIOUS_FONTS = ("+ArialNarrow", "ArialNarrow,Italic", "ArialNarrow", "Identity-H", "TimesNewRomanPSMT-Identity-H", "{'basefont': '', 'type': 'Type3'", "'type': 'Type3', 'encoding': 'F")


def suspicious_fonts(fonts: Column) -> Column:
    """Which of SUSPICIOUS_FONTS an ARRAY<STRING> of fonts holds; NULL lists and fonts hold none."""
    given = F.coalesce(fonts, F.array().cast("array<string>"))
    return F.filter(F.array(*[F.lit(x) for x in SUSPICIOUS_FONTS]), lambda p: F.exists(given, lambda f: F.coalesce(f.contains(p), F.lit(False))))
