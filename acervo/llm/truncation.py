"""Text cut off by field limits.

Lengths are recomputed as a store may have counted them (characters, UTF-8 bytes, UTF-16 bytes, HTML-escaped, JSON-escaped,
CRLF line ends) and grouped per source: a length at which far more texts end than around it is a hidden storage limit.
Then each text's ending is inspected; the limit decides endings that could be either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.sources import cut

#: Words a title does not end on, in the five languages.
FUNCTION_WORDS = tuple(
    "a al con da das de degli dei del della delle des di do dos du e el en em et for from in la las le les lo los no na of o os on or par para per por que se su the to un una und with y à é è".split()
)
MARK = r"(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|\x{FFFD}+)\s*$"
BLANKS = " \t\n\r\f\v\x85\xa0\u2028\u2029\ufeff\u200b"
SOUND_END = r"[.?!][»”\"')\]]*$|\(«[^«»]*»\)$"
ADDRESS_LINE = r"^\s*(?:https?://|www\.)\S+$"
TABLE_ROW = r"^\s*\d+(?:\s{2,}|\t|\s*\|\s*)\S.*\d\s*\|?$"
NUMBERED_HEADING = r"^\p{Lu}\p{L}+ [IVXLC]+$"
#: Month names of the five languages.
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre january february march april may june july august september october november december janeiro fevereiro março maio junho julho setembro outubro novembro dezembro janvier février mars avril mai juin juillet août septembre octobre novembre décembre gennaio febbraio aprile maggio giugno luglio settembre ottobre dicembre".split()
DATE_LINE = rf"(?i)^[^.?!]{{2,60}}, (?:{'|'.join(MONTHS)})(?: d[ei])? \d{{4}}$|^\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}$"
LIST_LINE = r"^\p{L}[\p{L} -]{2,24}: ?\S[^.?!]*$"
LIST_ITEM = r"^(?:[-•*·–]|\(?\d{1,3}[.)]|\(?\p{Ll}\))\s+\S[^.?!]*$"


def lengths(text: Column) -> dict[str, Column]:
    """The size of a text as different stores count it, each one expression over the text."""

    def n(*signs: str) -> Column:
        """How many of the signs there are; a sign that does not occur costs one search of the bytes."""
        return sum((F.char_length(text) - F.char_length(F.replace(text, F.lit(x), F.lit(""))) for x in signs), F.lit(0).cast("long"))

    chars = F.char_length(text).cast("long")
    wide, astral = F.regexp_count(text, F.lit(r"[\x{80}-\x{10FFFF}]")), F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    escaped = n('"', "\\", "\n", "\r", "\t")
    return {
        "chars": chars,
        "utf8": F.octet_length(text).cast("long"),
        "utf16": 2 * (chars + astral),
        "html": chars + 4 * n("&") + 3 * n("<", ">") + 5 * n('"', "'"),
        "json": chars + escaped,
        "json_ascii": chars + escaped + 5 * wide + 6 * astral,
        "crlf": chars + n("\n"),
    }


def storage_limits(df: DataFrame, text: str = "text", source: str = "source", least: int = 8, over: float = 8.0, copies: bool = True) -> DataFrame:
    """``source, measure, size, texts, around``: sizes at which a source's texts pile up.

    A size is a limit when ``least`` texts or more have it and that is above ``over`` times the mean of the 25 sizes on
    either side by more than ``over`` of its standard deviations. NULL texts are left out, a NULL source is a group of its own. Counts are taken per (source, measure, size) before
    anything else is shuffled, so a source with a third of all rows sends one row per size and task. Without ``copies`` equal
    texts of a source count once (told by a 64-bit hash and the sizes).
    """
    sizes = lengths(F.col(text))
    texts = df.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), *[v.alias(k) for k, v in sizes.items()], *([] if copies else [F.xxhash64(text).alias("_h")]))
    texts = texts if copies else texts.distinct()
    sized = texts.select("source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("size")) for k in sizes])).alias("x"))
    counts = sized.groupBy("source", F.col("x.measure").alias("measure"), F.col("x.size").alias("size")).agg(F.count("*").alias("texts"))
    near = W.partitionBy("source", "measure").orderBy("size").rangeBetween(-25, 25)
    around = (F.sum("texts").over(near) - F.col("texts")) / 50
    return counts.withColumn("around", around).where((F.col("texts") >= least) & (F.col("texts") > over * (F.col("around") + F.sqrt("around"))) & (F.col("size") >= 100))


def title_words(titles: DataFrame, share: float = 1e-4) -> DataFrame:
    """``word``: lower-case words that make up at least ``share`` of all words of titles; at most 1/share rows, so safe to broadcast."""
    words = titles.select(F.explode(F.regexp_extract_all(F.col(titles.columns[0]), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).select(F.lower("w").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    return counts.where(F.col("n") >= max(2.0, total * share)).select("word")


def endings(df: DataFrame, titles: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, source, ending, at_limit, truncated`` for every row.

    ending: ``empty`` (NULL or blank text, never truncated), ``sound`` (sentence end), ``address``, ``table``, ``heading``,
    ``date``, ``list``, ``title`` (all complete), ``marked`` (an ellipsis or a broken character after the cut) or ``open``.
    A link or blanks after the ending are set aside first. A list that ends at a storage limit of its
    source is truncated; at a limit no title is recognised. Duplicate keys give a row each; clashing extra columns are ignored.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    bare = F.rtrim(F.col("_text"), F.lit(BLANKS))
    rows = rows.withColumn("_bare", bare).withColumn("_tail", F.substring_index("_bare", "\n", -1)).withColumn("_linked", F.col("_tail").rlike(ADDRESS_LINE))
    before_link = F.rtrim(F.substring(F.col("_bare"), F.lit(1), F.char_length("_bare") - F.char_length("_tail")), F.lit(BLANKS))
    rows = rows.withColumn("_bare", F.when(F.col("_linked"), before_link).otherwise(F.col("_bare")))
    rows = rows.withColumn("_line", F.substring_index("_bare", "\n", -1))
    line = F.col("_line")
    kind = (
        F.when(F.col("_text").isNull() | ((F.col("_bare") == "") & ~F.col("_linked")), "empty")
        .when(F.col("_linked") & (F.col("_bare") == ""), "address")
        .when(line.rlike(MARK), "marked")
        .when(line.rlike(SOUND_END), "sound")
        .when(line.rlike(TABLE_ROW), "table")
        .when(line.rlike(NUMBERED_HEADING), "heading")
        .when(line.rlike(DATE_LINE), "date")
        .when(line.rlike(LIST_LINE) & F.lower(line).rlike(r"^(key|palabras? |palavras?|mots|parole|descri|temas|tags)"), "list")
        .when(line.rlike(LIST_ITEM), "list")
        .otherwise("open")
    )
    at = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("size")) for k, v in lengths(F.col("_text")).items()])
    # from here on a row is a key, a line and a few sizes: no text is shuffled
    rows = rows.select("_key", "_source", "_line", kind.alias("_kind"), at.alias("_sizes"))
    per_source = storage_limits(df, text, source, copies=False).groupBy("source").agg(F.collect_set(F.struct("measure", "size")).alias("_limits"))
    known = rows.join(per_source, F.col("_source").eqNullSafe(F.col("source")), "left").drop("source")
    # used three times below: once decided, kept as a key and, where a title is to be told, a line
    known = known.select("_key", "_source", F.when(F.col("_kind") == "open", F.col("_line")).alias("_line"), "_kind", F.coalesce(F.arrays_overlap("_sizes", "_limits"), F.lit(False)).alias("_at"))
    known = cut(known)
    words = F.filter(F.regexp_extract_all(F.col("_line"), F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: F.lower(w) == w)
    last = F.lower(F.regexp_extract(F.col("_line"), r"(\p{L}+)[^\p{L}]*$", 1))
    first = F.lower(F.regexp_extract(F.col("_line"), r"^[^\p{L}]*(\p{L}+)", 1))
    titled = (F.size(words) > 0) & ~last.isin(*FUNCTION_WORDS) & ~F.col("_line").rlike(r"\([^)]*$|[,;]$|[.?!] \p{Lu}")
    maybe = F.coalesce((F.col("_kind") == "open") & ~F.col("_at") & titled, F.lit(False))
    lines = known.where(maybe).select("_line").distinct()
    foreign = lines.select("_line", F.explode(F.array_union(words, F.array(first))).alias("word")).join(F.broadcast(title_words(titles)), "word", "left_anti").select("_line").distinct()
    asked = known.where(maybe).join(foreign.withColumn("_foreign", F.lit(True)), "_line", "left")
    told = known.where(~maybe).select("_key", "_source", "_kind", "_at").unionByName(asked.select("_key", "_source", F.when(F.col("_foreign"), "open").otherwise("title").alias("_kind"), "_at"))
    truncated = F.col("_kind").isin("marked", "open") | ((F.col("_kind") == "list") & F.col("_at"))
    return told.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_kind").alias("ending"), F.col("_at").alias("at_limit"), truncated.alias("truncated"))


def truncation_rates(found: DataFrame, source: str = "source") -> DataFrame:
    """``source, texts, truncated, rate`` per source (a NULL source is a group); empty input gives no rows."""
    n = F.count_if("truncated")
    return found.groupBy(source).agg(F.count("*").alias("texts"), n.alias("truncated"), F.round(n / F.count("*"), 6).alias("rate"))
