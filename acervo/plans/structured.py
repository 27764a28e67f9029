"""Queries over semi-structured values, each with its SQL; records are written in the format first and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.operators import structured as X
from acervo.plans import sql as S
from acervo.plans.texts import dataset
from acervo.sources import read_table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("event_properties", "SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events")
def event_properties(spark, sf_dir):
    return read_table(spark, sf_dir, "events", ["event_id", "event_type", "props"]).select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


_SALVAGE_RAW = """'{"título de-obra": "' || replace(title, '"', '') || '", "year": "' || coalesce(date_issued, '') || '", "título de-obra": "x", "n": 12, "open'"""


_PAIR = '"([^"]+)"\\s*:\\s*("[^"]*"|\\[[^\\]]*\\]|true|false|null|-?[0-9]+(?:\\.[0-9]+)?)'


@query(
    "salvaged_pairs",
    f"""SELECT id, field, regexp_replace(value, '^"|"$', '', 'g') AS value FROM (SELECT id, generate_subscripts(f, 1) AS pos, unnest(f) AS field, unnest(v) AS value FROM (SELECT id,
        regexp_extract_all(raw, '{_PAIR}', 1) AS f, regexp_extract_all(raw, '{_PAIR}', 2) AS v
        FROM (SELECT id, {_SALVAGE_RAW} AS raw FROM {S.DATASET} WHERE title IS NOT NULL))) QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY length(value) DESC, pos) = 1""",
)
def salvaged_pairs(spark, sf_dir):
    df = dataset(spark, sf_dir, "title", "date_issued").where("title is not null")
    raw = F.concat(F.lit('{"título de-obra": "'), F.replace("title", F.lit('"'), F.lit("")), F.lit('", "year": "'), F.coalesce("date_issued", F.lit("")), F.lit('", "título de-obra": "x", "n": 12, "open'))
    return X.salvage_pairs(df.select("id", raw.alias("raw")), "id", "raw")


@query("tolerant_objects", f"""SELECT id, title FROM {S.DATASET} WHERE title IS NOT NULL""")
def tolerant_objects(spark, sf_dir):
    """Objects cut before their closing bracket, in a fence: the title must come back."""
    df = dataset(spark, sf_dir, "title").where("title is not null")
    whole = F.to_json(F.struct("title"))
    raw = F.concat(F.lit("```json\n"), F.substring(whole, F.lit(1), F.length(whole) - 1))
    return X.tolerant_json(df.select("id", raw.alias("raw")), "id", "raw").select("id", F.get_json_object("value", "$.title").alias("title"))


@query("answers_after_marker", "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answer FROM documents")
def answers_after_marker(spark, sf_dir):
    raw = F.concat(F.lit("<think>plan</think> "), F.lit("```\n"), "text", F.lit("\n```"))
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", F.trim(X.strip_fence(X.after_marker(raw))).alias("answer"))


@query(
    "tei_records",
    f"""SELECT id, nullif(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '') AS title, list_filter(list_transform(list_filter(creator, lambda c: c IS NOT NULL), lambda c: trim(split_part(c, ',', 1)) || CASE WHEN trim(array_to_string(string_split(c, ',')[2:], ',')) <> '' THEN ', ' || trim(array_to_string(string_split(c, ',')[2:], ',')) ELSE '' END),
        lambda a: a <> '') AS authors, doc_type AS keywords FROM {S.DATASET} WHERE title IS NOT NULL AND NOT regexp_matches(title || coalesce(array_to_string(creator, ''), ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')""",
)
def tei_records(spark, sf_dir):
    """Round trip: titles and every creator written as TEI, with what XML cannot hold (controls) left out, and read back."""
    df = dataset(spark, sf_dir, "title", "creator", "doc_type").where("title is not null")
    df = df.where(~F.concat("title", F.coalesce(F.array_join("creator", ""), F.lit(""))).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    author = lambda c: F.concat(
        F.lit("<author><persName><surname>"), X.escape_markup(F.trim(F.split_part(c, F.lit(","), F.lit(1)))), F.lit("</surname><forename>"),
        X.escape_markup(F.trim(F.when(c.contains(","), F.regexp_replace(c, r"(?s)^[^,]*,", "")).otherwise(""))), F.lit("</forename></persName></author>"),
    )
    authors = F.array_join(F.transform(F.array_compact(F.coalesce("creator", F.array().cast("array<string>"))), author), "")
    tei = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title level="a" type="main">'), X.escape_markup(F.col("title")), F.lit("</title></titleStmt><sourceDesc>"), authors,
        F.lit("</sourceDesc></fileDesc><profileDesc><keywords><term>"), F.col("doc_type"), F.lit("</term></keywords></profileDesc></teiHeader></TEI>"),
    )
    f = X.tei_fields(tei)
    return df.select("id", f["title"].alias("title"), F.when(F.col("creator").isNotNull(), f["authors"]).alias("authors"), F.array_join(f["keywords"], ", ").alias("keywords"))


def _around(keyword: str, chars: int) -> str:
    at = f"instr(lower(original_text), {S.q(keyword.lower())})"
    return f"CASE WHEN {at} > 0 THEN substr(original_text, greatest({at} - 20, 1), {at} + {chars} - greatest({at} - 20, 1)) END"


_FIRST = lambda words, chars: "coalesce(" + ", ".join(f"trim({_around(k, chars)}, ' ')" for k in words) + ")"
_FORM = lambda keyword, chars, pattern: f"nullif(regexp_extract({_around(keyword, chars)}, '{pattern}', 1), '')"
_FOUND = ", ".join(f"{_FIRST(*v)} AS {k}" for k, v in X.SEARCHED.items())


@query(
    "searched_fields",
    f"""SELECT id, {_FORM("ISSN", 50, "([0-9]{4}-[0-9]{3}[0-9X])")} AS issn, {_FORM("ISBN", 50, "([0-9]{3}-[0-9]{1,5}-[0-9]{1,7}-[0-9]{1,7}-[0-9X])")} AS isbn,
        'Vol. ' || {_FORM("Vol", 30, "(?i)vol[.]?[ ]*([0-9]+)")} AS volume, {_FOUND} FROM {S.DATASET} WHERE original_text <> ''""",
)
def searched_fields(spark, sf_dir):
    f = X.searched_fields(F.col("original_text"))
    return dataset(spark, sf_dir, given=F.col("original_text") != "", **f).where("given").select("id", *f)


@query("searched_by_type", f"SELECT id, {', '.join(f'CASE WHEN doc_type = {S.q(of)} THEN {_FIRST(words, chars)} END AS {k}' for k, (of, words, chars) in X.SEARCHED_BY_TYPE.items())} FROM {S.DATASET} WHERE original_text <> ''")
def searched_by_type(spark, sf_dir):
    f = X.searched_by_type(F.col("original_text"), F.col("doc_type"))
    return dataset(spark, sf_dir, given=F.col("original_text") != "", **f).where("given").select("id", *f)


@query("tei_keywords", f"SELECT id, doc_type || ' | b & c' AS keywords FROM {S.DATASET}")
def tei_keywords(spark, sf_dir):
    """Round trip: two keywords as terms, as text or as a note."""
    kind = F.pmod(F.length("id") + F.ascii(F.substring("id", -1, 1)), F.lit(3))
    inner = F.when(kind == 0, F.concat(F.lit("<keywords><term>"), "doc_type", F.lit("</term><term> b &amp; c </term></keywords>"))).when(kind == 1, F.concat(F.lit("<keywords>"), "doc_type", F.lit("; b &amp; c;</keywords>")))
    inner = inner.otherwise(F.concat(F.lit('<note type="keywords">'), "doc_type", F.lit(", b &amp; c</note>")))
    tei = F.concat(F.lit("<TEI><profileDesc>"), inner, F.lit("</profileDesc></TEI>"))
    return dataset(spark, sf_dir, "doc_type").select("id", F.array_join(X.tei_keywords(tei), " | ").alias("keywords"))


@query("bibtex_records", f"SELECT id, title, coalesce(date_issued[1:4], '') AS year FROM {S.DATASET} WHERE title <> '' AND NOT regexp_matches(title, '[{{}}\\n]')")
def bibtex_records(spark, sf_dir):
    df = dataset(spark, sf_dir, "title", "date_issued").where("title <> ''").where(~F.col("title").rlike(r"[{}\n]"))
    entry = F.concat(F.lit("@misc{x,\n  title = {"), "title", F.lit("},\n  year = {"), F.coalesce(F.substring("date_issued", 1, 4), F.lit("")), F.lit("}\n}"))
    return df.select("id", X.bibtex_field(entry, "title").alias("title"), F.coalesce(X.bibtex_field(entry, "year"), F.lit("")).alias("year"))


@query("html_texts", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS plain FROM documents")
def html_texts(spark, sf_dir):
    df = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    page = F.concat(F.lit("<html><style>p{}</style><body><p>"), X.escape_markup(F.col("text")), F.lit("</p><script>x=1</script></body></html>"))
    return df.select("doc_id", X.html_text(page).alias("plain"))


@query("literal_lists")
def literal_lists(spark, sf_dir):
    """Creator elements that spell a list, with how many values they hold."""
    df = read_table(spark, sf_dir, "dataset", ["creator"]).select(F.explode("creator").alias("raw")).where(F.col("raw").startswith("[")).distinct()
    return df.select("raw", F.size(X.literal_list(F.col("raw"))).alias("n"))


@query(
    "record_json",
    f"""SELECT id, '{{' || array_to_string(list_filter(['"id":' || to_json(id), '"title":' || to_json(title), '"doc_type":' || to_json(doc_type), '"creator":' || to_json(creator), '"date_issued":' || to_json(date_issued)], lambda x: x IS NOT NULL), ',') || '}}' AS json FROM {S.DATASET}""",
)
def record_json(spark, sf_dir):
    """Records as JSON without their NULL fields."""
    df = dataset(spark, sf_dir, "title", "doc_type", "creator", "date_issued")
    return df.select("id", F.to_json(F.struct("id", "title", "doc_type", "creator", "date_issued")).alias("json"))


@query("event_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from acervo.streaming.incremental import daily_counts

    return daily_counts(read_table(spark, sf_dir, "events", ["ts", "event_type", "value"]))
