"""Queries over text functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.plans import sql as S
from acervo.sources import read_table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL where there is one."""

    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def dataset(spark: SparkSession, sf_dir: str, *columns: str, **derived: Column) -> DataFrame:
    """One row per record key, the latest delivery (deliveries differ in harvested_at alone): ``id``, columns, derived values.

    Derived values are computed before rows are brought together by key, so that a text is not shuffled for a number.
    """
    df = read_table(spark, sf_dir, "dataset").select("id", "harvested_at", *columns, *[c.alias(k) for k, c in derived.items()])
    return df.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("harvested_at")))).where("_n = 1").drop("_n", "harvested_at")


@query("text_normalised", f"SELECT doc_id, {S.collapse_letters(S.collapse_signs(S.attach_acutes('text')))} AS clean FROM documents")
def text_normalised(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", T.normalise(F.col("text")).alias("clean"))


@query(
    "text_normalised_roman",
    f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all({S.collapse_signs(S.attach_acutes('text'))}, '[\\p{{L}}]+|[^\\p{{L}}]+'),
        lambda w: CASE WHEN regexp_matches(w, '^[IVXLCDM]+$') THEN w ELSE {S.collapse_letters('w')} END), '') AS clean FROM documents""",
)
def text_normalised_roman(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", T.normalise(F.col("text"), keep_roman=True).alias("clean"))


@query("acute_repair", f"SELECT doc_id, {S.attach_acutes('text')} AS fixed FROM documents WHERE contains(text, '´')")
def acute_repair(spark, sf_dir):
    df = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).where(F.col("text").contains("´"))
    return df.select("doc_id", T.attach_acutes(F.col("text")).alias("fixed"))


@query("acute_repair_originals", f"SELECT id, {S.attach_acutes('original_text')} AS fixed FROM {S.DATASET} WHERE contains(original_text, '´')")
def acute_repair_originals(spark, sf_dir):
    fixed = F.when(F.col("original_text").contains("´"), T.attach_acutes(F.col("original_text")))
    return dataset(spark, sf_dir, fixed=fixed).where("fixed is not null")


@query("accents_stripped", "SELECT DISTINCT title, strip_accents(title) AS bare FROM dataset WHERE title IS NOT NULL")
def accents_stripped(spark, sf_dir):
    df = read_table(spark, sf_dir, "dataset", ["title"]).where("title is not null")
    return df.select("title", T.strip_accents(F.col("title")).alias("bare")).distinct()


@query("metric_keys", f"SELECT DISTINCT title, {S.metric_key('title')} AS key FROM dataset WHERE title IS NOT NULL")
def metric_keys(spark, sf_dir):
    df = read_table(spark, sf_dir, "dataset", ["title"]).where("title is not null")
    return df.select("title", T.metric_key(F.col("title")).alias("key")).distinct()


@query("name_keys", f"SELECT DISTINCT name, array_to_string({S.name_key('name')}, ' ') AS key FROM (SELECT unnest(creator) AS name FROM dataset) WHERE name IS NOT NULL")
def name_keys(spark, sf_dir):
    df = read_table(spark, sf_dir, "dataset", ["creator"]).select(F.explode("creator").alias("name")).where("name is not null")
    return df.select("name", F.array_join(T.name_key(F.col("name")), " ").alias("key")).distinct()


@query("honorifics_dropped", f"SELECT DISTINCT name, {S.honorifics('name')} AS bare FROM (SELECT unnest(creator) AS name FROM dataset) WHERE name IS NOT NULL")
def honorifics_dropped(spark, sf_dir):
    df = read_table(spark, sf_dir, "dataset", ["creator"]).select(F.explode("creator").alias("name")).where("name is not null")
    return df.select("name", T.drop_honorifics(F.col("name")).alias("bare")).distinct()


@query(
    "person_names",
    """SELECT DISTINCT name, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(name, '[^\\p{L} .''`]', '', 'g'), ' +'), lambda w: w <> ''),
       lambda w: CASE WHEN regexp_matches(w, '^(\\p{L}\\.)+$') THEN upper(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') AS person
       FROM (SELECT unnest(creator) AS name FROM dataset) WHERE name IS NOT NULL""",
)
def person_names(spark, sf_dir):
    df = read_table(spark, sf_dir, "dataset", ["creator"]).select(F.explode("creator").alias("name")).where("name is not null")
    return df.select("name", T.person_name(F.col("name")).alias("person")).distinct()


@query("hyphens_joined", "SELECT doc_id, regexp_replace(text, '(\\p{L})-[ \\t\\n\\r]+(\\p{Ll})', '\\1\\2', 'g') AS joined FROM documents WHERE regexp_matches(text, '\\p{L}-[ \\t\\n\\r]+\\p{Ll}')")
def hyphens_joined(spark, sf_dir):
    df = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).where(F.col("text").rlike(r"\p{L}-[ \t\n\r]+\p{Ll}"))
    return df.select("doc_id", T.join_hyphens(F.col("text")).alias("joined"))


@query("hyphens_joined_originals", f"SELECT id, regexp_replace(original_text, '(\\p{{L}})-[ \\t\\n\\r]+(\\p{{Ll}})', '\\1\\2', 'g') AS joined FROM {S.DATASET} WHERE regexp_matches(original_text, '\\p{{L}}-[ \\t\\n\\r]+\\p{{Ll}}')")
def hyphens_joined_originals(spark, sf_dir):
    joined = F.when(F.col("original_text").rlike(r"\p{L}-[ \t\n\r]+\p{Ll}"), T.join_hyphens(F.col("original_text")))
    return dataset(spark, sf_dir, joined=joined).where("joined is not null")


@query(
    "cid_profiles",
    f"""SELECT id, len(c)::INT AS cid_count, len(list_distinct(c))::INT AS cid_distinct, round(CASE WHEN length(original_text) > 0
        THEN coalesce(list_sum(list_transform(c, lambda x: length(x))), 0) * 100.0 / length(original_text) ELSE 0 END::DOUBLE, 6) AS cid_percent
        FROM (SELECT id, original_text, regexp_extract_all(original_text, '\\(cid:[0-9]+\\)') AS c FROM {S.DATASET} WHERE original_text IS NOT NULL) WHERE len(c) > 0""",
)
def cid_profiles(spark, sf_dir):
    p = T.cid_profile(F.col("original_text"))
    out = dataset(spark, sf_dir, cid_count=p["cid_count"], cid_distinct=p["cid_distinct"], cid_percent=F.round(p["cid_percent"], 6))
    return out.where("cid_count > 0")


_CID = "100.0 * coalesce(list_sum(list_transform(regexp_extract_all(original_text, '\\(cid:[0-9]+\\)'), lambda x: length(x))), 0) / nullif(length(original_text), 0)"


@query(
    "cid_filter_counts",
    f"""SELECT status, count(*) AS records FROM (SELECT CASE WHEN p >= 70 THEN 'removed' WHEN p > 5 THEN 'cleaned' ELSE 'kept' END AS status
        FROM (SELECT coalesce({_CID}, 0) AS p FROM {S.DATASET})) GROUP BY status""",
)
def cid_filter_counts(spark, sf_dir):
    p = F.coalesce(T.cid_profile(F.col("original_text"))["cid_percent"], F.lit(0.0))
    status = F.when(p >= 70, "removed").when(p > 5, "cleaned").otherwise("kept")
    return dataset(spark, sf_dir, status=status).groupBy("status").agg(F.count("*").alias("records"))


@query("cid_dropped", f"SELECT id, trim(regexp_replace(regexp_replace(original_text, '\\(cid:[0-9]+\\)', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS clean FROM {S.DATASET} WHERE contains(original_text, '(cid:')")
def cid_dropped(spark, sf_dir):
    clean = F.when(F.col("original_text").contains("(cid:"), T.drop_cid(F.col("original_text")))
    return dataset(spark, sf_dir, clean=clean).where("clean is not null")


@query(
    "corpus_corruption",
    f"""SELECT doc_type, count(*) AS records, count(*) FILTER (n > 0) AS with_cid, count(*) FILTER (p > 5 OR d > 20) AS significant
        FROM (SELECT doc_type, len(c) AS n, len(list_distinct(c)) AS d, coalesce({_CID}, 0) AS p FROM (SELECT doc_type, original_text, coalesce(regexp_extract_all(original_text, '\\(cid:[0-9]+\\)'), []) AS c FROM {S.DATASET})) GROUP BY doc_type""",
)
def corpus_corruption(spark, sf_dir):
    p = T.cid_profile(F.coalesce(F.col("original_text"), F.lit("")))
    df = dataset(spark, sf_dir, "doc_type", **p)
    return df.groupBy("doc_type").agg(F.count("*").alias("records"), F.count_if(F.col("cid_count") > 0).alias("with_cid"), F.count_if((F.col("cid_percent") > 5) | (F.col("cid_distinct") > 20)).alias("significant"))


@query("corrupted_most", f"SELECT id, n AS cid_count, d AS cid_distinct, round(p, 6) AS cid_percent FROM (SELECT id, len(c)::INT AS n, len(list_distinct(c))::INT AS d, coalesce({_CID}, 0)::DOUBLE AS p FROM (SELECT id, original_text, coalesce(regexp_extract_all(original_text, '\\(cid:[0-9]+\\)'), []) AS c FROM {S.DATASET})) WHERE n > 0 ORDER BY round(p, 6) DESC, id LIMIT 20")
def corrupted_most(spark, sf_dir):
    """The twenty records with the largest share of glyph references."""
    p = T.cid_profile(F.coalesce(F.col("original_text"), F.lit("")))
    df = dataset(spark, sf_dir, **p).where("cid_count > 0")
    return df.select("id", "cid_count", "cid_distinct", F.round("cid_percent", 6).alias("cid_percent")).orderBy(F.desc("cid_percent"), "id").limit(20)


@query(
    "extraction_scores",
    """SELECT doc_id, round(CASE WHEN length(text) > 0 THEN (length(text) - len(regexp_extract_all(text, '\\(cid:[0-9]+\\)')) - len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')))::DOUBLE / length(text) ELSE 0 END, 6) AS score FROM documents""",
)
def extraction_scores(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", F.round(T.extraction_score(F.col("text")), 6).alias("score"))


@query(
    "extraction_scores_originals",
    f"""SELECT id, round(CASE WHEN length(original_text) > 0 THEN (length(original_text) - len(regexp_extract_all(original_text, '\\(cid:[0-9]+\\)')) - len(regexp_extract_all(original_text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')))::DOUBLE / length(original_text) ELSE 0 END, 6) AS score FROM {S.DATASET}""",
)
def extraction_scores_originals(spark, sf_dir):
    return dataset(spark, sf_dir, score=F.round(T.extraction_score(F.col("original_text")), 6))


@query(
    "readable_samples",
    """SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '\\(cid:[0-9]+\\)', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')), ' '), lambda w: regexp_matches(w, '^\\p{L}{3,}$'))[1:20], ' ') AS sample FROM documents""",
)
def readable_samples(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", T.readable_sample(F.col("text")).alias("sample"))


_TAGGED = "'<h1 id=\"a\">' || replace(text, ' de ', ' <p>de</p> ') || '</h1><pre>x</pre><h3>y</h3>'"


@query("tags_stripped", f"SELECT doc_id, regexp_replace({_TAGGED}, '</?h1[^>]*>|</?h2[^>]*>|</?p[^>]*>', '', 'g') AS plain, len(regexp_extract_all({_TAGGED}, '</?(?:h1|h2|p)[^>]*>'))::INT AS tags FROM documents")
def tags_stripped(spark, sf_dir):
    """Tags are put around and inside the texts, then found and stripped again."""
    tagged = F.concat(F.lit('<h1 id="a">'), F.replace("text", F.lit(" de "), F.lit(" <p>de</p> ")), F.lit("</h1><pre>x</pre><h3>y</h3>"))
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", T.strip_tags(tagged).alias("plain"), F.size(T.found_tags(tagged)).alias("tags"))


@query("licence_check", f"""SELECT coalesce(rights, '') AS rights, count(*) AS records, count(*) FILTER (rights <> '' AND regexp_matches(original_text, '(?i)creative\\s*commons|cc[-\\s]*by|https?://creativecommons\\.org/licenses/')) AS licensed FROM {S.DATASET} GROUP BY 1""")
def licence_check(spark, sf_dir):
    df = dataset(spark, sf_dir, "rights", held=T.licence_holds(F.col("rights"), F.col("original_text")))
    return df.groupBy(F.coalesce("rights", F.lit("")).alias("rights")).agg(F.count("*").alias("records"), F.count_if("held").alias("licensed"))


_TRIED = {"rights": "rights <> '' AND regexp_matches(original_text, '(?i)creative\\s*commons|cc[-\\s]*by')"} | {c: f"{c} <> '' AND contains(lower(original_text), lower({c}))" for c in ("rightsurl", "sedici_uri", "dc_uri")}


@query("exact_match_tally", f"SELECT field, count(*) FILTER (held) AS ok, count(*) FILTER (NOT held) AS failed, round(100.0::DOUBLE * count(*) FILTER (NOT held) / count(*), 6) AS failed_percent FROM ({' UNION ALL '.join(f"SELECT '{k}' AS field, coalesce({v}, false) AS held FROM {S.DATASET}" for k, v in _TRIED.items())}) GROUP BY field")
def exact_match_tally(spark, sf_dir):
    """Of each field that must stand in the text, in how many records it does."""
    t = F.lower("original_text")
    held = {"rights": T.licence_holds(F.col("rights"), F.col("original_text"))} | {c: F.coalesce((F.col(c) != "") & t.contains(F.lower(c)), F.lit(False)) for c in ("rightsurl", "sedici_uri", "dc_uri")}
    rows = dataset(spark, sf_dir, **{f"h_{k}": v for k, v in held.items()})
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"h_{k}").alias("held")) for k in held])).alias("x")).select("x.*")
    failed = F.count_if(~F.col("held"))
    return long.groupBy("field").agg(F.count_if("held").alias("ok"), failed.alias("failed"), F.round(100.0 * failed / F.count("*"), 6).alias("failed_percent"))


@query("licences_named", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN doc_id % 2 = 0 ELSE regexp_matches(text, '(?i)creative\\s*commons|cc[-\\s]*by') END AS held FROM documents WHERE text IS NOT NULL""")
def licences_named(spark, sf_dir):
    """Round trip: a licence is written into two of three texts, in its forms, and stated or not."""
    third = F.col("doc_id") % 3
    notice = F.when(third == 0, F.concat(F.lit("Licencia Creative\nCommons 4.0 "), "text")).when(third == 1, F.concat("text", F.lit(" CC-BY-NC-SA 4.0"))).otherwise(F.col("text"))
    stated = F.when((third == 1) & (F.col("doc_id") % 2 == 1), "").otherwise("CC")
    rows = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).where("text is not null")
    return rows.select("doc_id", T.licence_holds(stated, notice).alias("held"))


@query(
    "identifier_formats",
    f"""SELECT id, CASE WHEN regexp_matches(issn, '^[0-9]{{4}}-[0-9Xx]{{4}}$') THEN issn END AS issn,
        CASE WHEN regexp_matches(regexp_replace(isbn, '[-\\s]', '', 'g'), '^([0-9Xx]{{10}}|[0-9Xx]{{13}})$') THEN isbn END AS isbn,
        CASE WHEN regexp_matches(date_issued, '^[0-9]{{4}}(/[0-9]{{2}}(/[0-9]{{2}})?)?$') THEN date_issued END AS date_issued FROM {S.DATASET}""",
)
def identifier_formats(spark, sf_dir):
    df = dataset(spark, sf_dir, "issn", "isbn", "date_issued")
    return df.select("id", F.when(T.valid_issn(F.col("issn")), F.col("issn")).alias("issn"), F.when(T.valid_isbn(F.col("isbn")), F.col("isbn")).alias("isbn"), F.when(T.valid_partial_date(F.col("date_issued")), F.col("date_issued")).alias("date_issued"))


@query(
    "identifier_in_text",
    f"""SELECT id, CASE WHEN coalesce(original_text, '') = '' OR contains(original_text, issn) THEN issn END AS issn,
        CASE WHEN coalesce(original_text, '') = '' OR contains(original_text, isbn) OR contains(original_text, regexp_replace(isbn, '[^0-9]', '', 'g')) THEN isbn END AS isbn
        FROM {S.DATASET} WHERE issn IS NOT NULL OR isbn IS NOT NULL""",
)
def identifier_in_text(spark, sf_dir):
    none = F.coalesce("original_text", F.lit("")) == ""
    t = F.col("original_text")
    issn = F.when(none | t.contains(F.col("issn")), F.col("issn"))
    isbn = F.when(none | t.contains(F.col("isbn")) | t.contains(F.regexp_replace("isbn", "[^0-9]", "")), F.col("isbn"))
    df = dataset(spark, sf_dir, given=F.col("issn").isNotNull() | F.col("isbn").isNotNull(), issn_kept=issn, isbn_kept=isbn).where("given")
    return df.select("id", F.col("issn_kept").alias("issn"), F.col("isbn_kept").alias("isbn"))


@query(
    "uri_in_text",
    f"""SELECT count(*) AS records, count(*) FILTER (contains(lower(original_text), lower(sedici_uri))) AS own_uri, count(*) FILTER (contains(lower(original_text), lower(dc_uri))) AS dc_uri, count(*) FILTER (contains(lower(original_text), lower(rightsurl))) AS rights_url FROM {S.DATASET}""",
)
def uri_in_text(spark, sf_dir):
    low = F.lower("original_text")
    df = dataset(spark, sf_dir, own=low.contains(F.lower("sedici_uri")), dc=low.contains(F.lower("dc_uri")), rights_in=low.contains(F.lower("rightsurl")))
    return df.agg(F.count("*").alias("records"), F.count_if("own").alias("own_uri"), F.count_if("dc").alias("dc_uri"), F.count_if("rights_in").alias("rights_url"))


@query(
    "title_in_text",
    f"""SELECT doc_type, count(*) AS records, count(*) FILTER (contains(lower(original_text), lower(title))) AS found FROM {S.DATASET} WHERE title <> '' AND original_text <> '' GROUP BY doc_type""",
)
def title_in_text(spark, sf_dir):
    both = (F.col("title") != "") & (F.col("original_text") != "")
    df = dataset(spark, sf_dir, "doc_type", both=both, inside=F.lower("original_text").contains(F.lower("title"))).where("both")
    return df.groupBy("doc_type").agg(F.count("*").alias("records"), F.count_if("inside").alias("found"))


@query("volume_issues", f"SELECT DISTINCT journalvolumeandissue AS raw, {S.volume_issue('journalvolumeandissue')} AS clean FROM dataset WHERE journalvolumeandissue IS NOT NULL")
def volume_issues(spark, sf_dir):
    df = read_table(spark, sf_dir, "dataset", ["journalvolumeandissue"]).where("journalvolumeandissue is not null").distinct()
    return df.select(F.col("journalvolumeandissue").alias("raw"), T.volume_issue(F.col("journalvolumeandissue")).alias("clean"))


@query(
    "keyword_bases",
    f"""SELECT id, list_transform(keywords.real, lambda k: CASE WHEN contains(k, '::') THEN trim(split_part(k, '::', 1)) ELSE k END) AS bases FROM {S.DATASET} WHERE len(keywords.real) > 0""",
)
def keyword_bases(spark, sf_dir):
    return dataset(spark, sf_dir, "keywords").where(F.size("keywords.real") > 0).select("id", F.transform("keywords.real", T.before_authority).alias("bases"))


@query("first_tokens", "SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ')[1:500], ' ') AS head FROM documents")
def first_tokens(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", T.first_tokens(F.col("text")).alias("head"))


@query("folded_text", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS fingerprint FROM documents")
def folded_text(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", F.md5(T.fold_space(F.col("text"))).alias("fingerprint"))


@query("letter_token_counts", "SELECT doc_id, len(regexp_extract_all(lower(regexp_replace(text, 'https?://[^ \\t\\n\\r]+', ' ', 'g')), '\\p{L}{4,}'))::INT AS tokens FROM documents")
def letter_token_counts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", F.size(T.letter_tokens(F.col("text"))).alias("tokens"))


@query(
    "keyword_context",
    """SELECT doc_id, text[greatest(p - 20, 1) : greatest(p - 20, 1) + p - greatest(p - 20, 1) + 7 + 60 - 1] AS around FROM (SELECT doc_id, text, instr(lower(text), 'resumen') AS p FROM documents) WHERE p > 0""",
)
def keyword_context(spark, sf_dir):
    df = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return df.select("doc_id", T.context(F.col("text"), "resumen").alias("around")).where("around is not null")


@query("titles_with_subtitles", f"SELECT id, concat_ws(': ', title, journaltitle) AS full_title FROM {S.DATASET}")
def titles_with_subtitles(spark, sf_dir):
    return dataset(spark, sf_dir, "title", "journaltitle").select("id", F.concat_ws(": ", "title", "journaltitle").alias("full_title"))


_KINDS = {"cid": ("\\(cid:[0-9]+\\)", 50), "control": ("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", 100), "glyph names": ("(?:/[A-Za-z0-9_]+)+", 100), "escapes": ("\\\\u", 10)}
_CLASS = ", ".join(f"CASE WHEN len(regexp_extract_all(original_text, '{p}')) > {n} THEN '{k}' END" for k, (p, n) in _KINDS.items())


@query("corruption_classes", f"SELECT kinds, count(*) AS texts FROM (SELECT concat_ws(' + ', {_CLASS}) AS kinds FROM {S.DATASET}) GROUP BY kinds")
def corruption_classes(spark, sf_dir):
    return dataset(spark, sf_dir, kinds=T.corruption_class(F.col("original_text"))).groupBy("kinds").agg(F.count("*").alias("texts"))


@query("latin_texts", "SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS plain FROM documents WHERE NOT contains(text, chr(92)) AND NOT contains(text, '\"[')")
def latin_texts(spark, sf_dir):
    """Round trip: line ends, accents and a quoted list written as a model escapes them are read back."""
    df = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).where(~F.col("text").contains("\\") & ~F.col("text").contains('"['))
    escaped = F.replace(F.replace(F.regexp_replace("text", r"\s+", "\\\\r\\\\n"), F.lit("é"), F.lit("\\u00e9")), F.lit("ó"), F.lit("\\u00F3"))
    return df.select("doc_id", T.latin_text(escaped).alias("plain"))


@query("repeated_digits", f"SELECT id, issn AS fixed FROM {S.DATASET} WHERE regexp_matches(issn, '^[0-9]{{4}}-[0-9]{{4}}$')")
def repeated_digits(spark, sf_dir):
    """Round trip: every digit of an ISSN doubled, then repaired."""
    df = dataset(spark, sf_dir, "issn").where(F.col("issn").rlike("^[0-9]{4}-[0-9]{4}$"))
    return df.select("id", T.fix_repeated_digits(F.regexp_replace("issn", "([0-9])", "$1$1")).alias("fixed"))


@query("identifier_tally", f"SELECT doc_type, count(*) FILTER (contains(original_text, issn)) AS issn_ok, count(*) FILTER (NOT contains(original_text, issn)) AS issn_missing, count(*) FILTER (contains(original_text, isbn)) AS isbn_ok, count(*) FILTER (NOT contains(original_text, isbn)) AS isbn_missing FROM {S.DATASET} GROUP BY doc_type")
def identifier_tally(spark, sf_dir):
    t = F.col("original_text")
    df = dataset(spark, sf_dir, "doc_type", i=t.contains(F.col("issn")), b=t.contains(F.col("isbn")))
    return df.groupBy("doc_type").agg(*[F.count_if(c).alias(n) for n, c in {"issn_ok": F.col("i"), "issn_missing": ~F.col("i"), "isbn_ok": F.col("b"), "isbn_missing": ~F.col("b")}.items()])
