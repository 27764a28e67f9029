"""Queries over patterns in text, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.operators import patterns as P
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


_STOP = ", ".join(S.q(w) for w in sorted(set(P.STOP_WORDS)))
TOKENS = f"""(SELECT doc_id, pos, word FROM (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (SELECT doc_id,
    regexp_extract_all(lower(regexp_replace(text, 'https?://[^ \\t\\n\\r]+', ' ', 'g')), '\\p{{L}}{{3,}}') AS w FROM documents)) WHERE word NOT IN ({_STOP}))"""
BIGRAMS = f"(SELECT doc_id, word AS a, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM {TOKENS} QUALIFY b IS NOT NULL)"


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


@query("vocabulary", f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {TOKENS} GROUP BY word HAVING count(*) >= 2")
def vocabulary(spark, sf_dir):
    return P.vocabulary(_docs(spark, sf_dir), "doc_id", "text")


@query("bigram_counts", f"SELECT a, b, count(*) AS n FROM {BIGRAMS} GROUP BY a, b HAVING count(*) >= 5")
def bigram_counts(spark, sf_dir):
    return P.bigrams(_docs(spark, sf_dir), "doc_id", "text").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 5")


@query(
    "pmi_bigrams",
    f"""WITH w AS (SELECT word, count(*) AS n FROM {TOKENS} GROUP BY word), p AS (SELECT a, b, count(*) AS n FROM {BIGRAMS} GROUP BY a, b HAVING count(*) >= 3)
        SELECT p.a, p.b, p.n, round(log2(p.n::DOUBLE * (SELECT sum(n) FROM w) / (x.n::DOUBLE * y.n)), 6) AS pmi FROM p JOIN w x ON x.word = p.a JOIN w y ON y.word = p.b ORDER BY pmi DESC, a, b LIMIT 20000""",
)
def pmi_bigrams(spark, sf_dir):
    return P.pmi(_docs(spark, sf_dir), "doc_id", "text")


@query(
    "tfidf_terms",
    f"""WITH tf AS (SELECT doc_id, word, count(*) AS tf FROM {TOKENS} GROUP BY doc_id, word), d AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
        r AS (SELECT doc_id, tf.word, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS raw FROM tf JOIN d USING (word)),
        v AS (SELECT doc_id, word, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r)
        SELECT doc_id, word, weight FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) <= 5""",
)
def tfidf_terms(spark, sf_dir):
    return P.tfidf(_docs(spark, sf_dir), "doc_id", "text")


_GRAMS = " UNION ALL ".join(
    f"SELECT doc_id, {' || chr(32) || '.join(f'w[i + {k}]' for k in range(n))} AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT doc_id, list(word ORDER BY pos) AS w FROM {TOKENS} GROUP BY doc_id))" for n in (1, 2, 3)
)


@query(
    "tfidf_ngrams",
    f"""WITH tf AS (SELECT doc_id, term AS word, count(*) AS tf FROM ({_GRAMS}) GROUP BY ALL), d AS (SELECT word, count(*) AS df, sum(tf) AS n FROM tf GROUP BY word HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT count(*) FROM documents) ORDER BY n DESC, word LIMIT 60000),
        r AS (SELECT doc_id, tf.word, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS raw FROM tf JOIN d USING (word)),
        v AS (SELECT doc_id, word, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r)
        SELECT doc_id, word, weight FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) <= 5""",
)
def tfidf_ngrams(spark, sf_dir):
    """Runs of one to three words, in two texts or more and at most four fifths of them, the 60 000 commonest."""
    return P.tfidf(_docs(spark, sf_dir), "doc_id", "text", longest=3, min_df=2, max_df=0.8, features=60000)


@query("stem_counts")
def stem_counts(spark, sf_dir):
    return P.stem_counts(_docs(spark, sf_dir), "doc_id", "text")


@query("keyphrases")
def keyphrases(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return P.keyphrases(docs, "doc_id", "text", P.pmi(docs, "doc_id", "text", top=20000))


_HEAD, _SECOND = P.KEYWORD_HEAD.replace("'", "''"), P.SECOND_HEAD
_STOPS = ", ".join(S.q(w) for w in P.KEYWORD_STOPS)
_SECTION = f"""(SELECT doc_id, i, beside, list_position(list_transform(after, lambda x: x = '' OR length(x) > 120 OR regexp_replace(lower(x), '[.:]+$', '') IN ({_STOPS})), true) AS p, after FROM (SELECT doc_id, i,
    CASE WHEN regexp_matches(b, '{_SECOND}') THEN '' ELSE b END AS beside, lines[i + 1:i + 5] AS after FROM (SELECT doc_id, lines, i, regexp_extract(lines[i], '{_HEAD}', 2) AS b FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
    FROM (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS lines FROM documents)) WHERE regexp_matches(lines[i], '{_HEAD}'))))"""


@query(
    "keyword_sections",
    f"""SELECT doc_id, keywords FROM (SELECT doc_id, i, list_filter(list_transform(regexp_split_to_array(CASE WHEN beside <> '' AND length(beside) <= 120 THEN beside ELSE array_to_string(CASE WHEN coalesce(p, 0) = 0 THEN after ELSE after[1:p - 1] END, ' ') END, '{T.KEYWORD_SEPARATORS}'),
        lambda p: trim(regexp_replace(p, '[ \\t\\n\\r]+', ' ', 'g'))), lambda p: p <> '' AND length(p) <= 80 AND len(string_split(p, ' ')) <= 6) AS keywords FROM {_SECTION}) WHERE len(keywords) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1""",
)
def keyword_sections(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", P.keyword_section(F.col("text")).alias("keywords")).where("keywords is not null")


@query("found_abstracts")
def found_abstracts(spark, sf_dir):
    return P.abstracts(read_table(spark, sf_dir, "dataset", ["id", "original_text"]), "id", "original_text").distinct()


@query("abstract_similarity")
def abstract_similarity(spark, sf_dir):
    found = found_abstracts(spark, sf_dir).withColumnRenamed("abstract", "found")
    both = dataset(spark, sf_dir, "abstract").where("abstract is not null").select("id", "abstract").join(found, "id", "left")
    score = P.similarity(F.col("abstract"), F.col("found"))
    outcome = F.when(F.col("found").isNull(), "missing").when(F.col("score") == 1, "exact").when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.5, "close").otherwise("poor")
    return both.withColumn("score", score).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("records"))


@query(
    "lines_after_heading",
    f"""SELECT id, (i - 1)::INT AS line_no, lines[p + i] AS line FROM (SELECT id, lines, list_position(list_transform(lines, lambda x: regexp_matches(x, '^(Resumen|Abstract|Resumo)$')), true) AS p
        FROM (SELECT id, string_split(original_text, chr(10)) AS lines FROM {S.DATASET} WHERE original_text IS NOT NULL)), (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE p > 0 AND p + i <= len(lines)""",
)
def lines_after_heading(spark, sf_dir):
    df = read_table(spark, sf_dir, "dataset", ["id", "original_text"]).where("original_text is not null")
    return P.lines_after(df, "id", "original_text", "^(Resumen|Abstract|Resumo)$").distinct()


@query(
    "page_cutoff",
    """SELECT doc_id, part::INT AS part, words::INT AS words FROM (SELECT doc_id, part, words, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
        (SELECT doc_id, generate_subscripts(p, 1) - 1 AS part, len(regexp_extract_all(unnest(p), '[^ \\t\\n\\r]+')) AS words FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents))) WHERE before < 100""",
)
def page_cutoff(spark, sf_dir):
    return P.until_words(_docs(spark, sf_dir), "doc_id", "text", 100)


@query("rake_phrases")
def rake_phrases(spark, sf_dir):
    return P.rake(_docs(spark, sf_dir), "doc_id", "text")
