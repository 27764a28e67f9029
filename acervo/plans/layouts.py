"""Queries over page layout, on word boxes derived from the documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.operators import layout as L
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


BOXES = """(SELECT doc_id, page_no, seq, text, x0, x0 + CASE WHEN doc_id % 7 = 0 THEN 34 ELSE 46 END AS x1, top, top + height AS bottom, height, 600.0::DOUBLE AS page_w, 800.0::DOUBLE AS page_h FROM (SELECT doc_id, seq // 300 + 1 AS page_no, seq, text,
    (CASE WHEN doc_id % 7 <> 0 THEN 50.0 + col * 50 + line % 3 * 6 + two WHEN col = 9 THEN CASE WHEN doc_id % 2 = 0 AND line % 3 = 0 THEN 480 ELSE 560 END ELSE 50.0 + col * 36 + two END)::DOUBLE AS x0, (60.0 + 14 * line + (seq % 2) * 0.5)::DOUBLE AS top,
    (CASE WHEN seq % 97 = 0 THEN 18.0 WHEN line % 11 = 0 THEN 14.0 ELSE 10.0 + (doc_id % 2) * 0.4 END)::DOUBLE AS height FROM (SELECT *, (seq % 300) // 10 AS line, seq % 10 AS col, CASE WHEN doc_id % 3 = 0 AND seq % 10 >= 5 THEN 40 ELSE 0 END AS two
    FROM (SELECT doc_id, generate_subscripts(w, 1) - 1 AS seq, unnest(w) AS text FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ') AS w FROM documents)))))"""
TIERS = f"(SELECT doc_id, list_max(hs) AS h1, hs[floor(len(hs) * 0.75)::INT + 1] AS h2 FROM (SELECT doc_id, list_sort(list(DISTINCT round_even(height, 0)::INT)) AS hs FROM {BOXES} WHERE page_no <= 5 AND round_even(height, 0) < 40 GROUP BY doc_id))"


def _boxes(spark, sf_dir):
    return L.boxes(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query("font_tiers", f"SELECT * FROM {TIERS}")
def font_tiers(spark, sf_dir):
    return L.font_tiers(_boxes(spark, sf_dir))


@query(
    "tagged_runs",
    f"""SELECT doc_id, run, first(tag) AS tag, count(*) AS words, string_agg(text, ' ' ORDER BY page_no, seq) AS text FROM (SELECT *, sum(CASE WHEN tag IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no, seq)::BIGINT AS run
        FROM (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY page_no, seq) AS prev FROM (SELECT b.*, CASE WHEN round_even(height, 0) >= h1 THEN 'h1' WHEN round_even(height, 0) >= h2 THEN 'h2' ELSE 'p' END AS tag
        FROM {BOXES} b JOIN {TIERS} t USING (doc_id)))) GROUP BY doc_id, run""",
)
def tagged_runs(spark, sf_dir):
    return L.tagged_runs(_boxes(spark, sf_dir))


GAPS = f"""(SELECT doc_id, page_no, count(*) AS wide, count(*) FILTER (hit) AS gapped, NOT bool_or(edge) AND count(*) >= 3 AND count(*) FILTER (hit)::DOUBLE / count(*) >= 0.35 AS two_columns FROM (SELECT doc_id, page_no, line, bool_or(edge) AS edge,
    bool_or(coalesce(x0 - prev >= 12 AND (prev - l) / (r - l) BETWEEN 0.25 AND 0.75, false)) AS hit FROM (SELECT *, lag(x1) OVER (PARTITION BY doc_id, page_no, line ORDER BY x0, seq) AS prev FROM (SELECT *, count(*) OVER p AS n, min(x0) OVER p AS l, max(x0) OVER p AS r,
    coalesce(count(*) FILTER (x0 >= 450) OVER g / count(*) OVER g::DOUBLE > 0.05 AND max(x0) FILTER (x0 >= 450) OVER g - min(x0) FILTER (x0 >= 450) OVER g < 60, false) AS edge FROM (SELECT *, round_even(top / 2, 0) * 2 AS line FROM {BOXES})
    WINDOW p AS (PARTITION BY doc_id, page_no, line), g AS (PARTITION BY doc_id, page_no)) WHERE n >= 4 AND r - l >= 0.4 * page_w) GROUP BY doc_id, page_no, line) GROUP BY doc_id, page_no)"""
VALLEYS = f"""(SELECT doc_id, page_no, words, CASE WHEN two_columns THEN (p + 0.5) * 30.0 END::DOUBLE AS split_x, right_spike, two_columns FROM (SELECT *, NOT right_spike AND low < 0.35 * list_max(h) AND list_sum(h[1:p]) >= 10 AND coalesce(list_sum(h[p + 2:20]), 0) >= 10 AS two_columns
    FROM (SELECT *, list_min(h[7:14]) AS low, list_position(h[7:14], list_min(h[7:14])) + 5 AS p, list_sum(h[15:20]) >= 10 AND list_max(h[15:20]) > 0.6 * list_sum(h[15:20]) AS right_spike FROM (SELECT doc_id, page_no, words, list_transform(range(0, 20), lambda i: len(list_filter(bs, lambda b: b = i))) AS h
    FROM (SELECT doc_id, page_no, list(least(floor((x0 + x1) / 2 / 30)::INT, 19)) AS bs, count(*) AS words FROM {BOXES} GROUP BY doc_id, page_no) WHERE words >= 25))))"""
PAGES = f"""(SELECT doc_id, page_no, words, split_x, (a AND NOT (spike AND NOT b AND words <= 250)) OR b AS two_columns FROM (SELECT s.doc_id, s.page_no, s.words, split_x, coalesce(g.two_columns, false) AS a, coalesce(v.two_columns, false) AS b, coalesce(right_spike, false) AS spike
    FROM (SELECT doc_id, page_no, count(*) AS words FROM {BOXES} GROUP BY doc_id, page_no) s LEFT JOIN {GAPS} g USING (doc_id, page_no) LEFT JOIN {VALLEYS} v USING (doc_id, page_no)))"""


@query("column_gaps", f"SELECT * FROM {GAPS}")
def column_gaps(spark, sf_dir):
    return L.char_gap(_boxes(spark, sf_dir))


@query("histogram_valleys", f"SELECT * FROM {VALLEYS}")
def histogram_valleys(spark, sf_dir):
    return L.histogram_valley(_boxes(spark, sf_dir))


@query("page_columns", f"SELECT * FROM {PAGES}")
def page_columns(spark, sf_dir):
    return L.page_columns(_boxes(spark, sf_dir))


@query(
    "column_votes",
    f"""SELECT doc_id, pages, CASE WHEN pages <= 2 THEN yes > 0 ELSE yes::DOUBLE / pages > 0.6 END AS two_columns FROM (SELECT doc_id, count(*) FILTER (page_no <= 5 AND words >= 25) AS pages,
        count(*) FILTER (page_no <= 5 AND words >= 25 AND two_columns) AS yes FROM {PAGES} GROUP BY doc_id)""",
)
def column_votes(spark, sf_dir):
    return L.document_vote(page_columns(spark, sf_dir))


@query(
    "column_votes_long",
    f"""SELECT doc_id, n AS pages, CASE WHEN n <= 2 THEN yes >= 1 ELSE yes::DOUBLE / n > 0.6 END AS two_columns FROM (SELECT doc_id, CASE WHEN apart THEN nf ELSE na END AS n, CASE WHEN apart THEN yf ELSE ya END AS yes FROM (SELECT *, nf > 0 AND last > 50 AND na - nf >= 2 AS apart
        FROM (SELECT doc_id, max(page_no) AS last, count(*) FILTER (page_no <= 5) AS na, count(*) FILTER (page_no <= 5 AND two_columns) AS ya, count(*) FILTER (page_no <= 5 AND words >= 25) AS nf, count(*) FILTER (page_no <= 5 AND words >= 25 AND two_columns) AS yf FROM {PAGES} GROUP BY doc_id)))""",
)
def column_votes_long(spark, sf_dir):
    return L.long_document_vote(page_columns(spark, sf_dir))


@query(
    "image_verdicts",
    """SELECT verdict, count(*) AS images, round(avg(w * h / 480000.0 * 100), 6) AS coverage FROM (SELECT *, CASE WHEN w * h / 480000.0 * 100 > 80 THEN 'full page' WHEN tag = 'Artifact' THEN 'artifact' WHEN w < 100 OR h < 50 THEN 'small' WHEN tag = 'Figure' THEN 'figure'
        WHEN NOT (w > 360 OR h > 480) THEN 'content' ELSE 'uncertain' END AS verdict FROM (SELECT (50 + (doc_id * 7 + i * 331) % 5 * 137)::DOUBLE AS w, (30 + (doc_id * 3 + i * 127) % 4 * 257)::DOUBLE AS h, CASE (doc_id + i) % 4 WHEN 0 THEN 'Artifact' WHEN 1 THEN 'Figure' END AS tag
        FROM documents, (SELECT unnest(range(0, 6)) AS i))) GROUP BY verdict""",
)
def image_verdicts(spark, sf_dir):
    i, d = F.col("i"), F.col("doc_id")
    images = read_table(spark, sf_dir, "documents", ["doc_id"]).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select(
        (50 + (d * 7 + i * 331) % 5 * 137).cast("double").alias("w"), (30 + (d * 3 + i * 127) % 4 * 257).cast("double").alias("h"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"),
        F.when((d + i) % 4 == 0, "Artifact").when((d + i) % 4 == 1, "Figure").alias("tag"),
    )
    return L.image_verdict(images).groupBy("verdict").agg(F.count("*").alias("images"), F.round(F.avg("coverage"), 6).alias("coverage"))


@query(
    "font_suspicions",
    """SELECT doc_id % 5 AS kind, count(*) AS documents, count(*) FILTER (doc_id % 5 IN (1, 2, 3)) AS suspicious, sum(CASE doc_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END)::BIGINT AS signs FROM documents GROUP BY 1""",
)
def font_suspicions(spark, sf_dir):
    """Font lists derived by the document's number, sound and suspicious ones."""
    lists = [["Arial", "Times"], ["ABCDEF+ArialNarrow"], ["TimesNewRomanPSMT-Identity-H", None], ["{'basefont': '', 'type': 'Type3'}"], None]
    kind = F.col("doc_id") % 5
    fonts = F.lit(None).cast("array<string>")
    for k, names in enumerate(lists):
        if names:
            fonts = F.when(kind == k, F.array(*[F.lit(n).cast("string") for n in names])).otherwise(fonts)
    found = read_table(spark, sf_dir, "documents", ["doc_id"]).select(kind.alias("kind"), F.size(L.suspicious_fonts(fonts)).alias("n"))
    return found.groupBy("kind").agg(F.count("*").alias("documents"), F.count_if(F.col("n") > 0).alias("suspicious"), F.sum("n").alias("signs"))


_SPLIT = f"""(SELECT *, CASE WHEN sx IS NULL OR (n >= 2 AND l < sx AND r > sx AND NOT bool_or(coalesce(x0 - prev >= 21 AND sx BETWEEN prev AND x0, false)) OVER (PARTITION BY doc_id, page_no, line)) THEN 0 ELSE ((x0 + x1) / 2 >= sx)::INT END AS col FROM (SELECT *, count(*) OVER p AS n, min(x0) OVER p AS l, max(x1) OVER p AS r,
    lag(x1) OVER (PARTITION BY doc_id, page_no, line ORDER BY x0, seq) AS prev FROM (SELECT w.*, round_even(top / 2, 0) * 2 AS line, CASE WHEN two_columns THEN coalesce(split_x, 300) END AS sx FROM {BOXES} w LEFT JOIN {PAGES} USING (doc_id, page_no) WHERE bottom < 0.94 * page_h)
    WINDOW p AS (PARTITION BY doc_id, page_no, line)))"""


@query(
    "column_texts",
    f"""SELECT doc_id, page_no, string_agg(text, chr(10) || chr(10) ORDER BY col) AS text FROM (SELECT doc_id, page_no, col, string_agg(text, chr(10) ORDER BY line) AS text FROM
        (SELECT doc_id, page_no, col, line, string_agg(text, ' ' ORDER BY x0, seq) AS text FROM {_SPLIT} GROUP BY doc_id, page_no, col, line) GROUP BY doc_id, page_no, col) GROUP BY doc_id, page_no""",
)
def column_texts(spark, sf_dir):
    words = _boxes(spark, sf_dir)
    return L.column_text(words, L.page_columns(words))


@query(
    "image_profiles",
    """SELECT doc_id, count(*) AS images, count(*) FILTER (f) AS page_sized, count(*) FILTER (NOT f AND n = 1) AS kept FROM (SELECT *, w / 150.0 * 72 >= 0.8 * 600 AND h / 150.0 * 72 >= 0.8 * 800 AS f,
        row_number() OVER (PARTITION BY doc_id, w, h ORDER BY page_no, img_seq) AS n FROM (SELECT doc_id, i // 2 + 1 AS page_no, i % 2 AS img_seq, 200 + (doc_id * 7 + i * 331) % 5 * 300 AS w, 300 + (doc_id * 3 + i * 127) % 4 * 400 AS h
        FROM documents, (SELECT unnest(range(0, 6)) AS i))) GROUP BY doc_id""",
)
def image_profiles(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id"])
    i = F.col("i")
    images = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select(
        "doc_id", (F.floor(i / 2) + 1).alias("page_no"), (i % 2).alias("img_seq"), (200 + (F.col("doc_id") * 7 + i * 331) % 5 * 300).alias("w"), (300 + (F.col("doc_id") * 3 + i * 127) % 4 * 400).alias("h"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h")
    )
    return L.image_profile(images)


@query("dominant_heights", f"SELECT doc_id, h AS height FROM (SELECT doc_id, round_even(height, 0)::INT AS h, count(*) AS n FROM {BOXES} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, h) = 1")
def dominant_heights(spark, sf_dir):
    sizes = _boxes(spark, sf_dir).groupBy("doc_id", F.bround("height").cast("int").alias("h")).agg(F.count("*").alias("n"))
    return sizes.groupBy("doc_id").agg(F.max_by("h", F.struct("n", (-F.col("h")).alias("less"))).alias("height"))


@query(
    "detector_counts",
    f"""SELECT count(*) FILTER (t AND d) AS hits, count(*) FILTER (t AND NOT d) AS missed, count(*) FILTER (NOT t AND d) AS wrong, round(count(*) FILTER (t AND d)::DOUBLE / count(*) FILTER (t), 6) AS rate
        FROM (SELECT doc_id % 3 = 0 AS t, two_columns AS d FROM {PAGES})""",
)
def detector_counts(spark, sf_dir):
    """How the page verdict does on the boxes, of which every third document has two columns."""
    t, d = F.col("doc_id") % 3 == 0, F.col("two_columns")
    pages = L.page_columns(_boxes(spark, sf_dir))
    return pages.agg(F.count_if(t & d).alias("hits"), F.count_if(t & ~d).alias("missed"), F.count_if(~t & d).alias("wrong"), F.round(F.count_if(t & d) / F.count_if(t), 6).alias("rate"))
