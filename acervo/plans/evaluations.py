"""Queries of the evaluation layer, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.operators import evaluation as E
from acervo.plans import sql as S
from acervo.sources import read_table

QUERIES: dict = {}
SQL: dict = {}
SYSTEMS = ["modelo-grande", "hibrido", "modelo-chico", "base-reglas", "solo-patrones"]

_KEYS = lambda x: f"list_transform(list_filter(coalesce({x}, []), lambda v: v IS NOT NULL AND lower(trim(v)) NOT IN ('', 'null')), lambda v: {S.metric_key('v')})"
_P, _T = S.present("pred"), S.present("truth")
MATCHED = f"(SELECT *, CASE WHEN p AND t THEN kp = kt ELSE NOT p AND NOT t END AS m FROM (SELECT *, {_P} AS p, {_T} AS t, {_KEYS('pred')} AS kp, {_KEYS('truth')} AS kt FROM {S.PAIRS}))"
_F1 = "CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END"
COUNTS = f"count(*) FILTER (p AND t AND m) AS tp, count(*) FILTER (p AND NOT (t AND m)) AS fp, count(*) FILTER (t AND NOT p) AS fn"
RATIOS = f"""round(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS "precision",
    round(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall, round(({_F1})::DOUBLE, 6) AS f1"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def pairs(spark, sf_dir):
    return read_table(spark, sf_dir, "evaluation_pairs", E.PAIR).distinct()


def _accuracy_sql(by: str) -> str:
    return f"""SELECT {by}, count(*) AS total, count(*) FILTER (m) AS matches, round(count(*) FILTER (m)::DOUBLE / count(*), 6) AS accuracy,
        count(*) FILTER (NOT p AND NOT t) AS both_absent, count(*) FILTER (NOT p AND t) AS pred_absent, count(*) FILTER (p AND NOT t) AS truth_absent FROM {MATCHED} GROUP BY {by}"""


@query("accuracy_by_field", _accuracy_sql("system, field"))
def accuracy_by_field(spark, sf_dir):
    return E.accuracy(pairs(spark, sf_dir), "system", "field")


@query("accuracy_by_type", _accuracy_sql("system, doc_type, field"))
def accuracy_by_type(spark, sf_dir):
    return E.accuracy(pairs(spark, sf_dir), "system", "doc_type", "field")


@query("accuracy_by_run", _accuracy_sql("run_no, system"))
def accuracy_by_run(spark, sf_dir):
    return E.accuracy(pairs(spark, sf_dir), "run_no", "system")


@query(
    "accuracy_all_fields",
    f"""SELECT system, count(*) AS records, count(*) FILTER (ok) AS perfect, round(count(*) FILTER (ok)::DOUBLE / count(*), 6) AS accuracy
        FROM (SELECT system, id, run_no, bool_and(m) AS ok FROM {MATCHED} GROUP BY system, id, run_no) GROUP BY system""",
)
def accuracy_all_fields(spark, sf_dir):
    rows = E.with_match(pairs(spark, sf_dir)).groupBy("system", "id", "run_no").agg(F.bool_and("match").alias("ok"))
    return rows.groupBy("system").agg(F.count("*").alias("records"), F.count_if("ok").alias("perfect"), F.round(F.count_if("ok") / F.count("*"), 6).alias("accuracy"))


@query("f1_by_field", f"SELECT *, {RATIOS} FROM (SELECT system, field, {COUNTS} FROM {MATCHED} GROUP BY system, field)")
def f1_by_field(spark, sf_dir):
    return E.f1(pairs(spark, sf_dir), "system", "field")


@query("f1_by_type", f"SELECT *, {RATIOS} FROM (SELECT system, doc_type, {COUNTS} FROM {MATCHED} GROUP BY system, doc_type)")
def f1_by_type(spark, sf_dir):
    return E.f1(pairs(spark, sf_dir), "system", "doc_type")


_LISTS = f"(SELECT *, list_distinct({_KEYS('pred')}) AS a, list_distinct({_KEYS('truth')}) AS b FROM {S.PAIRS})"
_J = "CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) END"


@query(
    "list_match_by_field",
    f"""SELECT system, field, round(avg({_J}), 6) AS jaccard, count(*) FILTER (({_J}) = 1.0) AS perfect, sum(len(list_intersect(a, b)))::BIGINT AS matching,
        sum(len(list_filter(b, lambda x: NOT list_contains(a, x))))::BIGINT AS missing, sum(len(list_filter(a, lambda x: NOT list_contains(b, x))))::BIGINT AS extra FROM {_LISTS} GROUP BY system, field""",
)
def list_match_by_field(spark, sf_dir):
    return E.list_match(pairs(spark, sf_dir), "system", "field")


@query(
    "list_elements",
    f"SELECT system, id, run_no, field, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS missing, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS extra FROM {_LISTS} WHERE len(a) + len(b) > 0",
)
def list_elements(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = pairs(spark, sf_dir).select("system", "id", "run_no", "field", F.array_distinct(E.keys(F.coalesce("pred", none))).alias("a"), F.array_distinct(E.keys(F.coalesce("truth", none))).alias("b"))
    return rows.where(F.size("a") + F.size("b") > 0).select("system", "id", "run_no", "field", F.array_sort(F.array_except("b", "a")).alias("missing"), F.array_sort(F.array_except("a", "b")).alias("extra"))


@query(
    "creator_director_overlap",
    f"""SELECT id, round(CASE WHEN len(ka) + len(kb) - m = 0 THEN 1.0 ELSE m::DOUBLE / (len(ka) + len(kb) - m) END, 6) AS jaccard FROM (SELECT *,
        coalesce(list_sum(list_transform(list_distinct(ka), lambda k: least(len(list_filter(ka, lambda x: x = k)), len(list_filter(kb, lambda x: x = k))))), 0) AS m FROM (SELECT id,
        list_transform(creator, lambda n: array_to_string({S.name_key('n')}, ' ')) AS ka, list_transform(list_concat(director, coalesce(codirector, [])), lambda n: array_to_string({S.name_key('n')}, ' ')) AS kb
        FROM {S.DATASET} WHERE creator IS NOT NULL AND director IS NOT NULL))""",
)
def creator_director_overlap(spark, sf_dir):
    from acervo.plans.texts import dataset

    df = dataset(spark, sf_dir, "creator", "director", "codirector").where("creator is not null and director is not null")
    both = F.concat("director", F.coalesce("codirector", F.array().cast("array<string>")))
    return df.select("id", F.round(E.name_jaccard(F.col("creator"), both), 6).alias("jaccard"))


_EMPTY = lambda x: f"({x} IS NULL OR len({x}) = 0 OR (NOT coalesce({x}_is_list, false) AND len({x}) = 1 AND coalesce(trim({x}[1]) = '', true)))"
_PE, _TE = _EMPTY("pred"), _EMPTY("truth")
_FLAT = lambda x: f"list_sort(list_transform({x}, lambda v: strip_accents(trim(lower(coalesce(v, 'None'))))))"
_SIMPLE = f"coalesce(pred_is_list = truth_is_list AND {_FLAT('pred')} = {_FLAT('truth')}, false)"
_NULLS = f"count(*) AS total, count(*) FILTER ({_PE}) AS pred_null, count(*) FILTER ({_TE}) AS truth_null, round(count(*) FILTER ({_PE})::DOUBLE / count(*), 6) AS pred_null_share, round(count(*) FILTER ({_TE})::DOUBLE / count(*), 6) AS truth_null_share"


@query("null_statistics", f"SELECT system, field, {_NULLS} FROM {S.PAIRS} GROUP BY system, field")
def null_statistics(spark, sf_dir):
    return E.null_statistics(pairs(spark, sf_dir), "system", "field")


@query("null_statistics_by_type", f"SELECT system, doc_type, field, {_NULLS} FROM {S.PAIRS} GROUP BY system, doc_type, field")
def null_statistics_by_type(spark, sf_dir):
    return E.null_statistics(pairs(spark, sf_dir), "system", "doc_type", "field")


def _breakdown_sql(above: float) -> str:
    return f"""SELECT system, field, count(*) FILTER ({_PE} AND {_TE}) AS null_match, count(*) FILTER ({_PE} AND NOT {_TE}) AS null_mismatch, count(*) FILTER (NOT {_PE} AND NOT {_TE} AND {_SIMPLE}) AS ok_match,
        count(*) FILTER (NOT {_PE} AND NOT {_TE} AND NOT {_SIMPLE}) AS wrong FROM {S.PAIRS} GROUP BY system, field HAVING count(*) FILTER ({_TE})::DOUBLE / count(*) < 0.8 AND count(*) FILTER ({_PE})::DOUBLE / count(*) > {above}"""


@query("field_breakdown", _breakdown_sql(0.8))
def field_breakdown(spark, sf_dir):
    return E.breakdown(pairs(spark, sf_dir))


@query("field_breakdown_any", _breakdown_sql(0.0))
def field_breakdown_any(spark, sf_dir):
    """Of every field with any empty prediction, as few fields reach the report's 0.8 here."""
    return E.breakdown(pairs(spark, sf_dir), pred_above=0.0)


_ORDER = "list_position([" + ", ".join(f"'{s}'" for s in SYSTEMS) + "], system)"
_SCORED = f"(SELECT system, field, round(({_F1})::DOUBLE, 6) AS f1 FROM (SELECT system, field, {COUNTS} FROM {MATCHED} GROUP BY system, field))"


@query("winners_by_field", f"SELECT field, system AS winner, f1 AS best FROM {_SCORED} QUALIFY row_number() OVER (PARTITION BY field ORDER BY f1 DESC, {_ORDER}) = 1")
def winners_by_field(spark, sf_dir):
    return E.winners(f1_by_field(spark, sf_dir), "f1", SYSTEMS, "system", "field")


def _rows_sql(by: str = "") -> str:
    """The rows of metrics; by: "" or a column with a comma after it."""
    g = f"system, {by}"
    return f"""(SELECT {g} field, 'accuracy' AS metric, round(count(*) FILTER (m)::DOUBLE / count(*), 6) AS value FROM {MATCHED} GROUP BY {g} field
        UNION ALL SELECT {g} '(all)', 'accuracy', round(count(*) FILTER (ok)::DOUBLE / count(*), 6) FROM (SELECT {g} run_no, id, bool_and(m) AS ok FROM {MATCHED} GROUP BY {g} run_no, id) GROUP BY {g.rstrip(', ')}
        UNION ALL SELECT {g} field, 'f1', round(({_F1})::DOUBLE, 6) FROM (SELECT {g} field, {COUNTS} FROM {MATCHED} GROUP BY {g} field) UNION ALL SELECT {g} '(all)', 'f1', round(({_F1})::DOUBLE, 6) FROM (SELECT {g} {COUNTS} FROM {MATCHED} GROUP BY {g.rstrip(', ')})
        UNION ALL SELECT {g} field, 'list', round(avg({_J}), 6) FROM {_LISTS} GROUP BY {g} field HAVING bool_or(truth_is_list))"""


@query("metric_rows", f"SELECT system, field, metric, value FROM {_rows_sql()}")
def metric_rows(spark, sf_dir):
    return E.metric_rows(pairs(spark, sf_dir))


@query("metric_rows_by_type", f"SELECT system, doc_type, field, metric, value FROM {_rows_sql('doc_type, ')}")
def metric_rows_by_type(spark, sf_dir):
    return E.metric_rows(pairs(spark, sf_dir), "doc_type")


@query("metric_summary", f"SELECT system, metric, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) AS n FROM {_rows_sql()} GROUP BY system, metric")
def metric_summary(spark, sf_dir):
    """Over the rows of metrics, those of all fields together included."""
    return metric_rows(spark, sf_dir).groupBy("system", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))


_BY_TYPE = f"(SELECT system, doc_type AS what, metric, round(avg(value), 6) AS value FROM {_rows_sql('doc_type, ')} GROUP BY system, doc_type, metric)"


@query(
    "win_tally",
    f"""SELECT system AS winner, count(*) AS wins FROM (SELECT * FROM (SELECT system, field AS what, metric, value FROM {_rows_sql()} WHERE field <> '(all)' UNION ALL SELECT * FROM {_BY_TYPE})
        QUALIFY row_number() OVER (PARTITION BY what, metric ORDER BY value DESC, {_ORDER}) = 1) GROUP BY system""",
)
def win_tally(spark, sf_dir):
    """Which system is best how often, over fields by three metrics and types by the means of three."""
    by_field = metric_rows(spark, sf_dir).where("field <> '(all)'").select("system", F.col("field").alias("what"), "metric", "value")
    by_type = metric_rows_by_type(spark, sf_dir).groupBy("system", F.col("doc_type").alias("what"), "metric").agg(F.round(F.avg("value"), 6).alias("value"))
    return E.winners(by_field.unionByName(by_type), "value", SYSTEMS, "system", "what", "metric").groupBy("winner").agg(F.count("*").alias("wins"))


@query("report_lines", f"SELECT field, metric, string_agg(format('{{:<14}} {{:10.6f}}', system, value), ' | ' ORDER BY system) AS line FROM {_rows_sql()} GROUP BY field, metric")
def report_lines(spark, sf_dir):
    """The report as text: a line per field and metric with every system's value."""
    cells = metric_rows(spark, sf_dir).select("field", "metric", F.struct("system", F.format_string("%-14s %10.6f", "system", "value").alias("cell")).alias("x"))
    return cells.groupBy("field", "metric").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["cell"]), " | ").alias("line"))


@query("system_ranking", f"SELECT field, system, f1, row_number() OVER (PARTITION BY field ORDER BY f1 DESC, system) AS place FROM {_SCORED}")
def system_ranking(spark, sf_dir):
    return f1_by_field(spark, sf_dir).select("field", "system", "f1", F.row_number().over(W.partitionBy("field").orderBy(F.desc("f1"), "system")).alias("place"))


@query("metric_pivot", f"PIVOT {_SCORED} ON system IN ({', '.join(S.q(s) for s in SYSTEMS)}) USING coalesce(first(f1), 0) GROUP BY field")
def metric_pivot(spark, sf_dir):
    return f1_by_field(spark, sf_dir).groupBy("field").pivot("system", SYSTEMS).agg(F.first("f1")).fillna(0.0)


@query(
    "applicable_fields",
    f"SELECT system, count(*) AS pairs FROM {S.PAIRS} WHERE (field, doc_type) IN (('issn', 'Articulo'), ('journaltitle', 'Articulo'), ('isbn', 'Libro'), ('publisher', 'Libro'), ('degree_name', 'Tesis')) GROUP BY system",
)
def applicable_fields(spark, sf_dir):
    applies = spark.createDataFrame([("issn", "Articulo"), ("journaltitle", "Articulo"), ("isbn", "Libro"), ("publisher", "Libro"), ("degree_name", "Tesis")], "field string, doc_type string")
    return pairs(spark, sf_dir).join(F.broadcast(applies), ["field", "doc_type"], "left_semi").groupBy("system").agg(F.count("*").alias("pairs"))


_TRUTH = "(SELECT coalesce(truth[1], 'none') AS y, coalesce(pred[1], 'none') AS p FROM " + S.PAIRS + " WHERE field = 'rights')"


def _labels(spark, sf_dir):
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit("none"))
    return pairs(spark, sf_dir).where("field = 'rights'").select(first("truth").alias("y"), first("pred").alias("p"))


@query(
    "classification_report",
    f"""WITH c AS (SELECT y, p, count(*) AS n FROM {_TRUTH} GROUP BY y, p), l AS (SELECT y AS label FROM c UNION SELECT p FROM c),
        s AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE y = label AND p = label), 0) AS tp, coalesce((SELECT sum(n) FROM c WHERE y = label), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE p = label), 0) AS given FROM l)
        SELECT round((sum(tp) / sum(support))::DOUBLE, 6) AS accuracy, round(avg(CASE WHEN given = 0 THEN 0 ELSE tp::DOUBLE / given END), 6) AS macro_precision,
        round(avg(CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END), 6) AS macro_recall, round(avg(CASE WHEN given + support = 0 THEN 0 ELSE 2.0 * tp::DOUBLE / (given + support) END), 6) AS macro_f1 FROM s""",
)
def classification_report(spark, sf_dir):
    return E.classification_report(_labels(spark, sf_dir), "y", "p")


@query("confusion_matrix", f"SELECT y AS y_true, p AS y_pred, count(*) AS n, least(99, round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY y), 0)::INT) AS percent FROM {_TRUTH} GROUP BY y, p")
def confusion_matrix(spark, sf_dir):
    return E.confusion_percent(_labels(spark, sf_dir), "y", "p")


@query("label_accuracy", f"SELECT y AS label, round(avg((y = p)::INT), 6) AS accuracy, count(*) AS n FROM {_TRUTH} GROUP BY y")
def label_accuracy(spark, sf_dir):
    return _labels(spark, sf_dir).groupBy(F.col("y").alias("label")).agg(F.round(F.avg((F.col("y") == F.col("p")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


@query(
    "token_recall",
    f"""SELECT id, round(CASE WHEN len(b) = 0 THEN NULL ELSE len(list_intersect(a, b))::DOUBLE / len(b) END, 6) AS recall FROM (SELECT id,
        list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(abstract), '[\\p{{L}}\\p{{N}}_]+')) AS b FROM {S.DATASET} WHERE title IS NOT NULL AND abstract IS NOT NULL)""",
)
def token_recall(spark, sf_dir):
    """Distinct tokens of the abstract that the title has, over all distinct tokens of the abstract."""
    from acervo.plans.texts import dataset

    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    a, b = tokens("title"), tokens("abstract")
    recall = F.round(F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)).cast("double") / F.size(b)), 6)
    return dataset(spark, sf_dir, given=F.col("title").isNotNull() & F.col("abstract").isNotNull(), recall=recall).where("given").drop("given")


@query(
    "keyword_overlap",
    f"""SELECT id, round(len(list_filter(s, lambda k: len(list_filter(r, lambda t: contains(lower(t), lower(k)) OR contains(lower(k), lower(t)))) > 0))::DOUBLE / len(s), 6) AS overlap
        FROM (SELECT id, keywords.real AS r, keywords.suggested AS s FROM {S.DATASET}) WHERE len(s) > 0 AND r IS NOT NULL""",
)
def keyword_overlap(spark, sf_dir):
    """Share of suggested keywords that contain, or are contained in, a real one."""
    from acervo.plans.texts import dataset

    df = dataset(spark, sf_dir, "keywords").select("id", F.col("keywords.real").alias("r"), F.col("keywords.suggested").alias("s")).where("size(s) > 0 and r is not null")
    hit = F.filter("s", lambda k: F.exists("r", lambda t: F.lower(t).contains(F.lower(k)) | F.lower(k).contains(F.lower(t))))
    return df.select("id", F.round(F.size(hit).cast("double") / F.size("s"), 6).alias("overlap"))
