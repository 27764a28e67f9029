"""Queries of the curation layer, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.operators import curation as C
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


_TS = "coalesce(try_strptime(dc_date_issued, '%Y-%m-%d'), try_strptime(dc_date_issued, '%Y-%m'), try_strptime(dc_date_issued, '%Y'))"
_NN = " + ".join(f"({c} IS NOT NULL)::INT" for c in ("dc_identifier_uri", "dc_type_es", "dc_date_issued", "dc_title", "dc_title_es", "sedici_creator_person", "sedici_subject_materias", "sedici_rights_license"))
CURATED = f"""(SELECT * FROM (SELECT replace(string_split(split_part(dc_identifier_uri, '||', 1), 'handle/')[2], '/', '-') AS id, dc_type_es AS doc_type, year({_TS})::INT AS issued,
    coalesce(dc_title, dc_title_es) AS title, list_transform(string_split(sedici_creator_person, '||'), lambda v: CASE WHEN contains(v, '::') THEN trim(split_part(v, '::', 1)) ELSE v END) AS creators,
    m.subject, {_NN} AS complete FROM repository_export e LEFT JOIN (SELECT materia, subject FROM materias UNION SELECT subject, subject FROM materias) m
    ON m.materia = CASE WHEN contains(split_part(sedici_subject_materias, '||', 1), '::') THEN trim(split_part(split_part(sedici_subject_materias, '||', 1), '::', 1)) ELSE split_part(sedici_subject_materias, '||', 1) END)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY complete DESC, title) = 1)"""
_CURATED_COLUMNS = ["dc_identifier_uri", "dc_type_es", "dc_date_issued", "dc_title", "dc_title_es", "sedici_creator_person", "sedici_subject_materias", "sedici_rights_license"]


def curated(spark, sf_dir):
    """The export as typed records: families coalesced, ids from handles, subjects mapped to areas, one row per id."""
    df = read_table(spark, sf_dir, "repository_export", _CURATED_COLUMNS)
    first = T.before_authority(F.split_part("sedici_subject_materias", F.lit("||"), F.lit(1)))
    materias = read_table(spark, sf_dir, "materias")
    areas = materias.select(F.col("materia").alias("_m"), "subject").unionByName(materias.select(F.col("subject").alias("_m"), "subject")).distinct()
    issued = F.coalesce(*[F.try_to_timestamp("dc_date_issued", F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy")])
    rows = df.withColumn("complete", C.completeness(df)).withColumn("_m", first).withColumn("issued", F.year(issued)).withColumn("id", T.handle_id(F.col("dc_identifier_uri")))
    rows = rows.withColumn("creators", F.transform(F.split("sedici_creator_person", r"\|\|"), T.before_authority)).withColumnRenamed("dc_type_es", "doc_type")
    rows = C.coalesce_family(rows, "dc_title", "title").join(F.broadcast(areas), "_m", "left")
    return C.keep_first(rows.select("id", "doc_type", "issued", "title", "creators", "subject", "complete"), ["id"], F.desc("complete"), F.col("title").asc_nulls_last())


@query("curated_export", f"SELECT id, doc_type, issued, title, array_to_string(creators, '; ') AS creators, subject, complete FROM {CURATED}")
def curated_export(spark, sf_dir):
    return curated(spark, sf_dir).withColumn("creators", F.array_join("creators", "; "))


@query("recent_records", f"SELECT id, issued, doc_type FROM {CURATED} WHERE issued > 2018 AND doc_type IN ('Tesis', 'Libro', 'Articulo', 'Objeto de conferencia')")
def recent_records(spark, sf_dir):
    return curated(spark, sf_dir).where((F.col("issued") > 2018) & F.col("doc_type").isin("Tesis", "Libro", "Articulo", "Objeto de conferencia")).select("id", "issued", "doc_type")


@query("balanced_records", f"SELECT id, doc_type, complete FROM {CURATED} QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY complete DESC, id) <= 500")
def balanced_records(spark, sf_dir):
    return C.top_per_group(curated(spark, sf_dir).select("id", "doc_type", "complete"), "doc_type", 500, F.desc("complete"), F.col("id"))


@query("type_counts_total", f"SELECT coalesce(doc_type, CASE WHEN grouping(doc_type) = 1 THEN 'TOTAL' ELSE '(null)' END) AS doc_type, count(*) AS records FROM {S.DATASET} GROUP BY ROLLUP (doc_type)")
def type_counts_total(spark, sf_dir):
    df = dataset(spark, sf_dir, "doc_type").rollup("doc_type").agg(F.count("*").alias("records"), F.grouping("doc_type").alias("g"))
    return df.select(F.coalesce("doc_type", F.when(F.col("g") == 1, "TOTAL").otherwise("(null)")).alias("doc_type"), "records")


@query("subject_label_table", "SELECT id, label_year, subject FROM subject_labels QUALIFY row_number() OVER (PARTITION BY id ORDER BY label_year DESC NULLS LAST, subject) = 1")
def subject_label_table(spark, sf_dir):
    return C.keep_first(read_table(spark, sf_dir, "subject_labels"), ["id"], F.col("label_year").desc_nulls_last(), F.col("subject"))


@query("subject_frequencies", "SELECT subject, count(*) AS n FROM subject_labels GROUP BY subject HAVING count(*) >= 5")
def subject_frequencies(spark, sf_dir):
    return read_table(spark, sf_dir, "subject_labels", ["subject"]).groupBy("subject").agg(F.count("*").alias("n")).where("n >= 5")


@query("threshold_ladder", "SELECT t AS least, count(*) FILTER (n >= t) AS labels FROM (SELECT subject, count(*) AS n FROM subject_labels GROUP BY subject), (SELECT unnest([5, 10, 20, 50, 100]) AS t) GROUP BY t")
def threshold_ladder(spark, sf_dir):
    counts = read_table(spark, sf_dir, "subject_labels", ["subject"]).groupBy("subject").agg(F.count("*").alias("n"))
    steps = counts.agg(*[F.count_if(F.col("n") >= t).alias(str(t)) for t in (5, 10, 20, 50, 100)])
    return steps.select(F.explode(F.array(*[F.struct(F.lit(t).alias("least"), F.col(f"`{t}`").alias("labels")) for t in (5, 10, 20, 50, 100)])).alias("x")).select("x.*")


@query("capped_label_sample", "SELECT id, subject FROM (SELECT DISTINCT id, subject FROM subject_labels) QUALIFY count(*) OVER (PARTITION BY subject) >= 5 AND row_number() OVER (PARTITION BY subject ORDER BY md5('42|' || id), id) <= 200")
def capped_label_sample(spark, sf_dir):
    return C.capped_sample(read_table(spark, sf_dir, "subject_labels", ["id", "subject"]).distinct(), "subject", "id", 5, 200)


@query(
    "stratified_split",
    f"""SELECT id, CASE WHEN i <= floor(n * 0.8) THEN 'training' WHEN i <= floor(n * 0.8) + floor(n * 0.1) THEN 'test' ELSE 'validation' END AS split FROM (SELECT id,
        count(*) OVER (PARTITION BY doc_type) AS n, row_number() OVER (PARTITION BY doc_type ORDER BY md5('42|' || id), id) AS i FROM {S.DATASET})""",
)
def stratified_split(spark, sf_dir):
    return C.stratified_split(dataset(spark, sf_dir, "doc_type"), "doc_type", "id").select("id", "split")


_FREE = f"(SELECT id, doc_type FROM {S.DATASET} WHERE id NOT IN (SELECT id FROM subject_labels))"
_HELD = f"(SELECT doc_type, count(*) AS have FROM {S.DATASET} WHERE id IN (SELECT id FROM subject_labels) GROUP BY doc_type)"


def _labelled(spark, sf_dir):
    rows = dataset(spark, sf_dir, "doc_type")
    return rows.join(read_table(spark, sf_dir, "subject_labels", ["id"]).distinct(), "id", "left_semi"), rows


@query("quota_rows", f"SELECT id, doc_type FROM (SELECT id, doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY id) AS i FROM {_FREE}) LEFT JOIN {_HELD} USING (doc_type) WHERE i <= greatest(0, 500 - coalesce(have, 0))")
def quota_rows(spark, sf_dir):
    return C.quota(*_labelled(spark, sf_dir), "doc_type", "id", 500).select("id", "doc_type")


@query(
    "quota_plan",
    f"""SELECT doc_type, have, available, need, greatest(0, need - available)::BIGINT AS short FROM (SELECT doc_type, coalesce(have, 0)::BIGINT AS have, coalesce(available, 0)::BIGINT AS available,
        CASE WHEN n < 5 THEN 0 ELSE greatest(0, 500 - coalesce(have, 0)) END::BIGINT AS need FROM (SELECT doc_type, count(*) AS n FROM {S.DATASET} GROUP BY doc_type)
        LEFT JOIN {_HELD} USING (doc_type) LEFT JOIN (SELECT doc_type, count(*) AS available FROM {_FREE} GROUP BY doc_type) USING (doc_type))""",
)
def quota_plan(spark, sf_dir):
    return C.quota_plan(*_labelled(spark, sf_dir), "doc_type", "id", 500, least=5)


@query("evaluation_quota", f"SELECT id, doc_type FROM (SELECT id, doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY id) AS i FROM {S.DATASET} WHERE id NOT IN (SELECT id FROM extraction_timings WHERE id IS NOT NULL)) LEFT JOIN (SELECT doc_type, count(*) AS have FROM {S.DATASET} WHERE id IN (SELECT id FROM extraction_timings) GROUP BY doc_type) USING (doc_type) WHERE i <= greatest(0, 15 - coalesce(have, 0))")
def evaluation_quota(spark, sf_dir):
    """The evaluation set filled up to 15 of each type."""
    rows = dataset(spark, sf_dir, "doc_type")
    have = rows.join(read_table(spark, sf_dir, "extraction_timings", ["id"]).where("id is not null").distinct(), "id", "left_semi")
    return C.quota(have, rows, "doc_type", "id", 15).select("id", "doc_type")


@query("renamed_export", "SELECT DISTINCT dc_identifier_uri AS dc_uri, dc_type_es, dc_date_issued AS date, dc_title AS title, sedici_creator_person AS creator, sedici_rights_license AS rights FROM repository_export")
def renamed_export(spark, sf_dir):
    """The export under the names that records use."""
    columns = ["dc_identifier_uri", "dc_type_es", "dc_date_issued", "dc_title", "sedici_creator_person", "sedici_rights_license"]
    return C.renamed_keys(read_table(spark, sf_dir, "repository_export", columns), T.KEY_NAMES).distinct()


@query("attributes_removed", "SELECT DISTINCT doc_type, title, issn, rights, rightsurl FROM dataset")
def attributes_removed(spark, sf_dir):
    """Records without the attributes that curation drops and the fields that extraction must not give."""
    columns = ["id", "doc_type", "title", "issn", "rights", "rightsurl", "editor", "colaborator", "instituciondesarrollo", "isrelatedwith", "sedici_uri", "dc_uri"]
    return C.without_keys(read_table(spark, sf_dir, "dataset", columns), T.UNUSED_KEYS + T.FORBIDDEN_KEYS).distinct()


@query("aligned_records", f"SELECT id, title, date_issued AS issued, NULL::VARCHAR AS subtitle FROM {S.DATASET}")
def aligned_records(spark, sf_dir):
    return C.aligned(dataset(spark, sf_dir, "title", "date_issued"), {"id": "id", "title": "title", "issued": "date_issued", "subtitle": "subtitle"})


@query("pending_ids", f"SELECT id FROM {S.DATASET} WHERE id NOT IN (SELECT id FROM extraction_timings WHERE id IS NOT NULL)")
def pending_ids(spark, sf_dir):
    return dataset(spark, sf_dir).select("id").join(read_table(spark, sf_dir, "extraction_timings", ["id"]), "id", "left_anti")


@query("timed_ids", f"SELECT id, doc_type FROM {S.DATASET} WHERE id IN (SELECT id FROM extraction_timings)")
def timed_ids(spark, sf_dir):
    return dataset(spark, sf_dir, "doc_type").join(read_table(spark, sf_dir, "extraction_timings", ["id"]), "id", "left_semi")


@query("evaluated_records", f"SELECT id, count(*) AS pairs FROM {S.PAIRS} JOIN {S.DATASET} d USING (id) GROUP BY id")
def evaluated_records(spark, sf_dir):
    from acervo.plans.evaluations import pairs

    counted = pairs(spark, sf_dir).groupBy("id").agg(F.count("*").alias("pairs"))
    return counted.join(dataset(spark, sf_dir).select("id"), "id")


@query("container_names", f"SELECT id, coalesce(container_name, '') AS container, coalesce(kind, '') AS kind, coalesce(c.issn, '') AS container_issn FROM {S.DATASET} d LEFT JOIN containers c USING (container_id)")
def container_names(spark, sf_dir):
    c = read_table(spark, sf_dir, "containers").withColumnRenamed("issn", "container_issn")
    joined = dataset(spark, sf_dir, "container_id").join(F.broadcast(c), "container_id", "left")
    return joined.select("id", F.coalesce("container_name", F.lit("")).alias("container"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("container_issn", F.lit("")).alias("container_issn"))


_TIMES = "(SELECT DISTINCT id, doc_type, no_tags_s, with_tags_s, measured_at FROM extraction_timings)"


def _times(spark, sf_dir):
    return read_table(spark, sf_dir, "extraction_timings").distinct()


@query("total_times", f"SELECT id, round(coalesce(a, 0) + coalesce(b, 0), 4) AS total_s FROM (SELECT id, max(no_tags_s) AS a FROM {_TIMES} WHERE no_tags_s IS NOT NULL GROUP BY id) FULL JOIN (SELECT id, max(with_tags_s) AS b FROM {_TIMES} WHERE with_tags_s IS NOT NULL GROUP BY id) USING (id)")
def total_times(spark, sf_dir):
    t = _times(spark, sf_dir)
    a = t.where("no_tags_s is not null").groupBy("id").agg(F.max("no_tags_s").alias("a"))
    b = t.where("with_tags_s is not null").groupBy("id").agg(F.max("with_tags_s").alias("b"))
    return a.join(b, "id", "full_outer").select("id", F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 4).alias("total_s"))


@query("timing_statistics", f"SELECT coalesce(doc_type, CASE WHEN grouping(doc_type) = 1 THEN 'General' ELSE '(null)' END) AS doc_type, round(min(no_tags_s), 2) AS min_s, round(max(no_tags_s), 2) AS max_s, round(avg(no_tags_s), 2) AS avg_s, count(no_tags_s) AS n FROM {_TIMES} GROUP BY GROUPING SETS ((), (doc_type))")
def timing_statistics(spark, sf_dir):
    df = _times(spark, sf_dir).rollup("doc_type").agg(F.round(F.min("no_tags_s"), 2).alias("min_s"), F.round(F.max("no_tags_s"), 2).alias("max_s"), F.round(F.avg("no_tags_s"), 2).alias("avg_s"), F.count("no_tags_s").alias("n"), F.grouping("doc_type").alias("g"))
    return df.select(F.coalesce("doc_type", F.when(F.col("g") == 1, "General").otherwise("(null)")).alias("doc_type"), "min_s", "max_s", "avg_s", "n")


@query("timing_spread", f"SELECT doc_type, round(avg(with_tags_s), 4) AS mean, round(stddev_samp(with_tags_s), 4) AS sd, round(sum(with_tags_s), 2) AS total, count(*) FILTER (with_tags_s > 45) AS slow FROM {_TIMES} GROUP BY doc_type")
def timing_spread(spark, sf_dir):
    return _times(spark, sf_dir).groupBy("doc_type").agg(F.round(F.avg("with_tags_s"), 4).alias("mean"), F.round(F.stddev_samp("with_tags_s"), 4).alias("sd"), F.round(F.sum("with_tags_s"), 2).alias("total"), F.count_if(F.col("with_tags_s") > 45).alias("slow"))


@query("combined_titles", "SELECT DISTINCT dc_identifier_uri AS uri, list_filter([dc_title, dc_title_es], lambda x: x IS NOT NULL) AS titles FROM repository_export")
def combined_titles(spark, sf_dir):
    """All titles of a row as a list."""
    df = read_table(spark, sf_dir, "repository_export", ["dc_identifier_uri", "dc_title", "dc_title_es"])
    return df.select(F.col("dc_identifier_uri").alias("uri"), C.combine_family(df, "dc_title").alias("titles")).distinct()


@query(
    "pipe_values",
    """SELECT DISTINCT sedici_creator_person AS raw, list_filter(list_transform(string_split(sedici_creator_person, '||'), lambda v: trim(v)), lambda v: v <> '') AS vals,
        array_to_string(list_transform(string_split(sedici_creator_person, '||'), lambda v: CASE WHEN contains(v, '::') THEN trim(split_part(v, '::', 1)) ELSE v END), ', ') AS joined FROM repository_export WHERE sedici_creator_person IS NOT NULL""",
)
def pipe_values(spark, sf_dir):
    raw = read_table(spark, sf_dir, "repository_export", ["sedici_creator_person"]).where("sedici_creator_person is not null").distinct()
    c = F.col("sedici_creator_person")
    return raw.select(c.alias("raw"), T.split_pipe(c).alias("vals"), T.joined_values(c).alias("joined"))


@query("real_keywords", f"SELECT id, CASE WHEN len(keywords.real) > 0 THEN keywords.real END AS keywords FROM {S.DATASET}")
def real_keywords(spark, sf_dir):
    """The list of real keywords in place of the pair of lists; an empty one is NULL."""
    return dataset(spark, sf_dir, "keywords").select("id", F.when(F.size("keywords.real") > 0, F.col("keywords.real")).alias("keywords"))


@query("compare_sides", f"SELECT CASE WHEN a.h IS NULL THEN 'only dataset' WHEN b.h IS NULL THEN 'only export' WHEN a.h = b.h THEN 'same' ELSE 'differs' END AS outcome, count(*) AS ids FROM (SELECT id, sha256(coalesce(title, '')) AS h FROM {CURATED} WHERE id IS NOT NULL) a FULL JOIN (SELECT id, sha256(coalesce(title, '')) AS h FROM {S.DATASET}) b USING (id) GROUP BY 1")
def compare_sides(spark, sf_dir):
    h = F.sha2(F.coalesce("title", F.lit("")), 256)
    a = curated(spark, sf_dir).where("id is not null").select("id", h.alias("a"))
    b = dataset(spark, sf_dir, b=h)
    outcome = F.when(F.col("a").isNull(), "only dataset").when(F.col("b").isNull(), "only export").when(F.col("a") == F.col("b"), "same").otherwise("differs")
    return a.join(b, "id", "full_outer").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("ids"))


@query("updated_subjects", f"SELECT id, coalesce(l.subject, d.subject) AS subject FROM {S.DATASET} d LEFT JOIN (SELECT DISTINCT id, subject FROM subject_labels QUALIFY row_number() OVER (PARTITION BY id ORDER BY label_year DESC NULLS LAST, subject) = 1) l USING (id)")
def updated_subjects(spark, sf_dir):
    return C.update_by_key(dataset(spark, sf_dir, "subject").select("id", "subject"), subject_label_table(spark, sf_dir).select("id", "subject"), "id")


@query("keywords_once", f"SELECT id, list_filter(k, lambda v, i: list_position(list_transform(k, lambda x: lower(trim(x))), lower(trim(v))) = i) AS keywords FROM (SELECT id, list_filter(keywords.real, lambda v: v IS NOT NULL) AS k FROM {S.DATASET} WHERE len(keywords.real) > 0)")
def keywords_once(spark, sf_dir):
    df = dataset(spark, sf_dir, "keywords").where("size(keywords.real) > 0")
    return df.select("id", C.distinct_ignoring_case(F.col("keywords.real")).alias("keywords"))


@query("values_lost", f"SELECT DISTINCT subject FROM (SELECT subject FROM dataset EXCEPT SELECT subject FROM {CURATED})")
def values_lost(spark, sf_dir):
    return read_table(spark, sf_dir, "dataset", ["subject"]).subtract(curated(spark, sf_dir).select("subject"))


@query("shared_ids", f"SELECT id FROM dataset INTERSECT SELECT id FROM {CURATED}")
def shared_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "dataset", ["id"]).intersect(curated(spark, sf_dir).select("id"))


@query("all_ids", f"SELECT id FROM dataset UNION SELECT id FROM {CURATED}")
def all_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "dataset", ["id"]).union(curated(spark, sf_dir).select("id")).distinct()


@query("ids_by_type", f"SELECT doc_type, left(md5(id), 3) AS part, list_sort(list(id)) AS ids FROM {S.DATASET} GROUP BY 1, 2")
def ids_by_type(spark, sf_dir):
    """The ids of each type in 4096 parts by their hash, so that no task holds a type's whole list."""
    rows = dataset(spark, sf_dir, "doc_type").withColumn("part", F.substring(F.md5("id"), 1, 3))
    return rows.groupBy("doc_type", "part").agg(F.array_sort(F.collect_list("id")).alias("ids"))


@query("split_by_type", f"PIVOT (SELECT split, doc_type FROM {S.DATASET}) ON doc_type IN ('Tesis', 'Articulo', 'Libro', 'Objeto de conferencia') USING count(*) GROUP BY split")
def split_by_type(spark, sf_dir):
    return dataset(spark, sf_dir, "split", "doc_type").groupBy("split").pivot("doc_type", ["Tesis", "Articulo", "Libro", "Objeto de conferencia"]).count().fillna(0)


_BLANK = "coalesce(lower(trim(publisher)), '') IN ('', 'null', 'none', 'nan', 's/d')"


@query("presence_profile", f"SELECT doc_type, count(*) AS total, count(*) FILTER (NOT {_BLANK}) AS present, count(*) FILTER ({_BLANK}) AS absent, count(DISTINCT publisher) FILTER (NOT {_BLANK}) AS distinct_values FROM {S.DATASET} GROUP BY doc_type")
def presence_profile(spark, sf_dir):
    blank = F.coalesce(F.lower(F.trim("publisher")), F.lit("")).isin("", "null", "none", "nan", "s/d")
    return dataset(spark, sf_dir, "doc_type", "publisher").groupBy("doc_type").agg(F.count("*").alias("total"), F.count_if(~blank).alias("present"), F.count_if(blank).alias("absent"), F.countDistinct(F.when(~blank, F.col("publisher"))).alias("distinct_values"))


@query("null_fields_pruned", f"SELECT sum((abstract IS NULL OR trim(abstract) = '')::INT + (title IS NULL OR trim(title) = '')::INT + (language IS NULL OR trim(language) = '')::INT + (subject IS NULL OR trim(subject) = '')::INT)::BIGINT AS removed FROM {S.DATASET}")
def null_fields_pruned(spark, sf_dir):
    n = sum((T.is_blank(F.col(c)).cast("int") for c in ("abstract", "title", "language", "subject")), F.lit(0))
    return dataset(spark, sf_dir, blank=n).agg(F.sum("blank").alias("removed"))


@query("type_spellings", f"SELECT doc_type, CASE WHEN contains(lower(doc_type), 'tesis') THEN 'Tesis' WHEN contains(lower(doc_type), 'articulo') THEN 'Articulo' WHEN contains(lower(doc_type), 'libro') THEN 'Libro' WHEN contains(lower(doc_type), 'conferencia') THEN 'Conferencia' ELSE 'Other' END AS kind, CASE WHEN doc_type IN ('Artículo', 'Articulo', 'Article', 'ARTÍCULO') THEN 'Articulo' WHEN doc_type IN ('Tesis', 'Tesina') THEN 'Tesis' ELSE doc_type END AS named, upper(doc_type[1:1]) || doc_type[2:] AS shown, count(*) AS n FROM {S.DATASET} GROUP BY 1, 2, 3, 4")
def type_spellings(spark, sf_dir):
    low = F.lower("doc_type")
    kind = F.when(low.contains("tesis"), "Tesis").when(low.contains("articulo"), "Articulo").when(low.contains("libro"), "Libro").when(low.contains("conferencia"), "Conferencia").otherwise("Other")
    shown = F.concat(F.upper(F.substring("doc_type", 1, 1)), F.substring("doc_type", 2, 1000))
    return dataset(spark, sf_dir, "doc_type").groupBy("doc_type", kind.alias("kind"), T.type_name(F.col("doc_type")).alias("named"), shown.alias("shown")).agg(F.count("*").alias("n"))


_PROMPTS = {"General": "extract all", "Tesis": "extract thesis", "Libro": "extract book"}
_ASKED = ["id", "doc_type", "language", "subject", "title", "creator", "date_issued", "issn", "abstract", "rights"]
_FEW, _EVERY = (f"json_object({', '.join(f'{S.q(c)}, {c}' for c in cols)})::VARCHAR" for cols in (("language", "title", "creator", "date_issued", "rights"), ("id", "language", "title", "creator", "date_issued", "issn", "rights")))


def _pairs_sql(unknown: str) -> str:
    typed = f"CASE doc_type WHEN 'Tesis' THEN 'extract thesis' WHEN 'Libro' THEN 'extract book' ELSE '{unknown}' END"
    return f"SELECT id, kind, CASE WHEN kind = 'General' THEN 'extract all' ELSE {typed} END AS prompt, CASE WHEN kind = 'General' THEN {_FEW} ELSE {_EVERY} END AS output FROM {S.DATASET}, (SELECT unnest(['General', 'typed']) AS kind)"


@query("training_pairs", _pairs_sql("extract all"))
def training_pairs(spark, sf_dir):
    return C.training_pairs(dataset(spark, sf_dir, *_ASKED[1:]).select(*_ASKED), "id", "doc_type", _PROMPTS)


@query("training_pairs_book", _pairs_sql("extract book"))
def training_pairs_book(spark, sf_dir):
    """With the book's prompt for a type without one, as the training set has it."""
    return C.training_pairs(dataset(spark, sf_dir, *_ASKED[1:]).select(*_ASKED), "id", "doc_type", _PROMPTS, unknown="Libro")


@query("class_weights", f"SELECT doc_type, round(count(*) OVER_ALL / (4.0 * count(*)), 6) AS weight FROM {S.DATASET} GROUP BY doc_type".replace("count(*) OVER_ALL", "(sum(count(*)) OVER ())::DOUBLE"))
def class_weights(spark, sf_dir):
    from pyspark.sql import Window as W

    counts = dataset(spark, sf_dir, "doc_type").groupBy("doc_type").agg(F.count("*").alias("n"))
    return counts.select("doc_type", F.round(F.sum("n").over(W.partitionBy(F.lit(0))).cast("double") / (4.0 * F.col("n")), 6).alias("weight"))


@query("defaulted_keys", f"SELECT id, coalesce(publisher, '') AS publisher, coalesce(isbn, '') AS isbn, coalesce(degree_name, '') AS degree_name FROM {S.DATASET}")
def defaulted_keys(spark, sf_dir):
    cols = ("publisher", "isbn", "degree_name")
    return dataset(spark, sf_dir, *cols).select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in cols])


@query("latest_deliveries", "SELECT id, max(harvested_at) AS harvested_at, count(*) AS deliveries FROM dataset GROUP BY id HAVING count(*) > 1")
def latest_deliveries(spark, sf_dir):
    return read_table(spark, sf_dir, "dataset", ["id", "harvested_at"]).groupBy("id").agg(F.max("harvested_at").alias("harvested_at"), F.count("*").alias("deliveries")).where("deliveries > 1")


@query("id_paths", "SELECT DISTINCT id, replace(id, '-', '/') AS path FROM dataset")
def id_paths(spark, sf_dir):
    return read_table(spark, sf_dir, "dataset", ["id"]).select("id", F.replace("id", F.lit("-"), F.lit("/")).alias("path")).distinct()


@query("second_values", f"SELECT id, creator[2] AS second FROM {S.DATASET} WHERE creator IS NOT NULL")
def second_values(spark, sf_dir):
    return dataset(spark, sf_dir, "creator").where("creator is not null").select("id", F.try_element_at("creator", F.lit(2)).alias("second"))


@query("flattened_splits", f"SELECT id, split FROM {S.DATASET} WHERE split IN ('training', 'validation', 'test')")
def flattened_splits(spark, sf_dir):
    """The splits as one relation, the last delivery of an id."""
    return dataset(spark, sf_dir, "split").where(F.col("split").isin("training", "validation", "test")).select("id", "split")
