"""Queries of the training-data operators by name, and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.encoding import find_garbled
from acervo.llm.language import declared, label_cases, segments
from acervo.llm.lexicon import trusted_words
from acervo.llm.mixing import Mixture, mix, reached_shares
from acervo.llm.names import link_names, variant_pairs
from acervo.llm.overlap import Overlaps, split_overlaps
from acervo.llm.packing import fill_rates, pack
from acervo.llm.scans import scan_noise
from acervo.llm.subjects import SubjectModel, assign, declared_areas, fit, subject_cases
from acervo.llm.truncation import endings, storage_limits, truncation_rates
from acervo.operators.packed import given_names
from acervo.sources import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_noise(read_table(spark, sf_dir, "dataset", ["id", "original_text"]), "id", "original_text", rebuild=False)
    return found.select("id", F.explode("kinds").alias("kind")).distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise(read_table(spark, sf_dir, "dataset", ["id", "original_text"]), "id", "original_text").distinct()


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(read_table(spark, sf_dir, "dataset", ["id", "original_text", "language"]), "id", "original_text", "language").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_cases(p2_segments(spark, sf_dir)).select("id", "seg_no", "lang").distinct()


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "dataset", ["creator", "director", "codirector"])
    names = df.select(F.explode(F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in df.columns]))).alias("name"))
    return link_names(names, given_names(names))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(p4_entities(spark, sf_dir))


def _subjects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, SubjectModel]:
    materias = read_table(spark, sf_dir, "materias")
    names = sorted(r["subject"] for r in materias.select("subject").distinct().collect())
    df = declared_areas(read_table(spark, sf_dir, "dataset", ["id", "original_text", "subject", "language"]), "subject", materias)
    labelled = df.where(F.col("declared").isNotNull() & (F.col("original_text") != ""))
    model = fit(labelled.select(F.col("declared").alias("area"), declared(F.col("language")).alias("lang"), F.col("original_text").alias("text")), names)
    return assign(df, "id", "original_text", "declared", model), model


def p5_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir)[0].distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_cases(_subjects(spark, sf_dir)[0], "id").select("id", "subject").distinct()


def p5_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_subjects(spark, sf_dir)[1].table(), "topic int, subject string, purity double, terms string")


def p5_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p5_subjects(spark, sf_dir)
    return found.groupBy("subject").agg(F.countDistinct("id").alias("records"), F.round(F.sum("share"), 4).alias("text_share"))


def _overlaps(spark: SparkSession, sf_dir: str) -> Overlaps:
    return split_overlaps(read_table(spark, sf_dir, "dataset", ["id", "original_text", "split"]))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _overlaps(spark, sf_dir).pairs()
    return pairs.select(F.least("id_t", "id_e").alias("id_a"), F.greatest("id_t", "id_e").alias("id_b")).distinct()


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).counts(read_table(spark, sf_dir, "dataset", ["id", "source"]))


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "dataset", ["id", "title", "original_text"])
    trusted = trusted_words(df, "original_text")
    return find_garbled(df, "id", ["title", "original_text"], trusted)


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("id", "field").distinct()


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["budget"]: r["capacity_tokens"] for r in read_table(spark, sf_dir, "pack_budgets").collect()}


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), _capacities(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_rates(p8_pack(spark, sf_dir), _capacities(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return mix(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]), read_table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).selection.drop("weights")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_shares(_mixture(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def _endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endings(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]), read_table(spark, sf_dir, "dataset", ["title"]))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endings(spark, sf_dir).where("truncated").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(_endings(spark, sf_dir))


def p10_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage_limits(read_table(spark, sf_dir, "documents", ["text", "source"]))


QUERIES = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p4_found": p4_found,
    "p4_entities": p4_entities,
    "p5_found": p5_found,
    "p5_subjects": p5_subjects,
    "p5_topics": p5_topics,
    "p5_composition": p5_composition,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p7_found": p7_found,
    "p7_restored": p7_restored,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
    "p10_limits": p10_limits,
}
_N = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))"
_ESCAPED = _N('["\\\\\\n\\r\\t]')
_ASTRAL = _N("[\\x{10000}-\\x{10FFFF}]")
_SIZES = {
    "chars": "length(text)",
    "utf8": "strlen(text)",
    "utf16": f"2 * (length(text) + {_ASTRAL})",
    "html": f"length(text) + 4 * {_N('&')} + 3 * {_N('[<>]')} + 5 * ({_N(chr(34))} + len(string_split(text, chr(39))) - 1)",
    "json": f"length(text) + {_ESCAPED}",
    "json_ascii": f"length(text) + {_ESCAPED} + 5 * {_N('[^\\x00-\\x7F]')} + 6 * {_ASTRAL}",
    "crlf": f"length(text) + {_N('\\n')}",
}
_SIZED = " UNION ALL ".join(f"SELECT source, '{k}' AS measure, ({v})::BIGINT AS size FROM documents WHERE text IS NOT NULL" for k, v in _SIZES.items())
ORACLE_SQL: dict[str, str] = {
    "p10_limits": f"""SELECT * FROM (SELECT *, (sum(texts) OVER (PARTITION BY source, measure ORDER BY size RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) - texts)::DOUBLE / 50 AS around
        FROM (SELECT source, measure, size, count(*) AS texts FROM ({_SIZED}) GROUP BY ALL)) WHERE texts >= 8 AND texts > 8 * (around + sqrt(around)) AND size >= 100""",
}
