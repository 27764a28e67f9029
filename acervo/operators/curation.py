"""Curation of wide repository tables: families of columns, filters, keep-first deduplication, balanced picks and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def family(df: DataFrame, key: str) -> list[str]:
    """The columns whose name contains ``key``, in table order."""
    return [c for c in df.columns if key in c]


def coalesce_family(df: DataFrame, key: str, out: str) -> DataFrame:
    """One column from a family: its first non-NULL member from left to right; the members are dropped."""
    members = family(df, key)
    value = F.coalesce(*members) if members else F.lit(None).cast("string")
    return df.withColumn("_family", value).drop(*members).withColumnRenamed("_family", out)


def combine_family(df: DataFrame, key: str) -> Column:
    """All non-NULL members of a family as a list."""
    return F.array_compact(F.array(*family(df, key)))


def completeness(df: DataFrame, *columns: str) -> Column:
    """How many of the columns (all by default) are not NULL in a row."""
    out = F.lit(0)
    for c in columns or df.columns:
        out = out + F.col(c).isNotNull().cast("int")
    return out


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``; give a total order for a repeatable result."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """At most ``k`` rows per group in ``order``; the planner limits groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def hash_order(key: str, seed: int) -> Column:
    """A repeatable shuffle of keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def ranked(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Adds ``_i`` and ``_all``: a row's place from 1 in the repeatable shuffle of its label, and the rows of the label.

    Hashes are counted by their first three digits, so a label is ranked in 4096 parts and no task sorts a whole label.
    """
    rows = df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy(F.col(label).alias("_label"), F.col("_b").alias("_part")).agg(F.count("*").alias("_n"))
    of = W.partitionBy("_label")
    before = counts.withColumn("_before", F.sum("_n").over(of.orderBy("_part")) - F.col("_n")).withColumn("_all", F.sum("_n").over(of)).drop("_n")
    placed = rows.withColumn("_place", F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key)))
    joined = placed.join(before, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_part")))
    return joined.select(*[F.col(c) for c in df.columns], (F.col("_before") + F.col("_place")).alias("_i"), "_all")


def capped_sample(df: DataFrame, label: str, key: str, least: int, most: int, seed: int = 42) -> DataFrame:
    """Labels with ``least`` rows or more, ``most`` rows of each by a repeatable shuffle. NULL is no label."""
    enough = df.groupBy(label).agg(F.count("*").alias("_all")).where(F.col("_all") >= least).select(label)
    return top_per_group(df.join(enough, label, "left_semi"), label, most, hash_order(key, seed), F.col(key))


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42, train: float = 0.8, test: float = 0.1) -> DataFrame:
    """Adds ``split``: per label the first floor(n * train) of a repeatable shuffle train, the next floor(n * test) test, the rest validation."""
    i, a, b = F.col("_i"), F.floor(F.col("_all") * train), F.floor(F.col("_all") * test)
    return ranked(df, label, key, seed).withColumn("split", F.when(i <= a, "training").when(i <= a + b, "test").otherwise("validation")).drop("_i", "_all")


def quota(have: DataFrame, pool: DataFrame, label: str, key: str, target: int, least: int = 0) -> DataFrame:
    """Rows of ``pool`` not yet in ``have`` that fill each label up to ``target``, least keys first; labels of which the
    pool holds fewer than ``least`` rows are skipped."""
    plan = quota_plan(have, pool, label, key, target, least).where("need > 0").select(label, "need")
    missing = top_per_group(pool.join(have.select(key), key, "left_anti"), label, target, F.col(key))
    placed = missing.withColumn("_n", F.row_number().over(W.partitionBy(label).orderBy(key)))
    return placed.join(plan, label).where(F.col("_n") <= F.col("need")).drop("_n", "need")


def quota_plan(have: DataFrame, pool: DataFrame, label: str, key: str, target: int, least: int = 0) -> DataFrame:
    """``label, have, available, need, short`` per label of ``pool``: what there is, what is taken up to ``target``, and what stays missing."""
    held = have.groupBy(label).agg(F.count("*").alias("have"))
    free = pool.join(have.select(key), key, "left_anti").groupBy(label).agg(F.count("*").alias("free"))
    every = pool.groupBy(label).agg(F.count("*").alias("_all")).join(held, label, "left").join(free, label, "left").na.fill(0, ["have", "free"])
    need = F.when(F.col("_all") < least, F.lit(0)).otherwise(F.greatest(F.lit(0), target - F.col("have"))).cast("long")
    return every.select(label, "have", F.col("free").alias("available"), need.alias("need"), F.greatest(F.lit(0), need - F.col("free")).cast("long").alias("short"))


def renamed_keys(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by their names in ``names`` where they have one there; dots count as underscores and case as nothing."""
    flat = {k.replace(".", "_").lower(): v.replace(".", "_").lower() for k, v in names.items()}
    return df.withColumnsRenamed({c: flat[c.lower()] for c in df.columns if c.lower() in flat})


def without_keys(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The columns that are not in ``names`` (compared as in :func:`renamed_keys`, the whole name or what follows its last dot)."""
    flat = {n.lower().replace(".", "_") for n in names} | {n.lower().rsplit(".", 1)[-1] for n in names if n.count(".") > 1 or n.startswith("sedici.inst")}
    return df.select(*[c for c in df.columns if c.lower() not in flat])


def aligned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns ``columns`` names, in its order, as out -> from; one that is missing is NULL (STRING)."""
    return df.select(*[(F.col(f"`{source}`") if source in df.columns else F.lit(None).cast("string")).alias(out) for out, source in columns.items()])


def distinct_ignoring_case(values: Column) -> Column:
    """A list without NULLs and without elements equal to an earlier one after trimming and lower case; the first spelling stays."""
    values = F.array_compact(values)
    folded = F.transform(values, lambda v: F.lower(F.trim(v)))
    return F.filter(F.zip_with(values, F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1))), lambda v, i: F.when(F.array_position(folded, F.lower(F.trim(v))) == i, v)), lambda v: v.isNotNull())


def update_by_key(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns that ``changes`` has take its values where a key matches (NULL too); other rows and columns stay."""
    shared = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in shared])
    joined = df.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in df.columns])


#: The fields that the general prompt asks for, and those that no prompt does.
GENERAL_FIELDS = ("language", "title", "subtitle", "creator", "rights", "rightsurl", "date_issued", "originplaceinfo")
UNASKED_FIELDS = ("doc_type", "type", "dc_type", "original_text", "keywords", "dc_uri", "sedici_uri", "abstract", "subject", "isrelatedwith")


def training_pairs(df: DataFrame, key: str, doc_type: str, prompts: dict[str, str], unknown: str = "General") -> DataFrame:
    """``key, kind, prompt, output``, two rows per record: the general prompt with the general fields, and that of its type
    (that of ``unknown`` for a type without one) with all fields but those unasked, as JSON with NULLs kept."""
    general = F.lit(prompts["General"])
    typed = F.coalesce(F.create_map(*[F.lit(x) for kv in prompts.items() for x in kv])[F.col(doc_type)], F.lit(prompts[unknown]))
    output = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("{}")
    few = [c for c in df.columns if c.lower() in GENERAL_FIELDS]
    every = [c for c in df.columns if c.lower() not in UNASKED_FIELDS]
    two = F.array(
        F.struct(F.lit("General").alias("kind"), general.alias("prompt"), output(few).alias("output")), F.struct(F.lit("typed").alias("kind"), typed.alias("prompt"), output(every).alias("output"))
    )
    return df.select(F.col(key), F.explode(two).alias("x")).select(key, "x.kind", "x.prompt", "x.output")
