"""Field-level evaluation of predicted metadata against the truth, over pairs in long form.

A pair row holds ``system, id, doc_type, field, pred, pred_is_list, truth, truth_is_list``. A value is present when its
list holds something other than NULL, blanks or "null". Rows may be repeated; callers make them distinct first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.sources import cut

PAIR = ["run_no", "system", "id", "doc_type", "field", "pred", "pred_is_list", "truth", "truth_is_list"]


def keys(values: Column) -> Column:
    """The comparison keys of a value list, present values only."""
    kept = F.filter(values, lambda v: v.isNotNull() & ~F.lower(F.trim(v)).isin("", "null"))
    return F.transform(kept, T.metric_key)


def with_match(pairs: DataFrame) -> DataFrame:
    """Adds ``has_pred, has_truth, match``: equal key lists in order, or both absent; one absent is no match."""
    p, t = T.present(F.col("pred")), T.present(F.col("truth"))
    match = F.when(p & t, keys(F.col("pred")) == keys(F.col("truth"))).otherwise(~p & ~t)
    return pairs.withColumn("has_pred", p).withColumn("has_truth", t).withColumn("match", match)


def accuracy(pairs: DataFrame, *by: str) -> DataFrame:
    """Total, matches, accuracy and how absences meet: both absent, truth only, prediction only."""
    p, t = F.col("has_pred"), F.col("has_truth")
    n = F.count_if("match")
    return with_match(pairs).groupBy(*by).agg(
        F.count("*").alias("total"), n.alias("matches"), F.round(n / F.count("*"), 6).alias("accuracy"),
        F.count_if(~p & ~t).alias("both_absent"), F.count_if(~p & t).alias("pred_absent"), F.count_if(p & ~t).alias("truth_absent"),
    )


def scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1 from counts; all are 1 where there is nothing to score."""
    none = (tp + fp + fn) == 0
    precision = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0)))
    recall = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0)))
    f1 = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)))
    return {"precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": F.round(f1, 6)}


def f1(pairs: DataFrame, *by: str) -> DataFrame:
    """TP: both present and equal; FN: truth present, prediction absent; FP: prediction present and wrong (not also FN)."""
    p, t, m = F.col("has_pred"), F.col("has_truth"), F.col("match")
    counted = with_match(pairs).groupBy(*by).agg(F.count_if(p & t & m).alias("tp"), F.count_if(p & ~(t & m)).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return counted.select(*by, "tp", "fp", "fn", *[c.alias(k) for k, c in scores(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two lists as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def name_jaccard(a: Column, b: Column) -> Column:
    """Matched names over all names, each used once; names are equal when their word sets are.

    Equality of word sets is transitive, so the greedy one-to-one match equals the sum over keys of the lesser count.
    """
    ka = F.transform(a, lambda v: F.array_join(T.name_key(v), " "))
    kb = F.transform(b, lambda v: F.array_join(T.name_key(v), " "))
    count = lambda values, k: F.size(F.filter(values, lambda v: v == k))
    matched = F.aggregate(F.array_distinct(ka), F.lit(0), lambda acc, k: acc + F.least(count(ka, k), count(kb, k)))
    total = F.size(ka) + F.size(kb) - matched
    return F.when(total == 0, 1.0).otherwise(matched.cast("double") / total)


def list_match(pairs: DataFrame, *by: str) -> DataFrame:
    """Mean Jaccard, perfect matches and mean numbers of matching, missing and extra elements."""
    a, b = F.array_distinct(keys(F.coalesce("pred", F.array().cast("array<string>")))), F.array_distinct(keys(F.coalesce("truth", F.array().cast("array<string>"))))
    rows = pairs.select(*by, a.alias("a"), b.alias("b"))
    j = jaccard(F.col("a"), F.col("b"))
    return rows.groupBy(*by).agg(
        F.round(F.avg(j), 6).alias("jaccard"), F.count_if(j == 1.0).alias("perfect"), F.sum(F.size(F.array_intersect("a", "b"))).alias("matching"),
        F.sum(F.size(F.array_except("b", "a"))).alias("missing"), F.sum(F.size(F.array_except("a", "b"))).alias("extra"),
    )


def null_statistics(pairs: DataFrame, *by: str) -> DataFrame:
    """How often prediction and truth are empty, as the report counts it ("null" is a value), in number and share."""
    p, t = F.count_if(T.is_empty(F.col("pred"), F.col("pred_is_list"))), F.count_if(T.is_empty(F.col("truth"), F.col("truth_is_list")))
    n = F.count("*")
    return pairs.groupBy(*by).agg(n.alias("total"), p.alias("pred_null"), t.alias("truth_null"), F.round(p / n, 6).alias("pred_null_share"), F.round(t / n, 6).alias("truth_null_share"))


def simple_match(pred: str = "pred", truth: str = "truth") -> Column:
    """Whether two values are equal in lower case without accents: lists in any order, single values as they are, never one of each kind."""
    flat = lambda c: F.array_sort(F.transform(c, lambda v: T.strip_accents(F.trim(F.lower(F.coalesce(v, F.lit("None")))))))
    return F.coalesce((F.col(f"{pred}_is_list") == F.col(f"{truth}_is_list")) & (flat(F.col(pred)) == flat(F.col(truth))), F.lit(False))


def breakdown(pairs: DataFrame, system: str = "system", field: str = "field", truth_below: float = 0.8, pred_above: float = 0.8) -> DataFrame:
    """Outcomes of fields whose truth is mostly there and whose prediction is mostly empty; invented values are left out."""
    stats = null_statistics(pairs, system, field).where((F.col("truth_null_share") < truth_below) & (F.col("pred_null_share") > pred_above)).select(system, field)
    p, t, m = ~T.is_empty(F.col("pred"), F.col("pred_is_list")), ~T.is_empty(F.col("truth"), F.col("truth_is_list")), simple_match()
    rows = pairs.join(stats, [system, field])
    return rows.groupBy(system, field).agg(F.count_if(~p & ~t).alias("null_match"), F.count_if(~p & t).alias("null_mismatch"), F.count_if(p & t & m).alias("ok_match"), F.count_if(p & t & ~m).alias("wrong"))


def metric_rows(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """``system, [by,] field, metric, value``: accuracy and F1 of every field and of all together ("(all)": records right in
    every field, F1 over all pairs), and the mean list match of fields whose truth is a list. One pass over the pairs."""
    none = F.array().cast("array<string>")
    a, b = (F.array_distinct(keys(F.coalesce(c, none))) for c in ("pred", "truth"))
    rows = with_match(pairs).select("system", "run_no", "id", *([by] if by else []), "field", "match", "has_pred", "has_truth", "truth_is_list", jaccard(a, b).alias("j"))
    group = ["system", *([by] if by else [])]
    p, t, m = F.col("has_pred"), F.col("has_truth"), F.col("match")
    counts = [F.count("*").alias("n"), F.count_if(m).alias("right"), F.count_if(p & t & m).alias("tp"), F.count_if(p & ~(t & m)).alias("fp"), F.count_if(t & ~p).alias("fn"), F.avg("j").alias("list"), F.bool_or("truth_is_list").alias("lists")]
    fields = cut(rows.groupBy(*group, "field").agg(*counts))
    whole = rows.groupBy(*group, "run_no", "id").agg(F.bool_and("match").alias("ok")).groupBy(*group).agg(F.round(F.count_if("ok") / F.count("*"), 6).alias("value"))
    f = lambda x: scores(F.col("tp"), F.col("fp"), F.col("fn"))["f1"].alias("value")
    sums = fields.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    parts = [
        fields.select(*group, "field", F.lit("accuracy").alias("metric"), F.round(F.col("right") / F.col("n"), 6).alias("value")), whole.select(*group, F.lit("(all)").alias("field"), F.lit("accuracy").alias("metric"), "value"),
        fields.select(*group, "field", F.lit("f1").alias("metric"), f(fields)), sums.select(*group, F.lit("(all)").alias("field"), F.lit("f1").alias("metric"), f(sums)),
        fields.where("lists").select(*group, "field", F.lit("list").alias("metric"), F.round("list", 6).alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def winners(scored: DataFrame, metric: str, order: list[str], system: str = "system", *by: str) -> DataFrame:
    """The best system per group; NULL scores do not count, the system listed first wins ties."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(system))
    best = F.max_by(F.col(system), F.struct(F.col(metric).alias("m"), (-rank).alias("r")))
    return scored.where(F.col(metric).isNotNull()).groupBy(*by).agg(best.alias("winner"), F.max(metric).alias("best"))


def classification_report(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy and unweighted macro precision, recall and F1 over all labels of either side; 0 where a label has none."""
    counts = rows.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    per = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("given").alias("given"))
    p, r = F.coalesce(F.try_divide(F.col("tp").cast("double"), "given"), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp").cast("double"), "support"), F.lit(0.0))
    f = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("given") + F.col("support")), F.lit(0.0))
    return per.agg(F.round(F.sum("tp").cast("double") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg(p), 6).alias("macro_precision"), F.round(F.avg(r), 6).alias("macro_recall"), F.round(F.avg(f), 6).alias("macro_f1"))


def confusion_percent(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per cell of the confusion matrix the percentage of its true label, rounded half to even and at most 99."""
    counts = rows.groupBy(F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("y_true"))
    return counts.select("y_true", "y_pred", "n", F.least(F.lit(99), F.bround(share).cast("int")).alias("percent"))
