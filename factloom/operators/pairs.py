"""What can be said about a pair without a judge: analysis, priority, budget, routing, batches (PA1 to PA11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.config import DEFAULT, Config

# Factors that betray a scale mismatch, in order of precedence, and their labels.
SCALE_FACTORS = (
    (10.0, "10x"),
    (100.0, "100x (percent vs fraction, or lakh vs crore step)"),
    (1000.0, "1,000x (thousand)"),
    (1e5, "100,000x (lakh)"),
    (1e6, "1,000,000x (million)"),
    (1e7, "10,000,000x (crore)"),
    (1e9, "1,000,000,000x (billion)"),
)
_MEASURES = ("currency", "ratio", "count", "quantity", "rate_delta")


def fiscal_close(key: Column, fy_start: int = DEFAULT.fiscal_start_month) -> Column:
    """The instant key on which the fiscal year of an FY key closes, or null."""
    year = F.regexp_extract(key, r"^FY(\d{4})$", 1).try_cast("int")
    first = F.make_date(year if fy_start > 1 else year + 1, F.lit(fy_start), F.lit(1))
    return F.concat(F.lit("@"), F.date_sub(first, 1).cast("string"))


def compare_periods(a: Column, b: Column) -> Column:
    """same, aligned (an instant on the other's fiscal close), different, one_missing or both_missing (PA3)."""
    a, b = F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
    aligned = F.coalesce(a == fiscal_close(b), F.lit(False)) | F.coalesce(b == fiscal_close(a), F.lit(False))
    return F.when(a.isNull() & b.isNull(), "both_missing").when(a.isNull() | b.isNull(), "one_missing").when(a == b, "same").when(aligned, "aligned").otherwise("different")


def _scope(q: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(q, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def analyse(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add numeric, relative_difference, scale_factor, period, basis, scope_overlap, differing_qualifiers and skip."""
    x, y = F.col("a.value_num"), F.col("b.value_num")
    biggest, least = F.greatest(F.abs(x), F.abs(y)), F.least(F.abs(x), F.abs(y))
    comparable = x.isNotNull() & y.isNotNull() & F.col("a.value_unit").eqNullSafe(F.col("b.value_unit"))
    rel = F.when(comparable, F.when(biggest == 0, F.lit(0.0)).otherwise(F.abs(x - y) / biggest))
    df = pairs.withColumn("relative_difference", rel)
    r = F.col("relative_difference")
    numeric = F.when(x.isNull() | y.isNull(), "non_numeric").when(~comparable, "unit_mismatch").when(r <= config.tolerance, "equal").when(r <= config.close, "close").otherwise("different")
    df = df.withColumns({
        "numeric": numeric,
        "period": compare_periods(F.col("a.period_key"), F.col("b.period_key")),
        "basis": F.when(F.coalesce(F.nullif("a.period_basis", F.lit("")), F.lit("unknown")) == F.coalesce(F.nullif("b.period_basis", F.lit("")), F.lit("unknown")), "same").otherwise("different"),
        "_qa": _scope(F.col("a.qualifiers")), "_qb": _scope(F.col("b.qualifiers")),
    })
    ratio = biggest / least
    near = [F.when(F.abs(ratio - f) <= 0.02 * F.greatest(ratio, F.lit(f)), F.lit(label)) for f, label in SCALE_FACTORS]
    apart = F.array_union(F.array_except("_qa", "_qb"), F.array_except("_qb", "_qa"))
    da, db = F.col("a.value_dim"), F.col("b.value_dim")
    df = df.withColumns({
        "scale_factor": F.when((F.col("numeric") == "different") & (least > 0), F.coalesce(*near)),
        "scope_overlap": F.when((F.size("_qa") == 0) & (F.size("_qb") == 0), "unknown").when(F.size(apart) == 0, "same").otherwise("differing"),
        "differing_qualifiers": F.slice(F.array_sort(apart), 1, 8),
        "skip": F.when(da.isin(*_MEASURES) & db.isin(*_MEASURES) & (da != db), F.concat(F.lit("incomparable value dimensions ("), da, F.lit(" vs "), db, F.lit(")"))),
    })
    return df.drop("_qa", "_qb")


def with_priority(df: DataFrame) -> DataFrame:
    """Add `priority`: how likely the pair's verdict is worth reading (PA7)."""
    points = lambda cond, n: F.when(cond, F.lit(float(n))).otherwise(0.0)
    n, at_one = F.col("numeric"), F.col("period").isin("same", "aligned")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    printed = F.lower(F.trim(text("a.value_raw"))) != F.lower(F.trim(text("b.value_raw")))
    unit = text("a.unit_raw") != text("b.unit_raw")
    key = (text("a.metric_key") != "") & (F.col("a.metric_key") == F.col("b.metric_key"))
    return df.withColumn(
        "priority",
        F.col("similarity") + points(key, 3)
        + F.when(n == "different", F.when(at_one, 3.5).otherwise(1.5)).when(n == "close", F.when(at_one, 3.0).otherwise(1.0)).when(n == "equal", F.lit(1.5) + points(printed, 1) + points(unit, 1)).when(n == "unit_mismatch", 1.0).otherwise(0.0)
        + points(F.col("scale_factor").isNotNull(), 2) + points(F.col("period") == "different", 1) + points(F.col("basis") == "different", 1)
        + F.when(F.col("scope_overlap") == "differing", 0.75).otherwise(0.0) + points(F.col("a.doc_id") != F.col("b.doc_id"), 1.5)
        - points((text("a.verification") == "unverified") | (text("b.verification") == "unverified"), 2),
    )


def within_budget(df: DataFrame, budget: int = DEFAULT.pair_budget) -> DataFrame:
    """The pairs to judge: not rejected, best first, at most `budget` (0: all) (PA6, PA8). Ties go by ids."""
    kept = df.where("skip IS NULL")
    order = [F.desc("priority"), F.col("a.fact_id"), F.col("b.fact_id")]
    return kept.orderBy(*order).limit(budget) if budget else kept


def over_budget_issue(df: DataFrame, budget: int = DEFAULT.pair_budget) -> DataFrame:
    """One info row with how many pairs the budget left out, if any (PA9)."""
    n = df.where("skip IS NULL").agg(F.count("*").alias("n"))
    left = F.col("n") - budget
    return n.where((F.lit(budget) > 0) & (left > 0)).select(F.lit("pairs_over_budget").alias("kind"), F.lit("info").alias("severity"), F.concat(left.cast("string"), F.lit(" pairs over the budget of "), F.lit(str(budget))).alias("detail"), left.alias("dropped"))


def needs_escalation() -> Column:
    """Whether a pair goes to the stronger judge (PA10)."""
    return F.col("numeric").isin("different", "close") & (F.col("period").isin("same", "aligned") | F.col("scale_factor").isNotNull())


def batched(df: DataFrame, size: int = DEFAULT.batch) -> DataFrame:
    """Add `escalated` and `batch`, numbered by priority within each route (PA11). For budgeted pairs: a route is one window."""
    route = W.partitionBy("escalated").orderBy(F.desc("priority"), "a.fact_id", "b.fact_id")
    return df.withColumn("escalated", needs_escalation()).withColumn("batch", F.floor((F.row_number().over(route) - 1) / size).cast("int"))
