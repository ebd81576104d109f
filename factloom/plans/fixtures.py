"""A fact store derived from the orders table: every order states its value two or three times, in different notations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.identity import basis, canonical_claim, metric_key
from factloom.functions.periods import with_periods
from factloom.functions.values import with_values
from factloom.operators import candidates, judge, pairs
from factloom.sources.tables import once


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "o_orderpriority AS pr", "cast(floor(o_totalprice) AS bigint) AS w", "cast(year(o_orderdate) AS bigint) AS y")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw fact an order, in eleven value notations and ten period notations."""
    yy = "lpad(cast(y % 100 AS string), 2, '0')"
    value = f"""CASE k % 11 WHEN 0 THEN format_number(w, 0) WHEN 1 THEN cast(w AS string) WHEN 2 THEN concat(w % 1000, '.5') WHEN 3 THEN concat('(', format_number(w, 0), ')')
      WHEN 4 THEN concat('₹', w % 1000, ' Cr') WHEN 5 THEN concat(w % 100, '.25') WHEN 6 THEN cast(w % 100 AS string) WHEN 7 THEN concat(w % 100, '.3-', w % 100 + 1, '.8')
      WHEN 8 THEN 'AAA/Stable' ELSE cast(w % 100 AS string) END"""
    unit = "CASE k % 11 WHEN 0 THEN 'INR' WHEN 1 THEN 'INR' WHEN 2 THEN 'INR thousand' WHEN 3 THEN 'INR' WHEN 5 THEN 'per cent' WHEN 6 THEN 'bps' WHEN 7 THEN 'per cent' WHEN 9 THEN 'USD million' WHEN 10 THEN 'lakh tonnes' END"
    period = f"""CASE k % 10 WHEN 0 THEN concat('FY', {yy}) WHEN 1 THEN concat('Q3 FY', {yy}) WHEN 2 THEN concat('March 31, ', y) WHEN 3 THEN concat('for the year ended March 31, ', y)
      WHEN 4 THEN concat(y, '-', lpad(cast((y + 1) % 100 AS string), 2, '0')) WHEN 5 THEN concat('Dec-', {yy}) WHEN 6 THEN concat('CY', y) WHEN 7 THEN concat('as at March ', y) WHEN 8 THEN concat('nine months ended December 31, ', y) END"""
    return orders(spark, sf_dir).selectExpr(
        "k", "w", "y", "concat('f_', k) AS fact_id", "concat('d_', k % 6) AS doc_id", "concat('Account C', c) AS subject",
        f"CASE k % 3 WHEN 0 THEN 'order value' WHEN 1 THEN 'the order values' ELSE concat('FY', {yy}, ' order value') END AS predicate",
        f"{value} AS value_raw", f"{unit} AS unit_raw", f"{period} AS time_scope_raw",
        "CASE WHEN pr LIKE '4-%' THEN cast(array() AS array<string>) ELSE array(lower(pr)) END AS qualifiers",
        "concat('the value ', CASE k % 7 WHEN 1 THEN 'is projected' WHEN 2 THEN 'is estimated' WHEN 3 THEN 'follows guidance' ELSE 'was booked' END) AS quote",
    )


def restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw facts: A states the order's value, B restates it in another document, C (every fiftieth) disagrees in A's own."""
    o = orders(spark, sf_dir)
    yy = lambda y: f"lpad(cast(({y}) % 100 AS string), 2, '0')"
    b_year = "(y - CASE WHEN k % 8 = 4 THEN 1 ELSE 0 END)"
    sides = {
        "f_": ("k % 6", "format_number(w, 0)", "'INR'", f"concat('FY', {yy('y')})", "'consolidated'", "''", "true"),
        "g_": (
            "(k + 1 + (k div 6) % 5) % 6",
            "CASE k % 8 WHEN 0 THEN concat(w div 1000, '.', lpad(cast(w % 1000 AS string), 3, '0')) WHEN 1 THEN cast(w * 103 div 100 AS string) WHEN 3 THEN cast(w * 1000 AS string) WHEN 4 THEN cast(w AS string) WHEN 5 THEN cast(w AS string) ELSE cast(w * 6 div 5 AS string) END",
            "CASE k % 8 WHEN 0 THEN 'INR thousand' WHEN 5 THEN 'USD' ELSE 'INR' END",
            f"CASE k % 3 WHEN 0 THEN concat({b_year} - 1, '-', {yy(b_year)}) WHEN 1 THEN concat('for the year ended March 31, ', {b_year}) ELSE concat('March 31, ', {b_year}) END",
            "CASE WHEN k % 8 = 6 THEN 'standalone' ELSE 'consolidated' END", "CASE WHEN k % 8 = 7 THEN ' is projected' ELSE '' END", "true",
        ),
        "h_": ("k % 6", "cast(w * 11 div 10 AS string)", "'INR'", f"concat('FY', {yy('y')})", "'consolidated'", "''", "k % 50 = 0"),
    }
    out = None
    for prefix, (doc, value, unit, period, scope, cue, where) in sides.items():
        side = o.where(where).selectExpr(
            "k", f"concat('{prefix}', k) AS fact_id", f"concat('d_', {doc}) AS doc_id", "concat('Account C', c) AS subject", "concat('order O', k, ' value') AS predicate",
            f"{value} AS value_raw", f"{unit} AS unit_raw", f"{period} AS time_scope_raw", f"array({scope}) AS qualifiers",
            f"concat('Account C', c, ' order O', k, ' value ', {value}, {cue}) AS quote", "cast(k % 40 + 1 AS int) AS page_index",
            "CASE WHEN k % 71 = 0 THEN 'relocated' ELSE 'verified' END AS verification", "(50 + k % 50) / 100D AS confidence",
        )
        out = side if out is None else out.unionByName(side)
    return out


def normalised(raw: DataFrame) -> DataFrame:
    """Raw facts with their comparison keys."""
    df = with_periods(with_values(raw))
    return df.withColumns({
        "period_basis": basis(F.lit("actual"), F.col("quote"), F.col("predicate"), F.col("time_scope_raw")),
        "metric_key": metric_key(F.col("subject"), F.col("predicate")),
        "claim_text": canonical_claim(F.col("subject"), F.col("predicate"), F.col("qualifiers")),
    })


_KEPT = ("k", "fact_id", "doc_id", "subject", "predicate", "value_raw", "unit_raw", "qualifiers", "quote", "page_index", "verification", "confidence", "value_num", "value_unit", "value_dim", "period_key", "period_basis", "metric_key")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored facts; normalised once."""
    return once(spark, "facts", f"{sf_dir}/orders.parquet", lambda: normalised(restated(spark, sf_dir)).select(*_KEPT))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.same_key_pairs(facts(spark, sf_dir))


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysed candidate pairs; eight queries read them, so they are stored."""
    return once(spark, "pairs", f"{sf_dir}/orders.parquet", lambda: pairs.with_priority(pairs.analyse(candidate_pairs(spark, sf_dir))))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.validated(judge.rule_judge(analysed(spark, sf_dir)))


def _unruled(df: DataFrame) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(r) for r in judge.RELATIONS]), (F.floor(F.col("a.k") / 8) % 4 + 1).cast("int"))
    df = df.withColumns({"relation": label, "dimension": F.lit("none"), "raw_confidence": (F.col("a.k") % 60 + 40) / 100, "decided_by": F.lit("llm"), "reasoning": F.lit("model"), "reconciliation": F.lit(None).cast("string")})
    return judge.validated(df)


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts no rule gave, which validation must catch."""
    return _unruled(analysed(spark, sf_dir))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored relations; judged once, as a judge must be.

    They need no priority and few of the facts' columns, so they are made from the pairs as these are found, not from the stored table of pairs.
    """
    return once(spark, "relations", f"{sf_dir}/orders.parquet", lambda: judge.relations(judge.validated(judge.rule_judge(pairs.analyse(candidate_pairs(spark, sf_dir))))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six source documents of the facts."""
    return spark.range(6).selectExpr("concat('d_', id) AS doc_id", "concat('report_', id, '.pdf') AS filename", "concat('Report ', id) AS title", "cast(id * 10 + 40 AS int) AS page_count", "timestamp_seconds(1700000000 + id * 3600) AS created_at")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(issue_id, doc_id, kind, severity, created_at): logged from facts and synthetic verdicts; logged once, as a log is, from the pairs as they are found."""

    def made() -> DataFrame:
        f = facts(spark, sf_dir).selectExpr("fact_id", "doc_id", "k")
        at = "timestamp_seconds(1700000000 + k) AS created_at"
        lost = f.where("k % 97 = 0 AND fact_id LIKE 'f%'").selectExpr("concat('i_q_', k) AS issue_id", "doc_id", "'quote_not_found' AS kind", "'warning' AS severity", at)
        moved = f.where("k % 71 = 0 AND fact_id LIKE 'f%'").selectExpr("concat('i_r_', k) AS issue_id", "doc_id", "'quote_relocated' AS kind", "'info' AS severity", at)
        odd = _unruled(pairs.analyse(candidate_pairs(spark, sf_dir))).where("size(problems) > 0").selectExpr("concat('i_j_', a.fact_id, b.fact_id) AS issue_id", "a.doc_id AS doc_id", "'judgment_inconsistent' AS kind", "'warning' AS severity", "timestamp_seconds(1700000000 + a.k) AS created_at")
        return lost.unionByName(moved).unionByName(odd)

    return once(spark, "issues", f"{sf_dir}/orders.parquet", made)
