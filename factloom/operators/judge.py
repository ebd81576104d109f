"""Verdicts: payloads, a rule judge, whitelisting, validation and flagging (JD1 to JD6)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import DEFAULT
from factloom.functions import jsonio
from factloom.operators.pairs import needs_escalation

RELATIONS = ("corroborates", "contradicts", "reconcilable_context", "unrelated")
DIMENSIONS = ("time", "unit", "scope", "basis", "none")


def payload() -> Column:
    """What a judge is shown of an analysed pair, as JSON (JD1)."""
    side = lambda s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ("subject", "predicate", "value_raw", "unit_raw", "period_key", "qualifiers", "quote")])
    hint = F.struct("numeric", F.bround("relative_difference", 4).alias("relative_difference"), "scale_factor", "period", "basis", "scope_overlap", "differing_qualifiers")
    return F.to_json(F.struct(F.concat("a.fact_id", F.lit(":"), "b.fact_id").alias("pair_id"), side("a").alias("a"), side("b").alias("b"), F.bround("similarity", 4).alias("similarity"), hint.alias("analysis")))


def rule_judge(df: DataFrame) -> DataFrame:
    """Add relation, dimension, reasoning, reconciliation and raw_confidence by fixed rules, first match first."""
    n, p = F.col("numeric"), F.col("period")
    at_one = p.isin("same", "aligned", "both_missing")
    same_text = F.lower(F.trim("a.value_raw")) == F.lower(F.trim("b.value_raw"))
    big, small = F.greatest(F.abs("a.value_num"), F.abs("b.value_num")), F.least(F.abs("a.value_num"), F.abs("b.value_num"))
    # One value is the other, rounded to some power of ten at which it still has two digits.
    rounded = F.exists(F.array(*[F.lit(float(10**k)) for k in range(0, 12)]), lambda t: (big >= 10 * t) & ((F.bround(small / t) * t == big) | (F.bround(big / t) * t == small)))
    rules = [
        (F.col("skip").isNotNull(), "unrelated", "none", 0.9),
        ((n == "non_numeric") & same_text & at_one, "corroborates", "none", 0.8),
        ((n == "non_numeric") & (p == "different"), "reconcilable_context", "time", 0.7),
        (n == "non_numeric", "unrelated", "none", 0.6),
        (p == "one_missing", "unrelated", "none", 0.5),
        ((n == "equal") & at_one, "corroborates", "none", 0.9),
        (n == "unit_mismatch", "reconcilable_context", "unit", 0.7),
        (p == "different", "reconcilable_context", "time", 0.8),
        (F.col("basis") == "different", "reconcilable_context", "basis", 0.8),
        (F.col("scale_factor").isNotNull(), "reconcilable_context", "unit", 0.85),
        (F.col("scope_overlap") == "differing", "reconcilable_context", "scope", 0.75),
        ((n == "close") & rounded, "corroborates", "none", 0.7),
        (F.lit(True), "contradicts", "none", 0.8),
    ]
    pick = lambda k: F.coalesce(*[F.when(r[0], F.lit(r[k])) for r in rules])
    df = df.withColumns({"relation": pick(1), "dimension": pick(2), "raw_confidence": pick(3)})
    return df.withColumns({
        "reasoning": F.concat(F.lit("numeric "), n, F.lit(", period "), p, F.lit(", basis "), F.col("basis"), F.lit(", scope "), F.col("scope_overlap")),
        "reconciliation": F.when(F.col("relation") == "reconcilable_context", F.concat(F.lit("The facts differ in "), F.col("dimension"))),
        "decided_by": F.lit("rule"),
    })


def judge_with(df: DataFrame, model: Callable[[list[str], bool], str], size: int = DEFAULT.batch) -> DataFrame:
    """Ask a model about analysed pairs, `size` at a time within each route (JD2). Write the result before use.

    `model` gets the payloads of a batch and whether they are escalated, and returns its answer as text; items are matched by the
    pair_id that the payload states, else by place. A pair without an item keeps nulls. Batches are cut from the rows of a partition by
    route, so no group is gathered; with `batch` given by `pairs.batched`, rows come sorted by it.
    """
    columns = ("relation", "dimension", "reasoning", "reconciliation", "confidence")
    schema = "pair string, " + ", ".join(f"raw_{c} string" for c in columns)

    def asked(rows: list[tuple[str, str]], escalated: bool) -> pd.DataFrame:
        shown = [json.dumps(json.loads(text) | {"pair_id": f"p{k}"}, ensure_ascii=False) for k, (_, text) in enumerate(rows)]
        got = jsonio.answers(model(shown, escalated), [f"p{k}" for k in range(len(rows))])
        out = [(pair, *(None if (v := got.get(f"p{k}", {}).get(c)) is None else str(v) for c in columns)) for k, (pair, _) in enumerate(rows)]
        return pd.DataFrame(out, columns=["pair", *(f"raw_{c}" for c in columns)])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[bool, list[tuple[str, str]]] = {False: [], True: []}
        for frame in frames:
            for pair, text, route in zip(frame["pair"], frame["payload"], frame["escalated"]):
                own = waiting[bool(route)]
                own.append((pair, text))
                if len(own) == size:
                    yield asked(own, bool(route))
                    own.clear()
        for route, own in waiting.items():
            if own:
                yield asked(own, route)

    pair = F.concat("a.fact_id", F.lit(":"), "b.fact_id")
    route = F.col("escalated") if "escalated" in df.columns else needs_escalation()
    rows = df.select(pair.alias("pair"), payload().alias("payload"), route.alias("escalated"), *(["batch"] if "batch" in df.columns else []))
    if "batch" in df.columns:
        rows = rows.repartition("escalated", "batch").sortWithinPartitions("escalated", "batch", "pair")
    verdicts = rows.select("pair", "payload", "escalated").mapInPandas(ask, schema)
    return df.withColumn("pair", pair).join(verdicts, "pair")


def clamp(value: Column, default: float) -> Column:
    """A number in 0 to 1; what is none is `default`."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def whitelist(df: DataFrame) -> DataFrame:
    """From raw_* columns: known relations and dimensions, bounded texts, clamped confidence (JD3)."""
    rel, dim = F.lower(F.trim("raw_relation")), F.lower(F.trim("raw_dimension"))
    reason = F.nullif(F.trim("raw_reasoning"), F.lit(""))
    return df.withColumns({
        "relation": F.when(rel.isin(*RELATIONS), rel).otherwise("unrelated"),
        "dimension": F.when(dim.isin(*DIMENSIONS), dim).otherwise("none"),
        "reasoning": F.coalesce(F.substring(reason, 1, 2000), F.lit("no reasoning given")),
        "reconciliation": F.substring(F.nullif(F.trim("raw_reconciliation"), F.lit("")), 1, 1000),
        "raw_confidence": clamp(F.col("raw_confidence"), 0.5),
        "decided_by": F.lit("llm"),
    })


def problems() -> Column:
    """Why a verdict contradicts the arithmetic; empty if it does not (JD4)."""
    cor, con = F.col("relation") == "corroborates", F.col("relation") == "contradicts"
    n, p = F.col("numeric"), F.col("period")
    percent = F.format_string("%.1f", F.coalesce("relative_difference", F.lit(0.0)) * 100)
    return F.array_compact(F.array(
        F.when(cor & (p == "different"), F.lit("corroborates, but the normalised periods differ")),
        F.when(cor & (n == "different"), F.concat(F.lit("corroborates, but the values differ by "), percent, F.lit("%"))),
        F.when(con & (p == "different"), F.lit("contradicts, but the periods differ, so both can be true")),
        F.when(con & (n == "equal"), F.lit("contradicts, but the normalised values agree")),
        F.when(con & (n == "unit_mismatch"), F.lit("contradicts, but the units differ")),
        F.when(con & (F.col("basis") == "different"), F.lit("contradicts, but the bases differ")),
    ))


def validated(df: DataFrame) -> DataFrame:
    """Add problems, confidence (halved when there are any), decided_by flagged, and cross_doc (JD5, JD6)."""
    df = df.withColumn("problems", problems())
    bad = F.size("problems") > 0
    return df.withColumns({
        "confidence": F.when(bad, F.bround(F.col("raw_confidence") * 0.5, 3)).otherwise(F.bround("raw_confidence", 3)),
        "decided_by": F.when(bad, F.concat("decided_by", F.lit("-flagged"))).otherwise(F.col("decided_by")),
        "cross_doc": F.col("a.doc_id") != F.col("b.doc_id"),
    })


def relations(df: DataFrame) -> DataFrame:
    """Verdicts as rows of the relations table; the pair is stored with the lesser id first, with its orientation."""
    a, b = F.col("a.fact_id"), F.col("b.fact_id")
    pair = F.sha2(F.concat(F.least(a, b), F.lit(":"), F.greatest(a, b)), 256)
    return df.select(
        F.concat(F.lit("r_"), F.substring(pair, 1, 16)).alias("relation_id"), F.least(a, b).alias("fact_a"), F.greatest(a, b).alias("fact_b"), (a > b).alias("swapped"),
        "cross_doc", "relation", "reasoning", "reconciliation", "dimension", "confidence", "raw_confidence", "similarity", "decided_by",
    )


def inconsistency_issues(df: DataFrame) -> DataFrame:
    """An issue row for every flagged verdict."""
    return df.where(F.size("problems") > 0).select(F.lit("judgment_inconsistent").alias("kind"), F.lit("warning").alias("severity"), F.array_join("problems", "; ").alias("detail"), F.to_json(F.struct(F.col("a.fact_id").alias("a"), F.col("b.fact_id").alias("b"), "relation")).alias("payload"))
