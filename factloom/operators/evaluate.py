"""Evaluation and replay: integrity, value in quote, recall, re-normalising, re-validating (Q19 to Q27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.config import DEFAULT
from factloom.functions.identity import slug_tokens
from factloom.operators.judge import validated


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def evidence_integrity(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: facts by verification and the share rejected (Q19)."""
    f = facts.agg(F.count_if(F.col("verification") == "verified").alias("verified"), F.count_if(F.col("verification") == "relocated").alias("relocated"), F.count("*").alias("stored"))
    df = f.crossJoin(issues.agg(F.count_if(F.col("kind") == "quote_not_found").alias("rejected")))  # one row each
    return df.withColumn("rejected_share", F.round(F.col("rejected") / F.nullif(F.col("rejected") + F.col("stored"), F.lit(0)), 4))


def value_in_quote(facts: DataFrame) -> DataFrame:
    """How many facts' quotes hold their value's digits, or the value as printed (Q20)."""
    d = digits(F.col("value_raw"))
    outcome = F.when(d == "", "skipped").when(F.contains(digits(F.col("quote")), d) | F.contains("quote", F.col("value_raw")), "present").otherwise("absent")
    return facts.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def overlap(wanted: Column, have: Column) -> Column:
    """The share of the wanted tokens that the other has."""
    w = F.array_distinct(wanted)
    return F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_intersect(w, have)) / F.size(w))


def token_overlap(wanted: Column, have: Column) -> Column:
    """The share of the wanted text's tokens that the other has (Q22)."""
    return overlap(slug_tokens(wanted), slug_tokens(have))


def _near(x: Column, y: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y)), F.lit(False))


def signed_digits(text: Column) -> Column:
    """A printed figure's digits behind its sign, null where it has none: what two prints of one figure share."""
    d = digits(text)
    return F.when(d != "", F.concat(F.when(text.rlike(r"^\s*[-(]"), "-").otherwise(""), d))


def values_match(wanted: Column, have: Column, wanted_text: Column, have_text: Column, tolerance: float = DEFAULT.tolerance) -> Column:
    """Equal within the tolerance, or the same digits with the same sign (Q23)."""
    return _near(wanted, have, tolerance) | F.coalesce(signed_digits(wanted_text) == signed_digits(have_text), F.lit(False))


#: Values of one bucket differ by less than the tolerance, and values within the tolerance lie at most two buckets apart.
_LOG_STEP = 0.005
_APART = 2
#: Tokens that more than this share of the facts have are common.
_COMMON = 0.001
_METRIC = 2 / 3


def _bucket(value: Column) -> Column:
    """A value's logarithmic bucket; zero has one of its own."""
    return F.when(value == 0, F.lit(-(2**40))).otherwise(F.floor(F.log(F.abs(value)) / _LOG_STEP)).cast("long")


def _neighbours(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(-_APART), F.lit(_APART)), lambda k: _bucket(value) + k)


def metric_hits(labels: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs of a label and a fact of its document whose values match and whose tokens are at least two thirds of the label's, by equi-joins alone.

    So many tokens are shared that of any few tokens of the label (as many as may lack, and one) the fact has one; the label's rarest are
    taken. It is looked up by document, such a token, and value (bucket or digits) at once, so that neither a common value nor a common token
    brings many pairs; every pair is tested. A pair may come several times. Common tokens that no label asks for leave no rows.
    """
    kept = [c for c in ("period_key",) if c in facts.columns]
    own = facts.select("doc_id", "fact_id", "page_index", "value_num", *[F.col(c).alias(f"have_{c}") for c in kept], signed_digits(F.col("value_raw")).alias("have_print"), F.array_distinct(slug_tokens(F.concat_ws(" ", "subject", "predicate"))).alias("have"))
    asked = labels.withColumns({"wanted_tokens": F.array_distinct(slug_tokens(F.col("metric"))), "print": signed_digits(F.col("value_text"))})
    wanted = asked.select(F.explode("wanted_tokens").alias("token")).distinct()
    counts = own.select(F.explode("have").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # How often each wanted token stands in facts; the rarest of a label, of equals the first by name.
    ranked = asked.select("wanted_tokens").distinct().select("*", F.explode("wanted_tokens").alias("token")).join(counts.join(wanted, "token", "left_semi"), "token", "left")
    first = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")))
    lookup = ranked.groupBy("wanted_tokens").agg(first.alias("t")).select("wanted_tokens", F.slice("t", 1, F.size("t") - F.ceil(F.size("t") * _METRIC - 1e-9).cast("int") + 1).alias("t")).select("wanted_tokens", F.transform("t", lambda x: x["token"]).alias("tokens"))
    asked = asked.join(lookup, "wanted_tokens")
    # At most 1 / _COMMON times a fact's tokens are common: a list of some thousands.
    common = counts.crossJoin(F.broadcast(facts.agg((F.count("*") * _COMMON).alias("_most")))).where("n > _most").select("token")
    idle = common.join(asked.select(F.explode("tokens").alias("token")).distinct(), "token", "left_anti")
    near = lambda token, bucket: F.xxhash64(F.lit("near"), token, bucket)
    same = lambda token, digits_: F.xxhash64(F.lit("print"), token, digits_)
    there = own.withColumn("token", F.explode("have")).join(F.broadcast(idle), "token", "left_anti")
    there = there.withColumn("place", F.explode(F.array_compact(F.array(F.when(F.col("value_num").isNotNull(), near(F.col("token"), _bucket(F.col("value_num")))), F.when(F.col("have_print").isNotNull(), same(F.col("token"), F.col("have_print"))))))).drop("token")
    token = F.explode("tokens").alias("token")
    by_value = asked.where("canonical_value IS NOT NULL").select("*", token).withColumn("place", F.explode(F.transform(_neighbours(F.col("canonical_value")), lambda k: near(F.col("token"), k))))
    by_print = asked.where("print IS NOT NULL").select("*", token).withColumn("place", same(F.col("token"), F.col("print")))
    pairs = by_value.unionByName(by_print).drop("token", "tokens").join(there, ["doc_id", "place"])
    match = _near(F.col("canonical_value"), F.col("value_num"), DEFAULT.tolerance) | F.coalesce(F.col("print") == F.col("have_print"), F.lit(False))
    return pairs.where(match & (overlap(F.col("wanted_tokens"), F.col("have")) >= _METRIC)).drop("place", "print", "have_print", "wanted_tokens", "have")


def on_page(labels: DataFrame, facts: DataFrame) -> DataFrame:
    """(label_id) of labels on whose page some fact matches the value, whatever it is called.

    Facts of a page are reduced to their digits and to the least and greatest value of each bucket. If any value of another bucket is
    near a label's, the one nearest to it is; in its own bucket all are. So no label meets the facts one by one.
    """
    here = facts.select("doc_id", F.col("page_index").alias("label_page"), "value_num", signed_digits(F.col("value_raw")).alias("print"))
    ends = here.where("value_num IS NOT NULL").groupBy("doc_id", "label_page", F.signum("value_num").alias("side"), _bucket(F.col("value_num")).alias("bucket")).agg(F.min("value_num").alias("low"), F.max("value_num").alias("high"))
    asked = labels.select("label_id", "doc_id", "label_page", "canonical_value", F.signum("canonical_value").alias("side"), F.explode(_neighbours(F.col("canonical_value"))).alias("bucket"))
    near = lambda c: _near(F.col("canonical_value"), F.col(c), DEFAULT.tolerance)
    close = asked.join(ends, ["doc_id", "label_page", "side", "bucket"]).where((F.col("bucket") == _bucket(F.col("canonical_value"))) | near("low") | near("high"))
    printed = labels.select("label_id", "doc_id", "label_page", signed_digits(F.col("value_text")).alias("print")).join(here.where("print IS NOT NULL").select("doc_id", "label_page", "print"), ["doc_id", "label_page", "print"], "left_semi")
    return close.select("label_id").unionByName(printed.select("label_id")).distinct()


def recall_ladder(labels: DataFrame, facts: DataFrame) -> DataFrame:
    """(label_id, difficulty, rung): found, offpage, renamed or missed, by the best fact of the label's document (Q21, JN11).

    Facts that carry the label's metric are looked up by it; whether a page has the value at all is asked of the page.
    """
    here = F.col("label_page") == F.col("page_index")
    named = metric_hits(labels, facts).groupBy("label_id").agg(F.min(F.when(here, 0).otherwise(1)).alias("r"))
    best = named.unionByName(on_page(labels, facts).withColumn("r", F.lit(2))).groupBy("label_id").agg(F.min("r").alias("r"))
    names = F.array(*[F.lit(x) for x in ("found", "offpage", "renamed", "missed")])
    return labels.select("label_id", "difficulty").join(best, "label_id", "left").select("label_id", "difficulty", F.element_at(names, F.coalesce("r", F.lit(3)) + 1).alias("rung"))


def correct_among_found(labels: DataFrame, facts: DataFrame) -> DataFrame:
    """(aspect, correct, of): of labels found on their page, how many have a fact there with the same value, and with the same period (Q21).

    Labels without a `period_key` are not counted for the period.
    """
    hits = metric_hits(labels, facts).where(F.col("label_page") == F.col("page_index")).withColumnsRenamed({"period_key": "wanted", "have_period_key": "period_key"})
    near = F.abs(F.col("canonical_value") - F.col("value_num")) <= DEFAULT.tolerance * F.greatest(F.abs("canonical_value"), F.abs("value_num"))
    one = hits.groupBy("label_id").agg(F.bool_or(F.coalesce(near, F.lit(False))).alias("value"), F.bool_or(F.coalesce(F.col("wanted") == F.col("period_key"), F.lit(False))).alias("period"), F.first("wanted").alias("wanted"))
    stacked = one.select(F.explode(F.array(F.struct(F.lit("value").alias("aspect"), F.col("value").alias("good"), F.lit(True).alias("asked")), F.struct(F.lit("period").alias("aspect"), F.col("period").alias("good"), F.col("wanted").isNotNull().alias("asked")))).alias("x"))
    return stacked.groupBy("x.aspect").agg(F.count_if(F.col("x.good") & F.col("x.asked")).alias("correct"), F.count_if("x.asked").alias("of"))


def changed_fields(before: DataFrame, after: DataFrame, fields: list[str], examples: int = 4) -> DataFrame:
    """(field, n, examples): how many rows re-normalising changes, field by field (Q24)."""
    old = before.select("fact_id", *[F.col(f).alias(f"old_{f}") for f in fields])
    df = old.join(after.select("fact_id", *fields), "fact_id")
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.lit(f)) for f in fields]))
    moved = df.select("fact_id", F.explode(names).alias("field"))
    own = F.row_number().over(W.partitionBy("field").orderBy("fact_id"))
    shown = moved.withColumn("r", own).where(F.col("r") <= examples).groupBy("field").agg(F.array_sort(F.collect_list("fact_id")).alias("examples"))
    return moved.groupBy("field").agg(F.count("*").alias("n")).join(shown, "field")


def revalidate(stored: DataFrame) -> DataFrame:
    """(was, now, n): how flags move when stored verdicts are validated again (Q25). A rule's verdict stays a rule's."""
    base = stored.withColumn("was", F.col("decided_by")).withColumn("decided_by", F.regexp_replace("decided_by", "-flagged$", ""))
    return validated(base).groupBy("was", F.col("decided_by").alias("now")).agg(F.count("*").alias("n"))


def parse_report(pages: DataFrame) -> DataFrame:
    """Pages, characters, labelled and near-empty pages by document (Q27)."""
    n = F.length(F.coalesce("text", F.lit("")))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(n).alias("chars"), F.count_if(F.col("printed_label").isNotNull()).alias("labelled"), F.count_if(n < 50).alias("near_empty"))
