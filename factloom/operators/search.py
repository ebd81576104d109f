"""The read side: search, detail, statistics, rankings (Q1 to Q18, Q28). Every order ends in an id, so that it is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.sources.tables import tasks

# Fixed order in which kinds of failures are shown.
KIND_ORDER = (
    "quote_not_found", "judgment_inconsistent", "chunk_failed", "judge_failed", "incomplete_fact", "unexpected_shape",
    "no_text_layer", "profile_failed", "pairs_over_budget", "quote_relocated",
)


def endpoints(relations: DataFrame) -> DataFrame:
    """Each relation once from either end: (fact_id, relation); joins on it hash, where an OR of two keys would loop."""
    return relations.select(F.col("fact_a").alias("fact_id"), "relation", "relation_id").unionByName(relations.select(F.col("fact_b").alias("fact_id"), "relation", "relation_id"))


def linked_only(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Facts that some relation other than 'unrelated' touches (JN8)."""
    return facts.join(endpoints(relations.where("relation != 'unrelated'")).select("fact_id"), "fact_id", "left_semi")


def touching(relations: DataFrame, facts: DataFrame, doc_id: str) -> DataFrame:
    """Relations with an end in a document (JN9)."""
    own = facts.where(F.col("doc_id") == doc_id).select("fact_id")
    return relations.join(endpoints(relations).join(own, "fact_id", "left_semi").select("relation_id"), "relation_id", "left_semi")


def find_facts(
    facts: DataFrame, relations: DataFrame | None = None, doc_id: str | None = None, q: str | None = None, period: str | None = None,
    verification: str | None = None, numeric_only: bool = False, linked: bool = False,
) -> DataFrame:
    """Facts that meet every given condition (Q1); in `q`, % and _ are wildcards."""
    if doc_id:
        facts = facts.where(F.col("doc_id") == doc_id)
    if q:
        like = f"%{q}%"
        facts = facts.where(F.col("subject").ilike(like) | F.col("predicate").ilike(like) | F.col("value_raw").ilike(like) | F.col("quote").ilike(like))
    if period:
        facts = facts.where(F.col("period_key") == period)
    if verification:
        facts = facts.where(F.col("verification") == verification)
    if numeric_only:
        facts = facts.where(F.col("value_num").isNotNull())
    return linked_only(facts, relations) if linked else facts


def fact_page(found: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a search, most confident first."""
    return found.orderBy(F.desc("confidence"), F.asc_nulls_first("page_index"), "fact_id").offset(offset).limit(min(500, max(1, limit)))


def fact_total(found: DataFrame) -> DataFrame:
    """How many facts a search has in all, beside its page (Q1)."""
    return found.agg(F.count("*").alias("total"))


def with_documents(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows with their document's file name and title (SRC5, JN1); rows of unknown documents go."""
    return rows.join(documents.select("doc_id", "filename", "title"), "doc_id")


def fact_detail(facts: DataFrame, pages: DataFrame, documents: DataFrame, fact_id: str) -> DataFrame:
    """One fact with its document and the text of the page it was found on, null where the page is not stored (Q3)."""
    own = with_documents(facts.where(F.col("fact_id") == fact_id), documents)
    return own.join(pages.select("doc_id", "page_index", F.col("text").alias("page_text")), ["doc_id", "page_index"], "left")


def page(pages: DataFrame, doc_id: str, page_index: int) -> DataFrame:
    """One page (Q10)."""
    return pages.where((F.col("doc_id") == doc_id) & (F.col("page_index") == page_index))


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    """One job (Q10)."""
    return jobs.where(F.col("job_id") == job_id)


def job_list(jobs: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """Jobs with their file names, newest first (Q10)."""
    named = jobs.join(documents.select("doc_id", "filename"), "doc_id", "left")
    return named.orderBy(F.desc("created_at"), "job_id").limit(min(200, max(1, limit)))


def issue_list(issues: DataFrame, documents: DataFrame, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Issues with file names and their payload decoded, newest first (Q9). A payload that is no JSON object is an empty map."""
    some = issues.where(F.col("kind") == kind) if kind else issues
    named = some.join(documents.select("doc_id", "filename"), "doc_id", "left").orderBy(F.desc("created_at"), "issue_id").limit(limit)
    if "payload" not in issues.columns:
        return named
    decoded = F.from_json("payload", "map<string,string>")
    return named.withColumn("payload", F.coalesce(decoded, F.create_map().cast("map<string,string>")))


def document_detail(doc_id: str, issues: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(section, name, n) of a document: issues by kind, chunks by status, pages with and without a printed label (Q6)."""

    def counted(df: DataFrame, section: str, name: Column) -> DataFrame:
        return df.where(F.col("doc_id") == doc_id).groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")

    labelled = F.when(F.col("printed_label").isNotNull(), "labelled").otherwise("unlabelled")
    return counted(issues, "issue", F.col("kind")).unionByName(counted(chunks, "chunk", F.col("status"))).unionByName(counted(pages, "page", labelled))


def filter_count(counts: DataFrame) -> DataFrame:
    """How many relations a list without the unrelated has, over all facts' counts by kind (Q28). Each is counted from both its ends."""
    kept = F.map_filter("counts", lambda kind, n: kind != "unrelated")
    own = F.aggregate(F.map_values(kept), F.lit(0).cast("long"), lambda a, n: a + n)
    return counts.agg(F.coalesce(F.sum(own), F.lit(0)).alias("n"))


def relation_counts(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(fact_id, counts): relations by kind for every fact given, an empty map where there are none (Q2)."""
    own, ends = facts.select("fact_id", F.lit(None).cast("string").alias("relation"), F.lit(True).alias("own")), endpoints(relations).select("fact_id", "relation", F.lit(False).alias("own"))
    # Facts and ends meet in one shuffle; both groupings find their rows where they are.
    parts = tasks(facts.sparkSession, facts.count() + 2 * relations.count())
    n = own.unionByName(ends).repartition(parts, "fact_id").groupBy("fact_id", "relation", "own").agg(F.count("*").alias("n"))
    kinds = F.array_sort(F.collect_list(F.when(~F.col("own"), F.struct("relation", "n"))))
    every = n.groupBy("fact_id").agg(F.map_from_entries(kinds).alias("counts"), F.sum(F.when(F.col("own"), F.col("n"))).cast("int").alias("rows"))
    # A fact given several times comes several times; ends of facts that were not given go.
    return every.where("rows > 0").select("fact_id", "counts", F.explode(F.array_repeat(F.lit(0), F.col("rows")))).select("fact_id", "counts")


def hydrated(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Relations with both facts as structs a and b; those that lack one go (JN3)."""
    one = lambda name: facts.select(F.struct(*facts.columns).alias(name), F.col("fact_id").alias(f"fact_{name}"))
    return relations.join(one("a"), "fact_a").join(one("b"), "fact_b")


def fact_relations(relations: DataFrame, facts: DataFrame, fact_id: str) -> DataFrame:
    """A fact's relations, oriented so that a is the fact itself (Q3)."""
    own = relations.where((F.col("fact_a") == fact_id) | (F.col("fact_b") == fact_id))
    turned = F.col("fact_b") == fact_id
    df = hydrated(own, facts)
    return df.withColumns({"a": F.when(turned, F.col("b")).otherwise(F.col("a")), "b": F.when(turned, F.col("a")).otherwise(F.col("b"))}).orderBy(F.desc("confidence"), "relation_id")


def severity() -> Column:
    return F.when(F.col("relation") == "contradicts", 0).when(F.col("relation") == "reconcilable_context", 1).when(F.col("relation") == "corroborates", 2).otherwise(3)


def find_relations(relations: DataFrame, relation: str | None = None, min_confidence: float = 0.0, include_unrelated: bool = False) -> DataFrame:
    """Relations, the gravest first (Q4)."""
    df = relations.where(F.col("confidence") >= min_confidence)
    if relation:
        df = df.where(F.col("relation") == relation)
    elif not include_unrelated:
        df = df.where("relation != 'unrelated'")
    return df.withColumn("severity", severity()).orderBy("severity", F.desc("confidence"), "relation_id")


def document_list(documents: DataFrame, facts: DataFrame, issues: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Documents with counts of facts and issues and their latest job, newest first (Q5)."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    df = documents.join(count(facts, "n_facts"), "doc_id", "left").join(count(issues, "n_issues"), "doc_id", "left").na.fill(0, ["n_facts", "n_issues"])
    if jobs is not None:
        df = df.join(jobs.groupBy("doc_id").agg(F.max_by("job_id", "created_at").alias("latest_job")), "doc_id", "left")
    return df.orderBy(F.desc("created_at"), "doc_id")


def corpus_stats(documents: DataFrame, facts: DataFrame, relations: DataFrame, issues: DataFrame) -> DataFrame:
    """(section, name, n): counts of everything, by relation, by verification, and the twelve commonest periods (Q7)."""
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(name).alias("name"), "n")
    by = lambda df, c, section: df.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), F.col(c).alias("name"), "n")
    out = total(documents, "documents")
    for df, name in ((facts, "facts"), (relations, "relations"), (issues, "issues")):
        out = out.union(total(df, name))
    out = out.union(total(relations.where("cross_doc"), "cross_document")).union(total(facts.where("value_num IS NOT NULL"), "numeric"))
    out = out.union(by(relations, "relation", "relation")).union(by(facts, "verification", "verification"))
    periods = by(facts.where("period_key IS NOT NULL"), "period_key", "period").orderBy(F.desc("n"), "name").limit(12)
    return out.union(periods)


def health(documents: DataFrame, facts: DataFrame, calls: DataFrame, now: Column, budget: int | None) -> DataFrame:
    """Counts, the calls of the last 24 hours, and what is left of the budget (Q8)."""
    recent = calls.where(F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")).agg(F.count("*").alias("calls_24h"))
    df = documents.agg(F.count("*").alias("documents")).crossJoin(facts.agg(F.count("*").alias("facts"))).crossJoin(recent)  # one row each
    return df.withColumn("remaining", F.greatest(F.lit(0), F.lit(budget) - F.col("calls_24h")) if budget else F.lit(None).cast("bigint"))


def _top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order, "relation_id").limit(n)


def _differs(c: str) -> Column:
    text = lambda s: F.lower(F.trim(F.coalesce(F.col(f"{s}.{c}"), F.lit(""))))
    return text("a") != text("b")


def showcase_corroboration(relations: DataFrame, facts: DataFrame, limit: int = 5) -> DataFrame:
    """Of the 6 x limit surest, those that documents phrase differently first (Q11)."""
    first = _top(relations.where("relation = 'corroborates' AND cross_doc"), 6 * limit, F.desc("confidence"), F.desc("similarity"))
    df = hydrated(first, facts)
    unit = F.coalesce(F.col("a.unit_raw"), F.lit("")) != F.coalesce(F.col("b.unit_raw"), F.lit(""))
    sound = (F.col("a.verification") != "unverified") & (F.col("b.verification") != "unverified")
    keys = [_differs("value_raw") | unit, unit, _differs("predicate"), sound, ~F.col("decided_by").endswith("-flagged"), F.col("confidence")]
    return df.orderBy(*[F.desc(k) for k in keys], "relation_id").limit(limit)


def showcase_contradiction(relations: DataFrame, facts: DataFrame, limit: int = 5) -> DataFrame:
    """Conflicts: across documents first, then unflagged, sure, and far apart (Q12)."""
    df = hydrated(_top(relations.where("relation = 'contradicts'"), 6 * limit, F.desc("confidence")), facts)
    x, y = F.col("a.value_num"), F.col("b.value_num")
    big = F.greatest(F.abs(x), F.abs(y))
    gap = F.when(x.isNull() | y.isNull() | (big == 0), 0.0).otherwise(F.abs(x - y) / big)
    df = df.withColumn("gap", gap)
    return df.orderBy(F.desc("cross_doc"), F.desc(~F.col("decided_by").endswith("-flagged")), F.desc("confidence"), F.desc("gap"), "relation_id").limit(limit)


def showcase_reconcilable(relations: DataFrame, limit: int = 5) -> DataFrame:
    """Apparent conflicts, one of each dimension in turn (Q13)."""
    first = _top(relations.where("relation = 'reconcilable_context'"), 6 * limit, F.desc("confidence"))
    named = (F.col("dimension") != "none") & (F.trim(F.coalesce("reconciliation", F.lit(""))) != "")
    # At most 6 x limit rows: one window over all of them is small by construction.
    df = first.withColumn("_named", F.coalesce(named, F.lit(False))).withColumn("_any", F.max("_named").over(W.partitionBy()))
    df = df.where("_named OR NOT _any")
    order = [F.desc("cross_doc"), F.desc(~F.col("decided_by").endswith("-flagged")), F.desc("confidence"), F.asc("relation_id")]
    df = df.withColumn("_place", F.row_number().over(W.orderBy(*order))).withColumn("turn", F.row_number().over(W.partitionBy("dimension").orderBy("_place")))
    df = df.withColumn("_first", F.min("_place").over(W.partitionBy("dimension")))
    return df.orderBy("turn", "_first").limit(limit).drop("_named", "_any", "_place", "_first")


def issue_examples(issues: DataFrame, limit: int = 8) -> DataFrame:
    """The newest max(1, limit / 4) issues of each kind, kinds in their fixed order (Q14)."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KIND_ORDER)], F.lit(len(KIND_ORDER)))
    own = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("created_at"), "issue_id"))
    df = issues.withColumns({"kind_rank": rank, "place": own}).where(F.col("place") <= max(1, limit // 4))
    return df.orderBy("kind_rank", "kind", "place")


def failure_summary(facts: DataFrame, relations: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: what was stored, rejected, corrected, flagged, and the rate of rejection."""
    f = facts.agg(F.count("*").alias("facts_stored"), F.count_if(F.col("verification") == "relocated").alias("citations_corrected"))
    i = issues.agg(F.count_if(F.col("kind") == "quote_not_found").alias("facts_rejected"))
    r = relations.agg(F.count_if(F.col("decided_by").endswith("-flagged")).alias("flagged"))
    df = f.crossJoin(i).crossJoin(r)  # one row each
    all_ = F.col("facts_rejected") + F.col("facts_stored")
    return df.withColumn("rejection_rate", F.when(all_ == 0, 0.0).otherwise(F.bround(F.col("facts_rejected") / all_, 4)))


def quality_report(relations: DataFrame) -> DataFrame:
    """Relations by kind and crossing and by kind and dimension, with mean confidence (Q15).

    The mean is taken of decimals: sums of doubles depend on the order of rows, and a mean of 0.775 then rounds to 0.77 or to 0.78.
    """
    exact = F.col("confidence").cast("decimal(20,12)")
    grouped = relations.groupingSets([["relation", "cross_doc"], ["relation", "dimension"]], "relation", "cross_doc", "dimension")
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg(exact), 2).cast("double").alias("mean_confidence"))


def coverage(facts: DataFrame) -> DataFrame:
    """Shares of facts with a number, a period and a basis, in per cent."""
    share = lambda cond: F.round(100 * F.count_if(cond) / F.nullif(F.count("*"), F.lit(0)), 1)
    return facts.agg(share(F.col("value_num").isNotNull()).alias("numeric_pct"), share(F.col("period_key").isNotNull()).alias("period_pct"), share(F.col("period_basis").isNotNull()).alias("basis_pct"))


def random_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """Some rows at random (Q16)."""
    return df.orderBy(F.rand()).limit(n)


def export_facts(facts: DataFrame, n: int = 400) -> DataFrame:
    """The surest numeric facts (Q18)."""
    return facts.where("value_num IS NOT NULL").orderBy(F.desc("confidence"), "fact_id").limit(n)
