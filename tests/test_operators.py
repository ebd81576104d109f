"""Operators over rows: pairs, verdicts, evidence, chunks, layout, store, state."""

import json
import os
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.config import Config
from factloom.operators import candidates, chunking, evaluate, evidence, judge, layout, pairs, search
from factloom.sources import store
from factloom.streaming import stateful

FACT = "fact_id string, doc_id string, subject string, predicate string, value_raw string, unit_raw string, value_num double, value_unit string, value_dim string, period_key string, period_basis string, metric_key string, qualifiers array<string>, verification string, quote string"


def fact(i, doc="A", num=100.0, unit="INR", dim="currency", period="FY2024", basis="actual", quals=("x",), key="m|k", raw="100"):
    return (i, doc, "S", "p", raw, unit, num, unit, dim, period, basis, key, list(quals), "verified", "q")


def analysed(spark, a, b, sim=1.0):
    df = spark.createDataFrame([(a, b, sim)], f"a struct<{FACT.replace(' ', ':').replace(',:', ',')}>, b struct<{FACT.replace(' ', ':').replace(',:', ',')}>, similarity double")
    return pairs.with_priority(pairs.analyse(df))


def test_pair_analysis(spark):
    cases = [
        (fact("a"), fact("b", "B"), "equal", "same", None), (fact("a"), fact("b", "B", num=103.0), "close", "same", None), (fact("a"), fact("b", "B", num=120.0), "different", "same", None), (fact("a"), fact("b", "B", num=1e5), "different", "same", "1,000x (thousand)"),
        (fact("a"), fact("b", "B", unit="USD"), "unit_mismatch", "same", None), (fact("a", num=None), fact("b", "B"), "non_numeric", "same", None), (fact("a", period="@2024-03-31"), fact("b", "B"), "equal", "aligned", None),
        (fact("a", period="@2024-03-31"), fact("b", "B", period="FY2023"), "equal", "different", None), (fact("a", period=None), fact("b", "B", period=""), "equal", "both_missing", None), (fact("a", period=None), fact("b", "B"), "equal", "one_missing", None),
        (fact("a", period="9M@2021-12-31"), fact("b", "B", period="@2021-12-31"), "equal", "different", None),
    ]
    for a, b, numeric, period, factor in cases:
        r, t = analysed(spark, a, b).first(), analysed(spark, b, a).first()
        assert (r["numeric"], r["period"], r["scale_factor"]) == (numeric, period, factor)
        assert (r["numeric"], r["period"], r["priority"]) == (t["numeric"], t["period"], t["priority"]), "analysis is symmetric"
    r = analysed(spark, fact("a", dim="currency"), fact("b", dim="ratio", quals=())).first()
    assert r["skip"] and r["scope_overlap"] == "differing" and r["differing_qualifiers"] == ["x"]


def test_validation(spark):
    df = analysed(spark, fact("a"), fact("b", "B", num=85.0))
    for relation, period, numeric, basis, flagged in [("corroborates", "different", "equal", "same", True), ("corroborates", "same", "different", "same", True), ("contradicts", "different", "different", "same", True), ("contradicts", "same", "equal", "same", True), ("contradicts", "same", "unit_mismatch", "same", True), ("contradicts", "same", "different", "different", True), ("contradicts", "same", "different", "same", False), ("reconcilable_context", "different", "equal", "different", False), ("unrelated", "different", "equal", "different", False)]:
        r = judge.validated(df.withColumns({"relation": F.lit(relation), "period": F.lit(period), "numeric": F.lit(numeric), "basis": F.lit(basis), "raw_confidence": F.lit(0.8), "decided_by": F.lit("llm")})).first()
        assert bool(r["problems"]) == flagged and r["confidence"] == (0.4 if flagged else 0.8) and r["decided_by"] == ("llm-flagged" if flagged else "llm")
        if (relation, numeric) == ("corroborates", "different"):
            assert "15.0%" in r["problems"][0]


def test_model_judge(spark):
    df = analysed(spark, fact("a"), fact("b", "B", num=85.0))
    said = judge.judge_with(df, lambda payloads, escalated: json.dumps({"results": [{"relation": "CONTRADICTS", "dimension": "odd", "confidence": "7"} for _ in payloads]}))
    r = judge.validated(judge.whitelist(said)).first()
    assert (r["relation"], r["dimension"], r["confidence"], r["decided_by"]) == ("contradicts", "none", 1.0, "llm")


def test_topk_takes_places_of_the_same_document(spark):
    rows = [("a", "A", [1.0, 0.0]), ("b", "A", [1.0, 0.1]), ("c", "B", [1.0, 0.2]), ("d", "B", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, doc_id string, vec array<double>")
    got = {(r["a"], r["b"]) for r in candidates.cosine_topk(df, df, 1, 0.5).collect()}
    assert got == {("b", "c"), ("c", "b")}, "a's only place goes to b, of its own document"
    got = {(r["a"], r["b"]) for r in candidates.cosine_topk(df, df, 2, 0.5, shard=2).collect()}
    assert got == {("a", "c"), ("b", "c"), ("c", "a"), ("c", "b")}


def test_keys_of_many_facts_are_split(spark, monkeypatch):
    """Pairs of a key are the same whether one task has them all or many."""
    monkeypatch.setattr(candidates, "SPLIT", 7)
    facts = spark.createDataFrame([fact(f"f{i:03}", "ABC"[i % 3], num=float(i % 4), key="m|k" if i < 60 else f"m|{i % 5}") for i in range(80)], FACT)
    rows = facts.collect()
    want = {(x["fact_id"], y["fact_id"]) for x in rows for y in rows if y["fact_id"] < x["fact_id"] and x["metric_key"] == y["metric_key"]}
    doc = {r["fact_id"]: (r["doc_id"], r["value_num"]) for r in rows}
    got = [(r["a_id"], r["b_id"]) for r in candidates.metric_pairs(facts).collect()]
    assert sorted(got) == sorted((a, b) for a, b in want if doc[a][0] != doc[b][0])
    got = [(r["a_id"], r["b_id"]) for r in candidates.same_doc_pairs(facts).collect()]
    assert sorted(got) == sorted((a, b) for a, b in want if doc[a][0] == doc[b][0] and doc[a][1] != doc[b][1])


PAGE = "Revenue from operations\n grew 12.5% to  INR 8,142 crore in FY24.\nTotal | 1,234 | 5,678"


@pytest.mark.parametrize(("quote", "method"), [("Revenue from operations grew", "exact"), ("INR 8 142 crore in FY24", "punctuation_normalised"), ("operationsgrew 12.5%", "whitespace_insensitive"), ("Revenue from operations grew 12.5% to INR 8,142 krore in FY24", "fuzzy"), ("a made-up sentence entirely", "none"), ("", "none")])
def test_quotes(quote, method):
    score, start, end, got = evidence.locate(quote, PAGE)
    assert got == method and (start is None) == (method == "none")
    if method == "exact":
        assert " ".join(PAGE[start:end].split()) == quote


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n\tİé", max_size=60), st.integers(0, 50), st.integers(1, 20))
def test_offsets_round_trip(page, at, n):
    quote = page[at : at + n]
    if not quote.strip():
        return
    score, start, end, _ = evidence.locate(quote, page)
    assert score == 1.0 and " ".join(page[start:end].lower().split()).startswith(" ".join(quote.lower().split())[:1])


def test_tiers_agree_with_locate(spark):
    quotes = ["Revenue from operations grew", "INR 8 142 crore in FY24", "operationsgrew 12.5%", "no such thing", ""]
    df = spark.createDataFrame([(q, PAGE) for q in quotes], "quote string, text string")
    rows = evidence.located(df).withColumn("tier", evidence.tiers(F.col("quote"), F.col("text"))).collect()
    assert [r["tier"] for r in rows] == [r["score"] if r["quote_start"] is not None else None for r in rows] == [1.0, 0.97, 0.93, None, None]


def test_relocation(spark):
    pages = spark.createDataFrame([("d", 1, "nothing"), ("d", 2, PAGE), ("d", 3, PAGE), ("d", 9, "far away words here")], "doc_id string, page_index int, text string")
    rows = [("a", 2), ("b", 1), ("c", None), ("e", 1)]
    quotes = {"a": "grew 12.5%", "b": "grew 12.5%", "c": "grew 12.5%", "e": "far away words"}
    facts = spark.createDataFrame([(i, "d", quotes[i], p, 1, 3) for i, p in rows], "fact_id string, doc_id string, quote string, claimed_page int, page_start int, page_end int")
    got = {r["fact_id"]: (r["page_index"], r["outcome"]) for r in evidence.relocate(facts, pages).collect()}
    assert got == {"a": (2, "verified"), "b": (2, "relocated"), "c": (2, "verified"), "e": (None, "rejected")}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(30, 400), min_size=1, max_size=12))
def test_packing_conserves_pages(spark, lengths):
    config = Config(chunk_target=500, runt_min=100, page_limit=1000)
    pages = spark.createDataFrame([(1, i + 1, chr(97 + i) * n) for i, n in enumerate(lengths)], "doc_id long, page_index long, text string")
    made = chunking.chunks(pages, config).orderBy("ordinal").collect()
    assert "".join(c["text"] for c in made).count("[[page") == len(lengths)
    assert all(len(c["text"]) <= 600 for c in made)
    fold = {r["page_index"]: r["ordinal"] for r in chunking.packed(pages, config).collect()}
    assert fold == {p: c["ordinal"] for c in made for p in range(c["page_start"], c["page_end"] + 1)}


def test_oversize_pages_stand_alone(spark):
    """Parts of an oversize page are chunks of their own; pages are trimmed first; a short last chunk joins the one before."""
    config = Config(chunk_target=300, runt_min=60, page_limit=200, page_min=5)
    texts = ["a" * 100, "  " + "b" * 190 + " \n", "\n\n".join(["c" * 120] * 3), "d" * 40, "e" * 90, "tiny", "f" * 10]
    pages = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page_index long, text string")
    got = [(r["page_start"], r["page_end"], r["text"]) for r in chunking.chunks(pages, config).orderBy("ordinal").collect()]
    mark = lambda k, t: f"[[page {k}]]\n{t}"
    assert got == [
        (1, 1, mark(1, "a" * 100)), (2, 2, mark(2, "b" * 190)), *[(3, 3, mark(3, "c" * 120))] * 3, (4, 7, "\n\n".join([mark(4, "d" * 40), mark(5, "e" * 90), mark(7, "f" * 10)])),
    ]
    assert {r["page_index"]: r["ordinal"] for r in chunking.packed(pages, config).collect()} == {1: 0, 2: 1, 3: 2, 4: 5, 5: 5, 7: 5}


def test_oversize_page():
    parts = chunking.split_page("a" * 50 + "\n\n" + "b" * 50 + "\n\n" + "\n".join(["c" * 40] * 5), 100)
    assert all(len(p) <= 100 for p in parts) and "".join(parts).replace("\n", "") == "a" * 50 + "b" * 50 + "c" * 200


def test_reading_order_falls_back_to_rows(spark):
    rows = [("d", 1, 0.0, 100.0, k, x, x + 20, y, f"t{k}", 0) for k, (x, y) in enumerate([(50.0, 0.0), (5.0, 1.0), (5.0, 40.0)])]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, page_x0 double, page_x1 double, block_no int, x0 double, x1 double, y0 double, text string, type int")
    assert layout.reading_order(df).first()["text"] == "t1\nt0\nt2"


def test_declared_labels_stay(spark):
    df = spark.createDataFrame([("d", 1, ["5"], "ix"), ("d", 2, ["6"], None), ("d", 3, ["2024"], None), ("d", 4, ["8"], None), ("d", 5, ["9"], None), ("d", 6, ["iv"], None)], "doc_id string, page_index int, candidates array<string>, declared string")
    assert [r["printed_label"] for r in layout.label_runs(df).orderBy("page_index").collect()] == ["ix", "6", "7", "8", "9", "iv"]


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (3, "f", 2)], "k int, v string, seq int")
    rows = lambda df: sorted((r["k"], r["v"]) for r in df.collect())
    assert rows(store.upserted(old, new, "k")) == [(1, "a"), (2, "d"), (3, "f")]
    assert rows(store.inserted(old, new, "k")) == [(1, "a"), (2, "b"), (3, "e")]
    assert rows(store.updated(old, F.col("k") == 1, v=F.lit("z"))) == [(1, "z"), (2, "b")]
    assert store.evolved(old, {"w": "double"}).dtypes[-1] == ("w", "double")


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a b#.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "n.pdf").write_bytes(b"nope")
    found = store.files(spark, str(tmp_path)).select("path", "content")
    # Spark's file source skips empty files; an upload may still be one.
    found = found.union(spark.createDataFrame([("x/e.pdf", bytearray()), ("x/odd name#.PDF", bytearray(b"%PDF")), ("x/y.txt", bytearray(b"%PDF"))], "path string, content binary"))
    got = {r["safe_name"]: r["outcome"] for r in store.admitted(found).collect()}
    assert {k: got[k] for k in ("e.pdf", "odd name_.PDF", "y.txt", "n.pdf")} == {"e.pdf": "empty", "odd name_.PDF": "ok", "y.txt": "not a pdf", "n.pdf": "no pdf header"}
    pages = store.decode_pages(store.files(spark, str(tmp_path), "n.pdf"), lambda content: [{"text": content.decode()}]).first()
    assert (pages["page_index"], pages["text"]) == (1, "nope")
    def endless(content):
        for k in range(10**9):
            yield {"text": "x" * 10, "label": str(k)}

    files = spark.createDataFrame([("a", bytearray(b"one\ftwo\xff")), ("b", bytearray(b""))], "path string, content binary")
    assert [(r["path"], r["page_index"], r["text"]) for r in store.decode_pages(files).collect()] == [("a", 1, "one"), ("a", 2, "two\ufffd"), ("b", 1, "")]
    assert {r["error"] for r in store.decode_pages(files, endless).collect()} == {"more than 600 pages"}
    assert {r["error"] for r in store.decode_pages(files, endless, Config(max_document_chars=95)).collect()} == {"more than 95 characters"}
    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "doc_id string, v int")
    store.replace_documents(df, str(tmp_path / "t"))
    store.replace_documents(df.where("v = 2").withColumn("v", F.lit(5)), str(tmp_path / "t"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 5]
    assert store.seed(spark, str(tmp_path / "t"), str(tmp_path / "u")) and not store.seed(spark, str(tmp_path / "t"), str(tmp_path / "u"))


def test_limiter(spark):
    rows = [("a", i, float(t)) for i, t in enumerate([0, 1, 2, 61, 62])] + [("b", 9, 1.0)]
    df = spark.createDataFrame(rows, "client string, request_id long, at double")
    got = {r["request_id"]: (r["allowed"], r["retry_after"]) for r in stateful.limited(df, 2, 60.0).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 58), 3: (True, 0), 4: (True, 0), 9: (True, 0)}
    assert stateful.allow([], 0.0, 0, 60.0)[0]


def test_breaker(spark):
    rows = [(0, "k1", True, 0.0), (1, "k1", True, 1.0), (2, "k2", True, 2.0), (3, "k3", True, 3.0), (4, "k1", False, 903.0), (5, "k2", True, 904.0)]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, call_id long, key string, refused boolean, at double")
    got = [(r["skipped"], r["open"]) for r in stateful.breaker_states(df).orderBy("call_id").collect()]
    assert got == [(False, False), (False, False), (False, True), (True, True), (False, False), (False, False)]


def test_key_pool():
    pool = stateful.KeyPool(["a", "b"], rpm=1)
    assert [pool.acquire(0.0)[0], pool.acquire(0.0)[0]] == ["a", "b"] and pool.acquire(1.0) == (None, 59.0)
    pool.refused("a", 60.0)
    assert pool.acquire(61.0)[0] == "b"
    pool.disable("a")
    assert pool.acquire(62.0)[0] is None


def test_recall_matching(spark):
    df = spark.createDataFrame([("revenue from operations", "Acme total revenue operation", 5.0, 5.02, "5", "5.02"), ("a b", "c", 5.0, -5.0, "5", "(5)")], "w string, h string, x double, y double, wt string, ht string")
    got = df.select(evaluate.token_overlap(F.col("w"), F.col("h")).alias("o"), evaluate.values_match(F.col("x"), F.col("y"), F.col("wt"), F.col("ht")).alias("m")).collect()
    assert [(r["o"], r["m"]) for r in got] == [(1.0, True), (0.0, False)]


def test_quote_queries_look_at_the_whole_passage(spark, tmp_path):
    """A document with words 3 to 8 altered, one with the later part only, one with spaces lost: each is looked at."""
    from factloom.plans.table_queries import QUERIES

    words = [f"word{i}{'abcdefghij'[i % 10] * 3}" for i in range(80)]
    passage = " ".join(words)
    altered = " ".join([*words[:2], *["changed"] * 6, *words[8:]])
    texts = [(1, f"before {altered} behind"), (2, " ".join(words[40:])), (3, "x " + passage.replace(" ", "", 12) + " y"), (4, "nothing of it " * 30), (5, None)]
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = lambda name: QUERIES[name][0] if isinstance(QUERIES[name], tuple) else QUERIES[name]
    fuzzy = {r["page_id"]: r for r in query("quote_fuzzy")(spark, str(tmp_path)).collect()}
    assert {1, 2} <= set(fuzzy) and 4 not in fuzzy
    assert fuzzy[1]["method"] == "fuzzy" and fuzzy[1]["quote_end"] > 600, "the end of a long passage is searched for too"
    assert {(r["page_id"], r["score"]) for r in query("quote_cascade")(spark, str(tmp_path)).collect()} == {(3, 0.93)}


@pytest.mark.parametrize("order", ["i", "i % 2, i", "-(i % 2), i"])
def test_mean_confidence_does_not_depend_on_the_order_of_rows(spark, order):
    """Confidences 0.7 and 0.85 in equal numbers have a mean of 0.775, which rounds to 0.78 in whatever order they are added."""
    rows = spark.range(3750).selectExpr("id AS i").orderBy(*[F.expr(x) for x in order.split(", ")]).coalesce(1)
    df = rows.selectExpr("'r' AS relation", "true AS cross_doc", "'unit' AS dimension", "CASE WHEN i % 2 = 0 THEN 0.7D ELSE 0.85D END AS confidence")
    got = search.quality_report(df).collect()
    assert [(r["n"], r["mean_confidence"]) for r in got] == [(3750, 0.78)] * 2


def test_calls_of_a_day(spark):
    """Against brute force: equal instants, exactly a day apart, a microsecond more, hours' last instants, no time at all."""
    hour = 3_600_000_000
    at = [0, 0, 5, hour - 1, hour, 24 * hour - 1, 24 * hour, 24 * hour + 1, 24 * hour + 5, 24 * hour + 6, 25 * hour - 1, 25 * hour, 25 * hour + 1, 49 * hour, 100 * hour, -3, -24 * hour - 3, None, None]
    at += [(k * 7_919_777_771) % (72 * hour) for k in range(300)]
    calls = spark.createDataFrame(list(enumerate(at)), "call_id int, us long").selectExpr("call_id", "timestamp_micros(us) AS at")
    df = stateful.within_daily_budget(calls, 50)
    got = {r["call_id"]: (r["calls_24h"], r["allowed"]) for r in df.select("call_id", "calls_24h", "allowed").collect()}
    n = [sum(y is None if x is None else y is not None and x - 24 * hour <= y <= x for y in at) for x in at]
    assert got == {i: (k, k <= 50) for i, k in enumerate(n)}
    assert "-86400000000" not in df._jdf.queryExecution().toString(), "no sliding frame"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c", max_size=80), st.text(alphabet="ab c", max_size=40), st.integers(1, 14))
def test_longest_block_is_that_of_sequence_matcher(page, quote, least):
    m = SequenceMatcher(None, page, quote, autojunk=False).find_longest_match()
    assert evidence.longest_block(page, quote, least) == ((m.a, m.b, m.size) if m.size >= least else None)


@pytest.mark.parametrize("few", [0, 10**6])
def test_pieces_of_long_pages(spark, monkeypatch, few):
    """A quote is found wherever it stands in a page of many stretches, whether its pieces are broadcast or shuffled."""
    monkeypatch.setattr(evidence, "BROADCAST_PIECES", few)
    quote = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(60))
    fill = "".join(chr(0x4E00 + k % 5000) for k in range(1500))
    pages = spark.createDataFrame([(at, fill[:at] + quote[20:46] + fill[at:]) for at in range(0, 600, 23)] + [(-1, fill), (-2, ""), (-3, None)], "page_id int, text string")
    quotes = spark.createDataFrame([(1, quote)], "quote_id int, quote string")
    df = evidence.block_candidates(quotes, pages)
    assert sorted(r["page_id"] for r in df.collect()) == list(range(0, 600, 23))
    assert ("Broadcast" in df._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in df._jdf.queryExecution().optimizedPlan().toString()) == bool(few)
    whole = spark.createDataFrame([(1, quote[20:46])], "quote_id int, quote string")
    assert sorted(r["page_id"] for r in evidence.tier_candidates(whole, pages).collect()) == list(range(0, 600, 23))


def test_labels_meet_facts_as_by_brute_force(spark):
    """Rungs and counts are those of comparing every label with every fact; no join has the value alone for a key."""
    import random

    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "order", "value"]
    name = lambda: " ".join(r.sample(words, r.randint(1, 4)))
    number = lambda: r.choice([0.0, 100.0, 100.5, 100.4999, 99.5, 99.49, 101.0, -100.0, 100.5025, 1e-9, 7.0, None])
    print_ = lambda: r.choice(["100", "-100", "(7)", "n/a", "", "1,00", None])
    facts = [(f"f{i}", r.choice("AB"), name(), name(), r.randint(1, 3), number(), print_(), r.choice(["FY1", "FY2", None])) for i in range(150)]
    labels = [(f"l{i}", r.choice("ABC"), r.choice(["easy", "hard"]), r.randint(1, 3), r.choice([name(), name(), "", "unheard of"]), number(), print_(), r.choice(["FY1", "FY2", None])) for i in range(150)]
    f = spark.createDataFrame(facts, "fact_id string, doc_id string, subject string, predicate string, page_index int, value_num double, value_raw string, period_key string")
    l = spark.createDataFrame(labels, "label_id string, doc_id string, difficulty string, label_page int, metric string, canonical_value double, value_text string, period_key string")  # noqa: E741
    x = l.alias("l").join(f.alias("f"), F.col("l.doc_id") == F.col("f.doc_id"))
    match = evaluate.values_match(F.col("canonical_value"), F.col("value_num"), F.col("value_text"), F.col("value_raw"))
    over, here = evaluate.token_overlap(F.col("metric"), F.concat_ws(" ", "subject", "predicate")) >= 2 / 3, F.col("label_page") == F.col("page_index")
    met = x.where(match).select("label_id", "fact_id", over.alias("over"), here.alias("here"), "canonical_value", "value_num", F.col("l.period_key").alias("wanted"), F.col("f.period_key").alias("period")).collect()
    assert {(m["label_id"], m["fact_id"]) for m in met if m["over"]} == {(m["label_id"], m["fact_id"]) for m in evaluate.metric_hits(l, f).collect()}
    want = dict.fromkeys((i[0] for i in labels), 3)
    for m in met:
        want[m["label_id"]] = min(want[m["label_id"]], (0 if m["here"] else 1) if m["over"] else 2 if m["here"] else 3)
    got = {g["label_id"]: ("found", "offpage", "renamed", "missed").index(g["rung"]) for g in evaluate.recall_ladder(l, f).collect()}
    assert got == want and set(want.values()) == {0, 1, 2, 3}
    found = [m for m in met if m["over"] and m["here"]]
    near = {m["label_id"] for m in found if None not in (m["canonical_value"], m["value_num"]) and abs(m["canonical_value"] - m["value_num"]) <= 0.005 * max(abs(m["canonical_value"]), abs(m["value_num"]))}
    asked = {m["label_id"] for m in found if m["wanted"]}
    right = {m["label_id"] for m in found if m["wanted"] and m["wanted"] == m["period"]}
    got = {g["aspect"]: (g["correct"], g["of"]) for g in evaluate.correct_among_found(l, f).collect()}
    assert got == {"value": (len(near), len({m["label_id"] for m in found})), "period": (len(right), len(asked))}


@pytest.mark.parametrize("split", [7, 1000])
def test_pairs_of_a_key_from_one_join(spark, monkeypatch, split):
    """The same pairs as of the two kinds apart, whole facts on both sides; ids alone need no other columns to travel."""
    monkeypatch.setattr(candidates, "SPLIT", split)
    rows = [fact(f"f{i:03}", "ABC"[i % 3], num=float(i % 4) if i % 11 else None, period="FY1" if i % 7 else None, key="m|k" if i < 40 else (f"m|{i % 9}" if i % 10 else ("|" if i % 20 else None))) for i in range(120)]
    facts = spark.createDataFrame(rows, FACT)
    df = candidates.same_key_pairs(facts)
    want = candidates.metric_pairs(facts).unionByName(candidates.same_doc_pairs(facts)).collect()
    assert sorted((r["a"]["fact_id"], r["b"]["fact_id"], r["similarity"]) for r in df.collect()) == sorted(map(tuple, want)) and len(want) > 100
    known = {r["fact_id"]: r for r in facts.collect()}
    assert all(r["a"] == known[r["a"]["fact_id"]] and r["b"] == known[r["b"]["fact_id"]] for r in df.collect())
    if split == 1000:
        plan = df.select("a.fact_id", "b.fact_id", "similarity")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "a_quote" not in plan
    both = candidates.union_pairs(spark.createDataFrame([("f001", "f000", 0.5), ("f000", "f001", 0.4)], "a_id string, b_id string, similarity double"), spark.createDataFrame(want))
    got = {(r["a_id"], r["b_id"]): (r["similarity"], r["source"]) for r in both.collect()}
    assert got == {(r["a_id"], r["b_id"]): (r["similarity"], 1) for r in want if (r["a_id"], r["b_id"]) != ("f001", "f000")} | {("f000", "f001"): (0.4, 0)}


def test_relation_counts_take_one_shuffle(spark, monkeypatch):
    from factloom.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 1)
    facts = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "fact_id string")
    relations = spark.createDataFrame([("1", "a", "b", "x"), ("2", "a", "z", "x"), ("3", "a", "a", "y"), ("4", "b", "c", "x")], "relation_id string, fact_a string, fact_b string, relation string")
    df = search.relation_counts(facts, relations)
    assert sorted((r["fact_id"], sorted(r["counts"].items())) for r in df.collect()) == [("a", [("x", 2), ("y", 2)]), ("b", [("x", 2)]), ("c", [("x", 1)]), ("c", [("x", 1)])]
    assert search.relation_counts(facts, relations.where("false")).first()["counts"] == {}
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and df.rdd.getNumPartitions() == 12, "facts and ends in parts of TASK_ROWS"
    assert search.filter_count(df).first()["n"] == 8


@pytest.mark.parametrize("asking", [1, 7, 100])
def test_topk_does_not_depend_on_blocks(spark, asking):
    import random

    r = random.Random(3)
    rows = [(f"v{i:02}", "ABC"[i % 3], [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, doc_id string, vec array<double>")
    key = lambda d: sorted((x["a"], x["b"], x["rank"], round(x["similarity"], 9)) for x in d.collect())
    assert key(candidates.cosine_topk(df, df, 4, 0.2, shard=16, asking=asking)) == key(candidates.cosine_topk(df, df, 4, 0.2, shard=1000))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_issues_are_logged_without_a_table_of_pairs(spark):
    from factloom.plans import fixtures
    from factloom.sources import tables

    tables.forget()
    assert search.issue_examples(fixtures.issues(spark, "/root/testdata/sf0.001")).count() == 6
    assert {k[1] for k in tables._WRITTEN} == {"facts", "issues"}


def test_long_pages_are_split_in_small_batches(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.set(keys[1], "64m")
        pages = spark.range(600).selectExpr("id AS doc_id", "1 AS page_index", "repeat(concat('line ', id, '\n'), 40) AS text")
        df = chunking.units(pages, Config(page_limit=100)).where("solo")
        assert df.groupBy("doc_id").count().where("count > 2").count() == 600
        assert int(spark.conf.get(keys[0])) <= 256 and int(spark.conf.get(keys[1]).rstrip("b")) <= 8 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
