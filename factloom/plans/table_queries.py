"""Queries over the driver's tables: documents, conversations, events, benchmark; each with the SQL it must equal, where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.config import Config
from factloom.functions import jsonio, security, text
from factloom.operators import chunking, evaluate, evidence, layout, search
from factloom.plans import fixtures as fx
from factloom.plans.fixtures import read
from factloom.plans.oracles import RELATIONS
from factloom.sources import store
from factloom.sources.tables import fresh_path
from factloom.streaming import stateful

_CHUNKS = Config(chunk_target=1500)


def _doc_dedupe(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    fresh, again = store.new_documents(docs, docs.where("false"))
    return fresh.select("doc_id", F.lit("new").alias("outcome"), F.col("doc_id").alias("kept")).unionByName(again.select("doc_id", F.lit("duplicate").alias("outcome"), F.col("existing").alias("kept")))


_DOC_DEDUPE = """WITH r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS kept FROM documents)
SELECT doc_id, CASE WHEN doc_id = kept THEN 'new' ELSE 'duplicate' END AS outcome, kept FROM r"""


def _whitespace(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.replace(F.replace("text", F.lit(". "), F.lit(".     ")), F.lit("\n"), F.lit("  \n\n\n\n")).alias("text"))
    capped = text.cap_whitespace(F.col("text"))
    return docs.select("doc_id", F.md5(capped).alias("capped"), F.md5(text.clean_block(F.col("text"))).alias("cleaned"))


_WHITESPACE = r"""WITH t AS (SELECT doc_id, replace(replace(text, '. ', '.     '), chr(10), '  ' || chr(10) || chr(10) || chr(10) || chr(10)) AS text FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]{3,}', '   ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS capped,
  md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS cleaned FROM t"""


def _label_runs(spark, d):
    # A turn's footer states its number; every seventh is wrong, and what stands there reads as a roman numeral.
    pages = read(spark, d, "conversations").selectExpr("conv_id AS doc_id", "turn AS page_index", "concat(text, '\n', CASE WHEN (conv_id + turn) % 7 = 3 THEN 'x' ELSE concat('Page ', turn + 10) END) AS text")
    pages = pages.withColumn("candidates", text.label_candidates(F.col("text")))
    return layout.label_runs(pages).select("doc_id", "page_index", "printed_label")


_LABEL_RUNS = """WITH p AS (SELECT conv_id AS doc_id, turn AS page_index, CASE WHEN (conv_id + turn) % 7 = 3 THEN NULL ELSE turn + 10 END AS n FROM conversations),
q AS (SELECT *, lead(n) OVER w AS nx, lag(n) OVER w AS pv FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_index)),
c AS (SELECT *, CASE WHEN nx = n + 1 OR pv = n - 1 THEN n END AS l FROM q),
f AS (SELECT *, lead(l) OVER w AS ln, lag(l) OVER w AS lp FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY page_index))
SELECT doc_id, page_index, coalesce(CAST(coalesce(l, CASE WHEN ln - lp = 2 THEN lp + 1 END) AS VARCHAR), CASE WHEN n IS NULL THEN 'x' END) AS printed_label FROM f"""


def _pages(spark, d):
    return read(spark, d, "conversations").selectExpr("conv_id AS doc_id", "turn AS page_index", "text")


def _chunk_pack(spark, d):
    return chunking.packed(_pages(spark, d), _CHUNKS).select("doc_id", "page_index", F.col("ordinal").cast("int").alias("ordinal"))


_CHUNK_CTE = """s AS (SELECT conv_id AS doc_id, turn AS page_index, length('[[page ' || turn || ']]' || chr(10)) + length(text) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE length(trim(coalesce(text, ''))) >= 30),
r AS (SELECT doc_id, page_index, n, size, 0 AS chunk, size + 2 AS used FROM s WHERE n = 1
  UNION ALL SELECT s.doc_id, s.page_index, s.n, s.size, CASE WHEN r.used + s.size > 1500 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used + s.size > 1500 THEN s.size + 2 ELSE r.used + s.size + 2 END
  FROM r JOIN s ON s.doc_id = r.doc_id AND s.n = r.n + 1),
l AS (SELECT doc_id, max(chunk) AS last FROM r GROUP BY 1),
t AS (SELECT r.doc_id, last, sum(size + 2) - 2 AS tail FROM r JOIN l ON r.doc_id = l.doc_id AND r.chunk = l.last GROUP BY 1, 2),
packed AS (SELECT r.doc_id, r.page_index, CAST(CASE WHEN r.chunk = t.last AND t.last >= 1 AND t.tail < 400 THEN t.last - 1 ELSE r.chunk END AS INTEGER) AS ordinal FROM r JOIN t USING (doc_id))"""


def _ingest_plan(spark, d):
    p = _pages(spark, d)
    return chunking.ingest_plan(p, chunking.packed(p, _CHUNKS))


_INGEST_PLAN = f"""WITH RECURSIVE {_CHUNK_CTE},
a AS (SELECT conv_id AS doc_id, count(*) AS pages, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1),
b AS (SELECT a.*, coalesce(1 + (SELECT max(ordinal) FROM packed p WHERE p.doc_id = a.doc_id), 0)::BIGINT AS chunks FROM a)
SELECT doc_id, sum(pages)::BIGINT AS pages, sum(chars)::BIGINT AS chars, sum(chunks)::BIGINT AS chunks, sum(chunks + 1)::BIGINT AS calls, round(sum(chunks + 1) / 10, 2)::DOUBLE AS minutes FROM b GROUP BY ROLLUP (doc_id)"""


def _chunk_text(spark, d):
    c = chunking.chunks(_pages(spark, d), _CHUNKS)
    return c.select("doc_id", "ordinal", "page_start", "page_end", F.length("text").cast("long").alias("chars"))


_CHUNK_TEXT = f"""WITH RECURSIVE {_CHUNK_CTE}
SELECT p.doc_id, p.ordinal, CAST(min(p.page_index) AS INTEGER) AS page_start, CAST(max(p.page_index) AS INTEGER) AS page_end, (sum(s.size) + 2 * (count(*) - 1))::BIGINT AS chars FROM packed p JOIN s USING (doc_id, page_index) GROUP BY 1, 2"""


def _chunk_oversize(spark, d):
    """Documents as single pages, those over the limit in parts by lines; texts are compared by their digest."""
    pages = read(spark, d, "documents").selectExpr("doc_id", "1 AS page_index", "text")
    made = chunking.chunks(pages, Config(chunk_target=3000, page_limit=3000))
    return made.select("doc_id", "ordinal", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


_CHUNK_OVERSIZE = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents),
l AS (SELECT doc_id, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) AS n FROM t WHERE length(s) > 3000),
r AS (SELECT doc_id, n, line, 0 AS part, length(line) + 1 AS used FROM l WHERE n = 1
  UNION ALL SELECT l.doc_id, l.n, l.line, CASE WHEN r.used + length(l.line) > 3000 THEN r.part + 1 ELSE r.part END, CASE WHEN r.used + length(l.line) > 3000 THEN 0 ELSE r.used END + length(l.line) + 1
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.n = r.n + 1),
p AS (SELECT doc_id, part, string_agg(line, chr(10) ORDER BY n) AS s FROM r GROUP BY 1, 2),
c AS (SELECT doc_id, part, '[[page 1]]' || chr(10) || s AS s FROM p WHERE regexp_matches(s, '\S') UNION ALL SELECT doc_id, 0, '[[page 1]]' || chr(10) || s FROM t WHERE length(s) BETWEEN 30 AND 3000),
o AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY part)),
j AS (SELECT doc_id, k, CASE WHEN k = m - 1 AND m > 1 AND length(s) < 400 THEN k - 1 ELSE k END AS ordinal, s FROM o),
g AS (SELECT doc_id, ordinal, string_agg(s, chr(10) || chr(10) ORDER BY k) AS s FROM j GROUP BY 1, 2)
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, length(s) AS chars, md5(s) AS digest FROM g"""


def _quotes(spark, d):
    return read(spark, d, "benchmark").selectExpr("item_id AS quote_id", "text AS quote")


def _quote_pages(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id AS page_id", "text")


def _quote_exact(spark, d):
    q, p = _quotes(spark, d), _quote_pages(spark, d)
    pairs = evidence.tier_candidates(q, p).join(q, "quote_id").join(p, "page_id")
    return pairs.where(evidence.tiers(F.col("quote"), F.col("text")) == 1.0).select("quote_id", "page_id")


_QUOTE_EXACT = r"""WITH n AS (SELECT item_id, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM benchmark), m AS (SELECT doc_id, lower(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM documents)
SELECT item_id AS quote_id, doc_id AS page_id FROM n JOIN m ON contains(p, q)"""


def _quote_cascade(spark, d):
    # Every passage three ways: as it is, with its stops as dashes, with a space lost. Without spaces and stops they are the same.
    q, p = _quotes(spark, d), _quote_pages(spark, d)
    pairs = evidence.tier_candidates(q, p).join(q, "quote_id").join(p, "page_id")
    ways = F.array(F.struct(F.lit("same").alias("way"), F.col("quote").alias("q")), F.struct(F.lit("punct").alias("way"), F.replace("quote", F.lit(","), F.lit(" -")).alias("q")), F.struct(F.lit("tight").alias("way"), F.regexp_replace("quote", "^(\\S+) (\\S+) ", "$1$2 ").alias("q")))
    df = pairs.select("quote_id", "page_id", "text", F.explode(ways).alias("x"))
    return df.select("quote_id", "page_id", "x.way", evidence.tiers(F.col("x.q"), F.col("text")).alias("score")).where("score IS NOT NULL")


def _quote_fuzzy(spark, d):
    q, p = _quotes(spark, d).withColumn("quote", F.concat(F.lit("zzz "), F.expr("substring(quote, 5)"))), _quote_pages(spark, d)
    df = evidence.block_candidates(q, p).join(q, "quote_id").join(p, "page_id").where(evidence.tiers(F.col("quote"), F.col("text")).isNull())
    # Without a common block of the needed length the score is 0.
    return evidence.located(df).where("score > 0").select("quote_id", "page_id", "score", "method", "quote_start", "quote_end")


def _quote_relocate(spark, d):
    pages = _pages(spark, d)
    facts = pages.where(F.length("text") > 60).selectExpr(
        "concat('q_', doc_id, '_', page_index) AS fact_id", "doc_id", "substring(text, 5, 50) AS quote", "CASE WHEN (doc_id + page_index) % 3 = 0 THEN page_index + 1 ELSE page_index END AS claimed_page", "cast(0 AS bigint) AS page_start", "cast(100 AS bigint) AS page_end")
    return evidence.relocate(facts, pages).select("fact_id", "page_index", "score", "outcome")


#: Tiers of a quote in a page, as SQL over normalised texts.
_MARKS = "".join(dict.fromkeys(evidence.SOFT)).replace("'", "''")
_SOFT = lambda x: f"translate({x}, '{_MARKS}', '{' ' * len(dict.fromkeys(evidence.SOFT))}')"
_ALONE = lambda x: f"trim(regexp_replace({_SOFT(x)}, ' +', ' ', 'g'))"
_TIER = lambda q, p: f"CASE WHEN {q} = '' THEN NULL WHEN contains({p}, {q}) THEN 1.0 WHEN {_ALONE(q)} <> '' AND contains({_SOFT(p)}, {_ALONE(q)}) THEN 0.97 WHEN {_ALONE(q)} <> '' AND contains(replace({_SOFT(p)}, ' ', ''), replace({_ALONE(q)}, ' ', '')) THEN 0.93 END"
_NORM = lambda x: f"lower(regexp_replace(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'), '^ ', ''))"

_QUOTE_CASCADE = f"""WITH w AS (SELECT item_id AS quote_id, 'same' AS way, text AS q FROM benchmark UNION ALL SELECT item_id, 'punct', replace(text, ',', ' -') FROM benchmark
  UNION ALL SELECT item_id, 'tight', regexp_replace(text, '^(\\S+) (\\S+) ', '\\1\\2 ') FROM benchmark),
n AS (SELECT quote_id, way, trim({_NORM('q')}) AS q FROM w), m AS (SELECT doc_id AS page_id, {_NORM('text')} AS p FROM documents),
s AS (SELECT quote_id, page_id, way, ({_TIER('q', 'p')})::DOUBLE AS score FROM n JOIN m ON contains(replace({_SOFT('p')}, ' ', ''), replace({_SOFT('q')}, ' ', '')))
SELECT * FROM s WHERE score IS NOT NULL"""

_QUOTE_RELOCATE = f"""WITH p AS (SELECT conv_id AS doc_id, turn AS page_index, text, {_NORM('text')} AS n FROM conversations),
f AS (SELECT 'q_' || doc_id || '_' || page_index AS fact_id, doc_id, trim({_NORM('substring(text, 5, 50)')}) AS q, CASE WHEN (doc_id + page_index) % 3 = 0 THEN page_index + 1 ELSE page_index END AS claimed FROM p WHERE length(text) > 60),
h AS (SELECT fact_id, page_index, claimed, ({_TIER('q', 'n')})::DOUBLE AS score FROM f JOIN p USING (doc_id) WHERE page_index BETWEEN 0 AND 100),
b AS (SELECT * FROM h WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY page_index = claimed DESC, score DESC, page_index) = 1)
SELECT fact_id, b.page_index, b.score, CASE WHEN b.page_index IS NULL THEN 'rejected' WHEN b.page_index = f.claimed THEN 'verified' ELSE 'relocated' END AS outcome FROM f LEFT JOIN b USING (fact_id)"""


def _reverify(spark, d):
    pages = _pages(spark, d)
    facts = pages.where(F.length("text") > 60).selectExpr(
        "concat('q_', doc_id, '_', page_index) AS fact_id", "doc_id", "CASE WHEN page_index % 5 = 4 THEN 'zq zq zq' ELSE substring(text, 5, 50) END AS quote", "page_index AS claimed_page", "cast(0 AS bigint) AS page_start", "cast(100 AS bigint) AS page_end", "page_index % 2 = 0 AS was_verified")
    df = evidence.reverify(facts, pages)
    return df.groupBy("outcome").agg(F.sum("n").alias("n"))


_REVERIFY = """SELECT CASE WHEN turn % 2 = 0 THEN CASE WHEN turn % 5 = 4 THEN 'lost' ELSE 'kept' END WHEN turn % 5 = 4 THEN 'still_failing' ELSE 'recovered' END AS outcome, count(*) AS n FROM conversations WHERE length(text) > 60 GROUP BY 1"""


def _cascade_delete(spark, d):
    tables = {"facts": fx.facts(spark, d), "relations": fx.relations(spark, d), "documents": fx.documents(spark, d)}
    return store.removed_counts(tables, store.without_document(tables, "d_4"))


_CASCADE_DELETE = f"""WITH {RELATIONS} SELECT 'documents' AS name, 1::BIGINT AS n UNION ALL SELECT 'facts', count(*) FROM facts WHERE doc_id = 'd_4' UNION ALL SELECT 'relations', count(*) FROM rel WHERE a_doc = 'd_4' OR b_doc = 'd_4'"""


def _upsert(spark, d):
    e = read(spark, d, "events").selectExpr("user_id", "event_type", "value", "event_id AS seq")
    return store.upserted(e.where("seq % 3 = 0").withColumn("_n", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("seq"))).where("_n = 1").drop("_n"), e.where("seq % 3 != 0"), "user_id", "event_type")


_UPSERT = """WITH s AS (SELECT user_id, event_type, value, event_id AS seq FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1),
b AS (SELECT user_id, event_type, value, event_id AS seq FROM events WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT * FROM b UNION ALL SELECT * FROM s ANTI JOIN b USING (user_id, event_type)"""


def _insert(spark, d):
    e = read(spark, d, "events").selectExpr("user_id", "event_type", "value", "event_id AS seq")
    first = W.partitionBy("user_id", "event_type").orderBy("seq")
    return store.inserted(e.where("seq % 3 = 0").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), e.where("seq % 3 != 0"), "user_id", "event_type")


_INSERT = """WITH s AS (SELECT user_id, event_type, value, event_id AS seq FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1),
b AS (SELECT user_id, event_type, value, event_id AS seq FROM events WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)
SELECT * FROM s UNION ALL SELECT * FROM b ANTI JOIN s USING (user_id, event_type)"""


def _events(spark, d):
    return read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


def _budget(spark, d):
    df = stateful.within_daily_budget(_events(spark, d).select(F.col("event_id").alias("call_id"), "at"))
    return df.select("call_id", "calls_24h", "allowed")


_BUDGET = """SELECT event_id AS call_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS calls_24h, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) <= 200 AS allowed FROM events"""


def _limiter(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), (F.unix_micros("at") / 1e6).alias("at"))
    return stateful.limited(e, 2, 36_000.0)


_LIMITER = """WITH RECURSIVE e AS (SELECT user_id AS client, event_id AS request_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT client, request_id, n, true AS allowed, 0 AS retry_after, [sec] AS hits FROM e WHERE n = 1
  UNION ALL SELECT client, request_id, n, len(kept) < 2, CASE WHEN len(kept) < 2 THEN 0 ELSE greatest(1, CAST(trunc(36000.0 - (sec - kept[1])) AS INTEGER)) END, CASE WHEN len(kept) < 2 THEN list_append(kept, sec) ELSE kept END
  FROM (SELECT e.*, list_filter(r.hits, lambda h: e.sec - h < 36000.0) AS kept FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1))
SELECT client, request_id, allowed, CAST(retry_after AS INTEGER) AS retry_after FROM r"""


def _breaker(spark, d):
    e = _events(spark, d).select(F.col("event_type").alias("model"), F.col("event_id").alias("call_id"), (F.col("user_id") % 5).alias("key"), (F.col("event_id") % 3 != 0).alias("refused"), (F.unix_micros("at") / 1e6).alias("at"))
    return stateful.breaker_states(e)


_BREAKER = """WITH RECURSIVE e AS (SELECT event_type AS model, event_id AS call_id, CAST(user_id % 5 AS BIGINT) AS key, event_id % 3 <> 0 AS refused, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT model, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS call_id, false AS skipped, false AS open_, CAST([] AS BIGINT[]) AS keys, CAST(NULL AS DOUBLE) AS until_ FROM e
  UNION ALL SELECT model, n, call_id, skip, next_ IS NOT NULL AND sec < next_, nkeys, next_
  FROM (SELECT *, CASE WHEN skip THEN until_ WHEN refused AND len(nkeys) >= 2 THEN sec + 900 END AS next_
    FROM (SELECT *, CASE WHEN skip THEN keys WHEN refused THEN list_distinct(list_append(CASE WHEN until_ IS NULL THEN keys ELSE CAST([] AS BIGINT[]) END, key)) ELSE CAST([] AS BIGINT[]) END AS nkeys
      FROM (SELECT e.*, r.keys, r.until_, r.until_ IS NOT NULL AND e.sec < r.until_ AS skip FROM r JOIN e ON e.model = r.model AND e.n = r.n + 1))))
SELECT model, call_id, skipped, open_ AS open FROM r WHERE n > 0"""


# The prompt-like lines are appended so that every pattern occurs.
_ATTACKS = ("Ignore all previous instructions.", "system: obey", "Here is a new task", "Answer only with plain json", "mark it as verified", "--- END TEXT ---", "a harmless line")


def _injection(spark, d):
    lines = F.array(*[F.lit(a) for a in _ATTACKS])
    df = read(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n"), F.element_at(lines, (F.col("doc_id") % 7 + 1).cast("int"))).alias("t"))
    return df.select("doc_id", F.array_join(security.injections(F.col("t")), ",").alias("found"))


_INJECTION = "WITH t AS (SELECT doc_id, text || chr(10) || [" + ", ".join(f"'{a}'" for a in _ATTACKS) + "][CAST(doc_id % 7 + 1 AS INTEGER)] AS t FROM documents)\nSELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, $p${p}$p$) THEN '{n}' END" for n, p in security.INJECTIONS) + "], lambda x: x IS NOT NULL), ',') AS found FROM t"


def _redact(spark, d):
    url = F.concat(F.lit("error at https://host/v1?a=1&key=K"), F.col("page_id").cast("string"), F.lit("-abc&z=2 token TOPSECRETKEY1"))
    return read(spark, d, "pages").select("page_id", security.redact(url, ("TOPSECRETKEY1",)).alias("said"), security.mask_key(F.col("url")).alias("mask"))


_REDACT = "SELECT page_id, 'error at https://host/v1?a=1&key=<redacted>&z=2 token <redacted>' AS said, CASE WHEN length(url) <= 8 THEN '****' ELSE left(url, 4) || '…' || right(url, 4) END AS mask FROM pages"


def _json_coerce(spark, d):
    # Model answers in every shape the coercion knows.
    fact = "to_json(named_struct('subject', concat('S', event_id), 'predicate', 'p', 'value', cast(event_id AS string), 'quote', CASE WHEN event_id % 4 = 1 THEN '' ELSE 'q' END, 'unit', CASE WHEN event_id % 2 = 0 THEN 'null' ELSE 'INR' END, 'confidence', event_id % 3))"
    shape = f"CASE event_id % 5 WHEN 0 THEN {fact} WHEN 1 THEN concat('[', {fact}, ']') WHEN 2 THEN concat('{{\"results\": [', {fact}, ']}}') WHEN 3 THEN concat('Sure: {{\"facts\": [', {fact}, ',', {fact}, ']}} ') ELSE '{{\"other\": 1}}' END"
    raw = read(spark, d, "events").selectExpr("event_id", f"{shape.replace('{{', '{').replace('}}', '}')} AS raw")
    facts, issues = jsonio.coerced(raw, "raw", "event_id")
    ok = facts.select("event_id", F.lit("fact").alias("kind"), F.concat_ws("|", "subject", "value_raw", F.coalesce("unit_raw", F.lit("-"))).alias("detail"))
    return ok.unionByName(issues.select("event_id", "kind", F.when(F.col("kind") == "incomplete_fact", F.col("detail")).otherwise("").alias("detail")))


_JSON_COERCE = """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'unexpected_shape' WHEN event_id % 4 = 1 THEN 'incomplete_fact' ELSE 'fact' END AS kind,
  CASE WHEN event_id % 5 = 4 THEN '' WHEN event_id % 4 = 1 THEN 'missing quote' ELSE 'S' || event_id || '|' || event_id || '|' || CASE WHEN event_id % 2 = 0 THEN '-' ELSE 'INR' END END AS detail
FROM events, range(2) t(copy) WHERE copy = 0 OR event_id % 5 = 3"""


def _json_repair(spark, d):
    raw = read(spark, d, "events").selectExpr("event_id", "substring(concat('```json\n[', props, ', ', props, ', ', props, ']\n```'), 1, cast(20 + event_id % 40 AS int)) AS raw")
    return jsonio.parsed(raw, "raw").select("event_id", "json")


def _table_render(spark, d):
    rows = F.array(F.array(F.col("n_name"), F.col("n_nationkey").cast("string")), F.array(F.lit(" "), F.lit(None).cast("string")), F.array(F.lit(" a  b "), F.lit("c"), F.lit("d")))
    return read(spark, d, "nation").select("n_nationkey", text.render_table(rows).alias("drawn"), F.size(text.page_tables(F.array(rows, rows, F.array(F.array(F.lit("x")))))).alias("n_tables"))


_TABLE_RENDER = "SELECT n_nationkey, n_name || ' | ' || n_nationkey || ' | ' || chr(10) || 'a b | c | d' AS drawn, CAST(1 AS INTEGER) AS n_tables FROM nation"


def _column_order(spark, d):
    # A page a nation: a title, four blocks in either column, dealt in scattered order.
    b = read(spark, d, "nation").selectExpr("n_nationkey AS doc_id", "explode(sequence(0, 8)) AS i")
    b = b.selectExpr("doc_id", "1 AS page_index", "0D AS page_x0", "100D AS page_x1", "i AS block_no", "0 AS type", "CASE WHEN i = 8 THEN 5D WHEN i % 2 = 0 THEN 5D ELSE 55D END AS x0", "CASE WHEN i = 8 THEN 95D WHEN i % 2 = 0 THEN 45D ELSE 95D END AS x1",
                     "CASE WHEN i = 8 THEN 0D ELSE 10D + 10 * ((i div 2 + doc_id) % 4) END AS y0", "CASE WHEN i = 8 THEN 'title' ELSE concat(CASE WHEN i % 2 = 0 THEN 'l' ELSE 'r' END, (i div 2 + doc_id) % 4) END AS text")
    return layout.reading_order(b).select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("said"))


def _opening(spark, d):
    p = _pages(spark, d).withColumn("printed_label", F.lit(None).cast("string"))
    return layout.opening(p, 3, 400).select("doc_id", F.length("text").cast("long").alias("chars"))


_OPENING = """WITH p AS (SELECT conv_id AS doc_id, turn AS page_index, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
q AS (SELECT doc_id, page_index, length('[[page ' || page_index || ']]' || chr(10) || trim(text)) AS size FROM p WHERE r <= 3 AND trim(coalesce(text, '')) <> ''),
u AS (SELECT doc_id, least(size, 400 - coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM q)
SELECT doc_id, CAST(sum(room) + 2 * (count(*) - 1) AS BIGINT) AS chars FROM u WHERE room > 0 GROUP BY 1"""


def _parse_report(spark, d):
    labelled = F.when((F.col("doc_id") + F.col("page_index")) % 4 != 0, F.col("page_index").cast("string"))
    return evaluate.parse_report(_pages(spark, d).withColumn("printed_label", labelled))


_PARSE_REPORT = """SELECT conv_id AS doc_id, count(*) AS pages, sum(length(coalesce(text, '')))::BIGINT AS chars, count(*) FILTER ((conv_id + turn) % 4 <> 0) AS labelled, count(*) FILTER (length(coalesce(text, '')) < 50) AS near_empty FROM conversations GROUP BY 1"""


def _job_updates(spark, d):
    """Updates of jobs, a job a user and day: status by event type, progress by event, some fields untouched."""
    return _events(spark, d).selectExpr(
        "concat(user_id, '/', date(at)) AS job_id", "event_id AS seq", "at", "CASE WHEN event_id % 3 = 0 THEN concat('d_', user_id) END AS doc_id", "event_type AS status",
        "CASE WHEN event_id % 2 = 0 THEN cast(event_id AS int) END AS done", "100 AS total", "CASE WHEN event_id % 5 = 0 THEN concat('m', event_id) END AS message",
    )


def _job_progress(spark, d):
    return stateful.job_states(_job_updates(spark, d))


_JOB_PROGRESS = """SELECT user_id || '/' || CAST(ts AS DATE) AS job_id, CASE WHEN max(event_id) FILTER (event_id % 3 = 0) IS NOT NULL THEN 'd_' || user_id END AS doc_id, max_by(event_type, event_id) AS status,
  CAST(max(event_id) FILTER (event_id % 2 = 0) AS INTEGER) AS done, CAST(100 AS INTEGER) AS total, 'm' || max(event_id) FILTER (event_id % 5 = 0) AS message, min(ts) AS created_at, max(ts) AS updated_at
FROM events GROUP BY user_id, CAST(ts AS DATE)"""


def _job_list(spark, d):
    docs = read(spark, d, "events").selectExpr("concat('d_', user_id) AS doc_id", "concat('report_', user_id, '.pdf') AS filename").distinct()
    return search.job_list(stateful.job_states(_job_updates(spark, d)), docs, 50).select("job_id", "filename", "status", "created_at")


_JOB_LIST = f"""WITH j AS ({_JOB_PROGRESS}) SELECT job_id, 'report_' || substr(doc_id, 3) || '.pdf' AS filename, status, created_at FROM j ORDER BY created_at DESC, job_id LIMIT 50"""


def _page_lookup(spark, d):
    return search.page(_pages(spark, d), 3, 1)


_PATHS = ("assets/app.js", "../etc/passwd", "a/../../b", "a/./b//c", "/etc/passwd", "C:\\\\x", "..\\\\..\\\\x", "a/b/../c", "..", "")


def _path_guard(spark, d):
    df = read(spark, d, "pages").select("page_id", F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("page_id") % len(_PATHS) + 1).cast("int")).alias("path"))
    return df.select("page_id", security.resolved(F.col("path")).alias("resolved"), security.inside(F.col("path")).alias("inside"))


_PATH_GUARD = "WITH a AS (SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'assets/app.js' WHEN 3 THEN 'a/b/c' WHEN 7 THEN 'a/c' WHEN 9 THEN '' END AS resolved FROM pages) SELECT *, resolved IS NOT NULL AS inside FROM a"


def _tumbling(spark, d):
    return stateful.tumbling(_events(spark, d)).select("start", "event_type", "n", "total")


_TUMBLING = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def _sessions(spark, d):
    return stateful.sessions(_events(spark, d)).select("user_id", "start", "n")


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""


def _stream_tumbling(spark, d):
    """The tumbling windows as a stream over the table's file, run to its end."""
    schema = read(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d).withColumn("at", F.col("ts").cast("timestamp"))
    return stateful.drained(stateful.tumbling(source), fresh_path(spark, "tumbling"), "complete")


QUERIES = {
    "doc_dedupe": (_doc_dedupe, _DOC_DEDUPE),
    "whitespace_cap": (_whitespace, _WHITESPACE),
    "label_runs": (_label_runs, _LABEL_RUNS),
    "chunk_pack": (_chunk_pack, f"WITH RECURSIVE {_CHUNK_CTE} SELECT doc_id, page_index, ordinal FROM packed"),
    "chunk_text": (_chunk_text, _CHUNK_TEXT),
    "chunk_oversize": (_chunk_oversize, _CHUNK_OVERSIZE),
    "ingest_plan": (_ingest_plan, _INGEST_PLAN),
    "document_opening": (_opening, _OPENING),
    "parse_report": (_parse_report, _PARSE_REPORT),
    "job_progress": (_job_progress, _JOB_PROGRESS),
    "jobs_list": (_job_list, _JOB_LIST),
    "page_lookup": (_page_lookup, "SELECT conv_id AS doc_id, turn AS page_index, text FROM conversations WHERE conv_id = 3 AND turn = 1"),
    "path_guard": (_path_guard, _PATH_GUARD),
    "quote_exact": (_quote_exact, _QUOTE_EXACT),
    "quote_cascade": (_quote_cascade, _QUOTE_CASCADE),
    "quote_fuzzy": (_quote_fuzzy, None),
    "quote_relocate": (_quote_relocate, _QUOTE_RELOCATE),
    "reverify": (_reverify, _REVERIFY),
    "cascade_delete": (_cascade_delete, _CASCADE_DELETE),
    "upsert_keep_last": (_upsert, _UPSERT),
    "insert_ignore": (_insert, _INSERT),
    "budget_24h": (_budget, _BUDGET),
    "rate_limit": (_limiter, _LIMITER),
    "breaker_state": (_breaker, _BREAKER),
    "injection_scan": (_injection, _INJECTION),
    "redact": (_redact, _REDACT),
    "json_coerce": (_json_coerce, _JSON_COERCE),
    "json_repair": (_json_repair, None),
    "table_render": (_table_render, _TABLE_RENDER),
    "column_order": (_column_order, "SELECT n_nationkey AS doc_id, 'title l0 l1 l2 l3 r0 r1 r2 r3' AS said FROM nation"),
    "event_tumbling": (_tumbling, _TUMBLING),
    "event_sessions": (_sessions, _SESSIONS),
    "stream_tumbling": (_stream_tumbling, _TUMBLING),
}
