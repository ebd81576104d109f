"""DuckDB SQL for the fact store: the comparison keys are written down from the derivation itself, not parsed from text."""

ORDERS = """
o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS pr, CAST(floor(o_totalprice) AS BIGINT) AS w, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders)"""

FACTS = ORDERS + """,
f0 AS (
  SELECT k, c, w, y, 'f_' || k AS fact_id, 'd_' || (k % 6) AS doc_id, format('{:,}', w) AS value_raw, 'INR' AS unit_raw,
    CAST(w AS DOUBLE) AS value_num, 'INR' AS value_unit, 'FY' || y AS period_key, 'actual' AS period_basis, 'consolidated' AS scope, '' AS cue FROM o
  UNION ALL
  SELECT k, c, w, y, 'g_' || k, 'd_' || ((k + 1 + (k // 6) % 5) % 6),
    CASE k % 8 WHEN 0 THEN (w // 1000) || '.' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN CAST(w * 103 // 100 AS VARCHAR) WHEN 3 THEN CAST(w * 1000 AS VARCHAR)
      WHEN 4 THEN CAST(w AS VARCHAR) WHEN 5 THEN CAST(w AS VARCHAR) ELSE CAST(w * 6 // 5 AS VARCHAR) END,
    CASE k % 8 WHEN 0 THEN 'INR thousand' WHEN 5 THEN 'USD' ELSE 'INR' END,
    CAST(CASE k % 8 WHEN 0 THEN w WHEN 1 THEN w * 103 // 100 WHEN 3 THEN w * 1000 WHEN 4 THEN w WHEN 5 THEN w ELSE w * 6 // 5 END AS DOUBLE),
    CASE k % 8 WHEN 5 THEN 'USD' ELSE 'INR' END,
    CASE k % 3 WHEN 2 THEN '@' || (y - CASE WHEN k % 8 = 4 THEN 1 ELSE 0 END) || '-03-31' ELSE 'FY' || (y - CASE WHEN k % 8 = 4 THEN 1 ELSE 0 END) END,
    CASE k % 8 WHEN 7 THEN 'projection' ELSE 'actual' END, CASE k % 8 WHEN 6 THEN 'standalone' ELSE 'consolidated' END, CASE k % 8 WHEN 7 THEN ' is projected' ELSE '' END FROM o
  UNION ALL
  SELECT k, c, w, y, 'h_' || k, 'd_' || (k % 6), CAST(w * 11 // 10 AS VARCHAR), 'INR', CAST(w * 11 // 10 AS DOUBLE), 'INR', 'FY' || y, 'actual', 'consolidated', '' FROM o WHERE k % 50 = 0),
facts AS (
  SELECT *, 'currency' AS value_dim, 'Account C' || c AS subject, 'order O' || k || ' value' AS predicate, 'account-c' || c || '|o' || k || '-order-value' AS metric_key,
    'Account C' || c || ' order O' || k || ' value ' || value_raw || cue AS quote, CAST(k % 40 + 1 AS INTEGER) AS page_index,
    CASE WHEN k % 71 = 0 THEN 'relocated' ELSE 'verified' END AS verification, (50 + k % 50) / 100.0::DOUBLE AS confidence
  FROM f0)"""

PAIRS = FACTS + """,
pr0 AS (
  SELECT a.fact_id AS a_id, b.fact_id AS b_id, a.k, a.doc_id AS a_doc, b.doc_id AS b_doc, a.value_num AS x, b.value_num AS z, a.value_unit AS xu, b.value_unit AS zu,
    a.period_key AS ap, b.period_key AS bp, a.period_basis AS ab, b.period_basis AS bb, a.scope AS asc_, b.scope AS bsc, a.value_raw AS ar, b.value_raw AS br, a.unit_raw AS au, b.unit_raw AS bu,
    CASE WHEN a.doc_id <> b.doc_id THEN 1.0::DOUBLE ELSE 0.99::DOUBLE END AS similarity
  FROM facts a JOIN facts b ON a.metric_key = b.metric_key AND b.fact_id < a.fact_id
  WHERE a.doc_id <> b.doc_id OR (a.period_key = b.period_key AND abs(a.value_num - b.value_num) > 0.005 * greatest(abs(a.value_num), abs(b.value_num)))),
pr1 AS (SELECT *, CASE WHEN xu = zu THEN abs(x - z) / greatest(abs(x), abs(z)) END AS rel, greatest(abs(x), abs(z)) AS big, least(abs(x), abs(z)) AS small FROM pr0),
pr2 AS (SELECT *,
    CASE WHEN xu <> zu THEN 'unit_mismatch' WHEN rel <= 0.005 THEN 'equal' WHEN rel <= 0.05 THEN 'close' ELSE 'different' END AS numeric_,
    CASE WHEN ap = bp THEN 'same' WHEN ap = '@' || substr(bp, 3) || '-03-31' OR bp = '@' || substr(ap, 3) || '-03-31' THEN 'aligned' ELSE 'different' END AS period,
    CASE WHEN ab = bb THEN 'same' ELSE 'different' END AS basis, CASE WHEN asc_ = bsc THEN 'same' ELSE 'differing' END AS scope_overlap FROM pr1),
pr3 AS (SELECT *,
    CASE WHEN numeric_ = 'different' AND abs(big / small - 1000) <= 0.02 * greatest(big / small, 1000) THEN '1,000x (thousand)' END AS scale_factor,
    EXISTS (SELECT 1 FROM range(12) t(e) WHERE big >= 10 * pow(10, e) AND (round_even(small / pow(10, e), 0) * pow(10, e) = big OR round_even(big / pow(10, e), 0) * pow(10, e) = small)) AS rounded FROM pr2),
an AS (SELECT *, similarity + 3
    + CASE numeric_ WHEN 'different' THEN CASE WHEN period IN ('same', 'aligned') THEN 3.5 ELSE 1.5 END WHEN 'close' THEN CASE WHEN period IN ('same', 'aligned') THEN 3.0 ELSE 1.0 END
      WHEN 'equal' THEN 1.5 + CASE WHEN ar <> br THEN 1 ELSE 0 END + CASE WHEN au <> bu THEN 1 ELSE 0 END ELSE 1.0 END
    + CASE WHEN scale_factor IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN period = 'different' THEN 1 ELSE 0 END + CASE WHEN basis = 'different' THEN 1 ELSE 0 END
    + CASE WHEN scope_overlap = 'differing' THEN 0.75 ELSE 0 END + CASE WHEN a_doc <> b_doc THEN 1.5 ELSE 0 END AS priority FROM pr3)"""

RELATIONS = PAIRS + """,
j AS (SELECT *, CASE WHEN numeric_ = 'equal' AND period <> 'different' THEN 'corroborates|none|0.9' WHEN numeric_ = 'unit_mismatch' THEN 'reconcilable_context|unit|0.7'
    WHEN period = 'different' THEN 'reconcilable_context|time|0.8' WHEN basis = 'different' THEN 'reconcilable_context|basis|0.8' WHEN scale_factor IS NOT NULL THEN 'reconcilable_context|unit|0.85'
    WHEN scope_overlap = 'differing' THEN 'reconcilable_context|scope|0.75' WHEN numeric_ = 'close' AND rounded THEN 'corroborates|none|0.7' ELSE 'contradicts|none|0.8' END AS v FROM an),
rel AS (SELECT 'r_' || substr(sha256(least(a_id, b_id) || ':' || greatest(a_id, b_id)), 1, 16) AS relation_id, b_id AS fact_a, a_id AS fact_b, a_doc <> b_doc AS cross_doc,
    split_part(v, '|', 1) AS relation, split_part(v, '|', 2) AS dimension, CAST(split_part(v, '|', 3) AS DOUBLE) AS confidence, similarity, 'rule' AS decided_by, j.* EXCLUDE (similarity)
  FROM j)"""

SYNTHETIC = PAIRS + """,
sy0 AS (SELECT *, ['corroborates', 'contradicts', 'reconcilable_context', 'unrelated'][CAST((k // 8) % 4 + 1 AS INTEGER)] AS relation, (k % 60 + 40) / 100.0::DOUBLE AS raw FROM an),
sy AS (SELECT *,
    CAST(relation = 'corroborates' AND period = 'different' AS INTEGER) + CAST(relation = 'corroborates' AND numeric_ = 'different' AS INTEGER)
    + CAST(relation = 'contradicts' AND period = 'different' AS INTEGER) + CAST(relation = 'contradicts' AND numeric_ = 'equal' AS INTEGER)
    + CAST(relation = 'contradicts' AND numeric_ = 'unit_mismatch' AS INTEGER) + CAST(relation = 'contradicts' AND basis = 'different' AS INTEGER) AS n_problems FROM sy0)"""

ISSUES = SYNTHETIC + """,
issues AS (
  SELECT 'i_q_' || k AS issue_id, doc_id, 'quote_not_found' AS kind, 'warning' AS severity, 1700000000 + k AS at FROM facts WHERE k % 97 = 0 AND fact_id LIKE 'f%'
  UNION ALL SELECT 'i_r_' || k, doc_id, 'quote_relocated', 'info', 1700000000 + k FROM facts WHERE k % 71 = 0 AND fact_id LIKE 'f%'
  UNION ALL SELECT 'i_j_' || a_id || b_id, a_doc, 'judgment_inconsistent', 'warning', 1700000000 + k FROM sy WHERE n_problems > 0)"""

DOCUMENTS = """
docs AS (SELECT 'd_' || i AS doc_id, 'report_' || i || '.pdf' AS filename, 1700000000 + i * 3600 AS at FROM range(6) t(i))"""
