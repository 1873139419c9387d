"""DuckDB SQL for the queries on sources, lookups and checks, written on its own."""

from __future__ import annotations

import random

from foldline.plans.oracles import _LABELS, _ORIGINS, _PREDICTIONS, _RUNS


def _shuffled(n: int, seed: int) -> str:
    """The places that Python's generator gives 0 .. n - 1, as SQL values."""
    items = list(range(n))
    random.Random(seed).shuffle(items)
    return ", ".join(f"({k}, {x})" for k, x in enumerate(items))


def _drawn_f1() -> str:
    def total(where: str) -> str:
        return f"coalesce(sum(times) FILTER ({where}), 0)::DOUBLE"

    return " + ".join(f"coalesce(2 * {total(f'truth = {v} AND predicted = {v}')} / nullif({total(f'truth = {v}')} + {total(f'predicted = {v}')}, 0), 0)" for v in (-1, 0, 1))


_ANSWERS = """
answers AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS family, doc_id % 7 IN (1, 2, 4) AS broken, doc_id % 7 <> 3 AS strict FROM documents)
"""

_POSITIONS = (
    _RUNS
    + """,
positions AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM (SELECT DISTINCT doc_id FROM axis_labels WHERE first IS NOT NULL OR second IS NOT NULL)),
total AS (SELECT count(*) AS n FROM positions)
"""
)


def _draws(replicates: int) -> str:
    return f"""draws AS (SELECT rep, ((rep * 7919 + (pos // 3) * 104729) % n + pos % 3) % n AS idx, count(*) AS times
      FROM total, range({replicates}) r(rep), LATERAL (SELECT unnest(range(n)) AS pos) GROUP BY ALL)"""


_PAIRED = (
    _PREDICTIONS
    + """,
sizes AS (SELECT series, max(fold) AS n FROM predictions GROUP BY series)
"""
)


def _reps(draws: str, names: str) -> str:
    f1 = " + ".join(
        f"coalesce(2 * coalesce(sum(times) FILTER (true_class = '{c}' AND predicted_class = '{c}'), 0)::DOUBLE / nullif(coalesce(sum(times) FILTER (true_class = '{c}'), 0)::DOUBLE + coalesce(sum(times) FILTER (predicted_class = '{c}'), 0)::DOUBLE, 0), 0)"
        for c in ("cut", "hold", "hike")
    )
    return f"""draws AS ({draws}),
    reps AS (SELECT p.series, d.rep, p.arm, ({f1}) / 3.0::DOUBLE AS macro_f1, sum(abs(true_bp - predicted_bp) * times) / sum(times)::DOUBLE AS mae_bp
      FROM predictions p JOIN draws d ON d.series = p.series AND d.idx = p.fold - 1 WHERE p.arm IN ({names}) GROUP BY ALL)"""


_HASHED = """SELECT series, rep, (start + k) % n AS idx, count(*) AS times FROM (
      SELECT series, n, rep, block, ('0x' || substr(md5('20260923:' || rep || ':' || block), 1, 13))::BIGINT % n AS start
      FROM sizes, range(500) r(rep), LATERAL (SELECT unnest(range((n + 3) // 4)) AS block)), LATERAL (SELECT unnest(range(least(4, n - block * 4))) AS k) GROUP BY ALL"""
_ARITHMETIC = """SELECT series, rep, ((rep * 7919 + (pos // 4) * 104729) % n + pos % 4) % n AS idx, count(*) AS times FROM sizes, range(200) r(rep), LATERAL (SELECT unnest(range(n)) AS pos) GROUP BY ALL"""

_F1 = " + ".join(
    f"coalesce(2.0::DOUBLE * count(*) FILTER (true_class = '{c}' AND predicted_class = '{c}') / nullif(count(*) FILTER (true_class = '{c}') + count(*) FILTER (predicted_class = '{c}'), 0), 0)" for c in ("cut", "hold", "hike")
)
_LEFT_F1 = " + ".join(f"coalesce(2.0::DOUBLE * count(*) FILTER (t = '{c}' AND c = '{c}') / nullif(count(*) FILTER (t = '{c}') + count(*) FILTER (c = '{c}'), 0), 0)" for c in ("cut", "hold", "hike"))

ORACLES: dict[str, str] = {
    "jsonl_scan": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation",
    "zip_lines_scan": "SELECT 2 * (row_number() OVER (ORDER BY n_nationkey) - 1) AS line_no, n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    "zip_csv_scan": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS line_no, n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation",
    "csv_round_trip": """SELECT c_nationkey::VARCHAR AS c_nationkey, '["' || string_agg(c_mktsegment, '","' ORDER BY c_mktsegment) || '"]' AS segments, sum(k)::BIGINT::VARCHAR AS n
        FROM (SELECT c_nationkey, c_mktsegment, count(*) AS k FROM customer GROUP BY ALL) GROUP BY c_nationkey""",
    "config_scan": "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region",
    "record_scan": "SELECT 'region_' || r_regionkey AS record_id, r_name AS name, length(r_name) AS length FROM region",
    "staged_inputs": "SELECT * FROM (VALUES ('nation.csv', 'outer.zip!inner.zip!deep/nation.csv', true), ('nation.jsonl', 'sub/copy.jsonl', true)) t(name, place, whole)",
    "input_verification": "SELECT * FROM (VALUES ('changed.csv', 'sha256 differs'), ('lost.csv', 'missing'), ('outer.zip', 'unsafe: ../escape')) t(name, problem)",
    "run_discovery": "SELECT 'run_' || r_regionkey AS run, (1 + r_regionkey % 2)::BIGINT AS files, if(r_regionkey % 2 = 0, 'records.json', '') AS missing FROM region",
    "output_manifest": """SELECT 'inputs' AS side, r_regionkey || '.txt' AS path, sha256(r_name) AS sha256 FROM region
        UNION ALL SELECT 'outputs', 'sub/' || r_regionkey || '.txt', sha256(lower(r_name)) FROM region""",
    "calendar_lookup": "SELECT o_orderkey, if(dayofweek(o_orderdate::DATE) IN (1, 4), 'https://example.org/' || strftime(o_orderdate::DATE, '%Y%m%d'), NULL) AS decision_url FROM orders",
    "annotation_columns": """WITH d AS (SELECT doc_id, 'T-' || substr(sha256('salt|' || doc_id), 1, 12) AS item_id, doc_id % 7 <> 0 AS kept, (doc_id % 3 - 1)::INT AS a, ((doc_id % 3 + 1) % 3 - 1)::INT AS b FROM documents)
        SELECT doc_id, item_id, if(kept, a, NULL) AS demand_score, if(kept AND a <> 0, 'demand ' || doc_id, NULL) AS demand_evidence, if(kept AND a = 0, 'not named', NULL) AS demand_zero_reason, if(kept AND doc_id % 5 = 0, 'see file', NULL) AS demand_note,
               if(kept, b, NULL) AS prices_score, if(kept AND b <> 0, 'prices ' || doc_id, NULL) AS prices_evidence, if(kept AND b = 0, 'not named', NULL) AS prices_zero_reason, if(kept AND doc_id % 5 = 0, 'see file', NULL) AS prices_note FROM d""",
    "prepared_records": """SELECT doc_id, CASE doc_id % 13 WHEN 1 THEN 'text_differs' WHEN 2 THEN 'no_feature' WHEN 3 THEN 'no_target' WHEN 4 THEN 'label_differs' WHEN 5 THEN 'not_after_origin' WHEN 6 THEN 'repeated' END AS problem FROM documents""",
    "aligned_rows": """SELECT doc_id AS position, doc_id AS left_doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id + 1 END AS right_doc_id FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0""",
    "record_checks": """SELECT doc_id, CASE doc_id % 11 WHEN 1 THEN 'no_record' WHEN 2 THEN 'differs:index' WHEN 3 THEN 'no_source' WHEN 4 THEN 'differs:text_sha256' END AS problem FROM documents""",
    "prediction_sources": f"WITH {_PREDICTIONS} SELECT series, i, arm, 'differs:true_bp' AS problem FROM predictions WHERE i % 9 = 0 AND arm = 'shrunk'",
    "label_alignment": f"""WITH {_LABELS} SELECT doc_id, split, CASE WHEN doc_id % 6 = 0 OR doc_id % 10 = 1 THEN NULL ELSE first END AS first, CASE WHEN doc_id % 6 = 0 OR doc_id % 4 = 1 THEN NULL ELSE second END AS second,
        doc_id % 6 <> 0 AND doc_id % 8 <> 0 AND doc_id % 10 <> 1 AS aligned FROM axis_labels""",
    "embedding_cache": """SELECT doc_id AS position, 'd' || doc_id AS origin_id, CASE WHEN vec_id IS NULL THEN 'no_vector' ELSE CASE doc_id % 12 WHEN 1 THEN 'no_vector' WHEN 2 THEN 'out_of_order' WHEN 3 THEN 'hash_differs' WHEN 4 THEN 'wrong_length' WHEN 5 THEN 'not_finite' END END AS problem
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "embedding_sink": """WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(translate(text, 'İI', 'iı')), '[a-zçğıöşü]{2,}')) AS token FROM documents),
        sums AS (SELECT doc_id, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 64 AS bucket, sum(if(('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 1, 1, -1)) AS s FROM tokens GROUP BY ALL)
        SELECT 'd' || doc_id AS origin_id, count(*) FILTER (s <> 0) AS filled, 'hash' AS backend, true AS exact_match FROM documents LEFT JOIN sums USING (doc_id) GROUP BY doc_id""",
    "backend_sizes": "SELECT 'stored' AS backend, len(embedding)::INT AS width, count(*) AS n FROM embeddings GROUP BY ALL UNION ALL SELECT 'hash', 64, count(*) FROM documents",
    "chunk_pooling": """WITH ids AS (SELECT doc_id, list_transform(regexp_extract_all(lower(translate(text, 'İI', 'iı')), '[a-zçğıöşü]{2,}'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT) AS ids FROM documents),
        chunks AS (SELECT doc_id, start, ids[start + 1 : start + 62] AS c FROM (SELECT doc_id, ids, unnest(range(0, len(ids), 54)) AS start FROM ids WHERE len(ids) > 0)),
        means AS (SELECT doc_id, start, pos, list_sum(list_transform(c, lambda x: (x // (10 ** pos)::BIGINT) % 10)) / len(c)::DOUBLE AS m FROM chunks, range(4) p(pos)),
        pooled AS (SELECT doc_id, pos, avg(m) AS x FROM means GROUP BY ALL)
        SELECT doc_id, pos::INT AS pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-15), 9) AS value FROM pooled""",
    "bundle_check": """SELECT 'records/' || doc_id || '.json' AS path, CASE doc_id % 14 WHEN 1 THEN 'unexpected' WHEN 2 THEN 'differs' ELSE 'missing' END AS problem FROM documents WHERE doc_id % 14 IN (1, 2, 3)""",
    "envelope_checks": "SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'sha differs' WHEN 2 THEN 'task differs' WHEN 3 THEN 'not an envelope' WHEN 4 THEN 'not an envelope' END AS error FROM documents",
    "run_completeness": """SELECT 'missing' AS rule, count(*) FILTER (doc_id % 15 = 1) AS violations FROM documents UNION ALL SELECT 'unexpected', count(*) FILTER (doc_id % 15 = 4) FROM documents
        UNION ALL SELECT 'repeated', count(*) FILTER (doc_id % 15 = 3) FROM documents UNION ALL SELECT 'runs_beyond_one', (count(*) FILTER (doc_id % 30 = 4) > 0)::BIGINT FROM documents
        UNION ALL SELECT 'target_changes', count(*) FILTER (doc_id % 15 = 2) FROM documents""",
    "blind_separation": """SELECT 'only_blind' AS rule, count(*) FILTER (doc_id % 16 = 1) AS violations FROM documents UNION ALL SELECT 'only_private', count(*) FILTER (doc_id % 16 = 2) FROM documents
        UNION ALL SELECT 'split_differs', count(*) FILTER (doc_id % 16 = 3) FROM documents UNION ALL SELECT 'secret_column', 1""",
    "stored_hash_check": "SELECT doc_id, sha256(text) AS computed, sha256(text || ' ') AS stored FROM documents WHERE doc_id % 9 = 1",
    "training_intersection": f"WITH {_ORIGINS} SELECT p.series, p.fold, count(*) AS shared, max(p.j) AS latest FROM pairs p WHERE p.j >= 80 GROUP BY ALL",
    "agreement_table": f"""WITH {_LABELS}, p AS (SELECT split, first AS a, first_repeat AS b, first IS NOT NULL AND first_repeat IS NOT NULL AS t FROM axis_labels)
        SELECT split, count(*) AS documents, count(*) FILTER (t) AS paired_n, count(*) FILTER (t AND a = b) AS agree, count(*) FILTER (t AND a <> b) AS disagree,
          count(*) FILTER (t AND a = -1) AS first_negative, count(*) FILTER (t AND a = 0) AS first_neutral, count(*) FILTER (t AND a = 1) AS first_positive,
          count(*) FILTER (t AND b = -1) AS second_negative, count(*) FILTER (t AND b = 0) AS second_neutral, count(*) FILTER (t AND b = 1) AS second_positive FROM p GROUP BY split""",
    "first_object_parse": f"""WITH {_ANSWERS} SELECT doc_id, if(broken, NULL, (doc_id % 3 - 1)::INT) AS demand, if(broken, NULL, 1) AS prices, if(broken, NULL, strict) AS strict FROM answers""",
    "strict_counts": f"WITH {_ANSWERS} SELECT family, count(*) AS answers, count(*) FILTER (NOT broken) AS valid, count(*) FILTER (NOT broken AND strict) AS strict FROM answers GROUP BY family",
    "probability_checks": f"""WITH {_PREDICTIONS} SELECT series, i, arm FROM predictions WHERE i % 10 IN (1, 2, 3)""",
    "named_reference_contrasts": f"""WITH {_POSITIONS}, {_draws(100)}, long AS (
          SELECT idx, seed, axis, predicted, 'full' AS reference, truth FROM seeded JOIN positions USING (doc_id)
          UNION ALL SELECT idx, seed, s.axis, predicted, 'common', truth FROM seeded s JOIN positions USING (doc_id) JOIN axis_labels a USING (doc_id) WHERE a.first IS NOT NULL AND a.first = a.first_repeat),
        per AS (SELECT reference, rep, seed, axis, ({_drawn_f1()}) / 3.0::DOUBLE AS f FROM long JOIN draws USING (idx) WHERE truth IS NOT NULL GROUP BY ALL),
        runs AS (SELECT reference, rep, seed, avg(f) AS f FROM per GROUP BY ALL),
        pairs(contrast, a, b) AS (VALUES ('tuning', 1, 0), ('retuning', 2, 1), ('both', 2, 0)),
        diffs AS (SELECT x.reference, contrast, x.f - y.f AS d FROM pairs JOIN runs x ON x.seed = a JOIN runs y ON y.seed = b AND y.rep = x.rep AND y.reference = x.reference)
        SELECT reference, contrast, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high FROM diffs GROUP BY ALL""",
    "masked_bootstrap_all": f"""WITH {_POSITIONS}, {_draws(200)},
        per AS (SELECT rep, seed, axis, ({_drawn_f1()}) / 3.0::DOUBLE AS f FROM seeded JOIN positions USING (doc_id) JOIN draws USING (idx) WHERE truth IS NOT NULL GROUP BY ALL),
        family AS (SELECT rep, avg(f) FILTER (seed > 0) - avg(f) FILTER (seed = 0) AS d FROM per GROUP BY rep)
        SELECT 'tuned_effect' AS contrast, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high FROM family""",
    "seeded_bootstrap": f"""WITH {_PAIRED}, {_reps(_HASHED, "'base_rate', 'persistence', 'reversal', 'shrunk'")},
        long AS (SELECT a.series, a.arm, unnest([{{'metric': 'macro_f1', 'd': a.macro_f1 - b.macro_f1}}, {{'metric': 'mae_bp', 'd': a.mae_bp - b.mae_bp}}], recursive := true)
          FROM reps a JOIN reps b ON b.series = a.series AND b.rep = a.rep AND b.arm = 'persistence' WHERE a.arm <> 'persistence')
        SELECT series, arm, metric, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high FROM long GROUP BY ALL""",
    "direct_contrast": f"""WITH {_PAIRED}, {_reps(_ARITHMETIC, "'shrunk', 'reversal'")},
        long AS (SELECT a.series, unnest([{{'metric': 'macro_f1', 'd': a.macro_f1 - b.macro_f1}}, {{'metric': 'mae_bp', 'd': a.mae_bp - b.mae_bp}}], recursive := true)
          FROM reps a JOIN reps b ON b.series = a.series AND b.rep = a.rep AND b.arm = 'reversal' WHERE a.arm = 'shrunk'),
        bounds AS (SELECT series, metric, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM long GROUP BY ALL),
        whole AS (SELECT series, arm, ({_F1}) / 3.0::DOUBLE AS f, avg(abs(true_bp - predicted_bp)) AS e FROM predictions GROUP BY ALL),
        full_ AS (SELECT a.series, unnest([{{'metric': 'macro_f1', 'difference': a.f - b.f}}, {{'metric': 'mae_bp', 'difference': a.e - b.e}}], recursive := true) FROM whole a JOIN whole b ON b.series = a.series AND b.arm = 'reversal' WHERE a.arm = 'shrunk'),
        t AS (SELECT p.series, count(*) FILTER (r.predicted_class = r.true_class AND p.predicted_class <> p.true_class) AS b, count(*) FILTER (r.predicted_class <> r.true_class AND p.predicted_class = p.true_class) AS c
          FROM predictions p JOIN predictions r ON r.series = p.series AND r.i = p.i AND r.arm = 'reversal' WHERE p.arm = 'shrunk' GROUP BY ALL)
        SELECT series, metric, round(difference, 9) AS difference, round(low, 9) AS low, round(high, 9) AS high, b, c,
          round(CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda k: exp(lgamma(b + c + 1.0) - lgamma(k + 1.0) - lgamma(b + c - k + 1.0) + (b + c) * ln(0.5))))) END, 9) AS p_value
        FROM full_ JOIN bounds USING (series, metric) JOIN t USING (series)""",
    "influence_summary": f"""WITH {_PREDICTIONS}, held AS (SELECT p.series, p.arm, p.i, q.true_class AS t, q.predicted_class AS c, abs(q.true_bp - q.predicted_bp) AS e FROM predictions p JOIN predictions q ON q.series = p.series AND q.arm = p.arm AND q.i <> p.i),
        left_out AS (SELECT series, arm, i, ({_LEFT_F1}) / 3.0::DOUBLE AS f, avg(e) AS e FROM held GROUP BY ALL),
        whole AS (SELECT series, arm, ({_F1}) / 3.0::DOUBLE AS f, avg(abs(true_bp - predicted_bp)) AS e FROM predictions GROUP BY ALL),
        long AS (SELECT l.series, l.arm, unnest([{{'metric': 'macro_f1', 'x': l.f, 'w': w.f}}, {{'metric': 'mae_bp', 'x': l.e, 'w': w.e}}], recursive := true) FROM left_out l JOIN whole w USING (series, arm))
        SELECT series, arm, metric, round(max(w), 9) AS "full", round(min(x), 9) AS low, round(max(x), 9) AS high, round(max(abs(x - w)), 9) AS max_abs_change FROM long GROUP BY ALL""",
    "seeded_shuffle": f"SELECT position::BIGINT AS position, n_name FROM nation JOIN (VALUES {_shuffled(25, 20260923)}) v(position, item) ON item = n_nationkey",
    "packet_items": """SELECT 'B-' || substr(sha256('20260923:' || n_name), 1, 12) AS item_id, '\\u003c/script>' || n_name AS embedded, true AS reads_back, 1 AS ends FROM nation""",
}
