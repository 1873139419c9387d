"""DuckDB SQL for the queries on features and arms, written on its own."""

from __future__ import annotations

from foldline.plans.oracles import _LABELS, _ORIGINS, _PREDICTIONS, _TOKENS, _metrics

_DEALT = """,
numbered AS (SELECT series, max(i) + 1 AS n, row_number() OVER (ORDER BY series) - 1 AS no FROM data GROUP BY series),
dealt AS (
  SELECT doc_id, series, ('0x' || substr(md5(doc_id::VARCHAR), 13, 12))::BIGINT % n AS i
  FROM (SELECT DISTINCT doc_id FROM documents) d JOIN numbered ON no = ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 12))::BIGINT % (SELECT count(*) FROM numbered)
)
"""

_SCORED = (
    _ORIGINS
    + ","
    + _LABELS
    + _DEALT
    + """,
scores AS (SELECT series, i, avg(first) AS first, avg(second) AS second, avg(first_repeat) AS first_repeat FROM axis_labels JOIN dealt USING (doc_id) GROUP BY ALL),
cells AS (
  SELECT series, i, unnest([{'c': 'first', 'v': first}, {'c': 'second', 'v': second}, {'c': 'first_repeat', 'v': first_repeat}], recursive := true)
  FROM data LEFT JOIN scores USING (series, i)
),
learned AS (SELECT p.series, fold, c, v FROM pairs p JOIN cells ON cells.series = p.series AND cells.i = p.j),
medians AS (SELECT series, fold, c, coalesce(median(v), 0.0::DOUBLE) AS m FROM learned GROUP BY ALL),
asked AS (SELECT f.series, fold, f.i AS j, c, v FROM folds f JOIN cells ON cells.series = f.series AND cells.i = f.i),
long_train AS (
  SELECT series, fold, c AS "column", coalesce(v, m)::DOUBLE AS x FROM learned JOIN medians USING (series, fold, c)
  UNION ALL SELECT series, fold, 'missing_' || c, (v IS NULL)::INT::DOUBLE FROM learned
),
long_asked AS (
  SELECT series, fold, j, c AS "column", coalesce(v, m)::DOUBLE AS x FROM asked JOIN medians USING (series, fold, c)
  UNION ALL SELECT series, fold, j, 'missing_' || c, (v IS NULL)::INT::DOUBLE FROM asked
),
fit AS (SELECT series, fold, "column", avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM long_train GROUP BY ALL),
imputed AS (SELECT series, fold, j, "column", (x - mean) / sd AS value FROM long_asked JOIN fit USING (series, fold, "column")),
wanted(arm, position, "column") AS (VALUES
  ('axes_all', 0, 'first'), ('axes_all', 1, 'second'), ('axes_all', 2, 'first_repeat'), ('axes_all', 3, 'missing_first'), ('axes_all', 4, 'missing_second'), ('axes_all', 5, 'missing_first_repeat'),
  ('axes_first', 0, 'first'), ('axes_first', 1, 'missing_first'), ('axes_second', 0, 'second'), ('axes_second', 1, 'missing_second'),
  ('axes_third', 0, 'first_repeat'), ('axes_third', 1, 'missing_first_repeat'), ('axes_scores', 0, 'first'), ('axes_scores', 1, 'second'), ('axes_scores', 2, 'first_repeat'),
  ('axes_missing', 0, 'missing_first'), ('axes_missing', 1, 'missing_second'), ('axes_missing', 2, 'missing_first_repeat'))
"""
)

_TEXT = (
    _TOKENS
    + """,
origin_counts AS (SELECT series, i AS j, token, sum(tf)::BIGINT AS tf FROM counts JOIN dealt USING (doc_id) GROUP BY ALL),
vocabulary AS (
  SELECT * FROM (SELECT series, fold, token, count(*) AS df, CAST(row_number() OVER (PARTITION BY series, fold ORDER BY count(*) DESC, token) AS INT) AS rank
                 FROM pairs JOIN origin_counts USING (series, j) GROUP BY series, fold, token HAVING count(*) >= 3) WHERE rank <= 50
),
fold_sizes AS (SELECT series, fold, count(*) AS n FROM pairs GROUP BY ALL),
raw_weights AS (
  SELECT series, fold, f.i AS j, token, rank, (1 + ln(tf::DOUBLE)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w
  FROM folds f JOIN origin_counts c USING (series) JOIN vocabulary USING (series, fold, token) JOIN fold_sizes USING (series, fold) WHERE c.j = f.i
),
weights AS (SELECT series, fold, j, token, rank, w / sqrt(sum(w * w) OVER (PARTITION BY series, fold)) AS weight FROM raw_weights)
"""
)

_MARKET_FIELDS = ("spread_month", "rate_buying", "rate_selling", "view_now", "view_year_end", "view_ahead", "spread_day")


def _digits(first: int, n: int) -> str:
    return f"('0x' || substr(md5(origin_id), {first}, 12))::BIGINT % {n}"


_MARKET = (
    """,
sums AS (SELECT o_orderkey % 97 AS place, sum(floor(o_totalprice)::BIGINT)::BIGINT + 31 * sum(date_diff('day', DATE '1990-01-01', o_orderdate::DATE))::BIGINT AS number FROM orders GROUP BY ALL),
proxy AS (SELECT origin_id, """
    + ", ".join(f"CASE WHEN {_digits(k + 9, 7)} <> 0 THEN ((coalesce(number, 0) + {_digits(k + 2, 1000)}) % {100 + 10 * k}) + 0.5::DOUBLE END AS {f}" for k, f in enumerate(_MARKET_FIELDS))
    + f""" FROM origins LEFT JOIN sums ON place = {_digits(1, 97)})
"""
)

_PARTS = (
    _SCORED
    + ","
    + _TEXT
    + """,
h AS (SELECT series, i AS j, [rate, change_bp / 100.0::DOUBLE, coalesce(lag(change_bp / 100.0::DOUBLE) OVER w, 0.0::DOUBLE),
        CAST(sum(change_bp) OVER l AS BIGINT) / (100.0::DOUBLE * count(change_bp) OVER l), coalesce(bucket - lag(bucket) OVER w, 0)::DOUBLE, (lag(bucket) OVER w IS NOT NULL)::INT::DOUBLE] AS v FROM data
      WINDOW w AS (PARTITION BY series ORDER BY bucket), l AS (PARTITION BY series ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
history_long AS (SELECT series, j, generate_subscripts(v, 1) - 1 AS position, unnest(v) AS x FROM h),
history_median AS (SELECT p.series, p.fold, position, coalesce(median(x), 0.0::DOUBLE) AS m FROM pairs p JOIN history_long l ON l.series = p.series AND l.j = p.j GROUP BY ALL),
history_fit AS (SELECT p.series, p.fold, l.position, avg(coalesce(x, m)) AS mean, CASE WHEN stddev_pop(coalesce(x, m)) = 0 THEN 1 ELSE stddev_pop(coalesce(x, m)) END AS sd
                FROM pairs p JOIN history_long l ON l.series = p.series AND l.j = p.j JOIN history_median k ON k.series = p.series AND k.fold = p.fold AND k.position = l.position GROUP BY ALL),
history_part AS (SELECT f.series, f.fold, l.position, (coalesce(x, m) - mean) / sd AS value FROM folds f JOIN history_long l ON l.series = f.series AND l.j = f.i
                 JOIN history_fit t ON t.series = f.series AND t.fold = f.fold AND t.position = l.position JOIN history_median k ON k.series = f.series AND k.fold = f.fold AND k.position = l.position),
axes_part AS (SELECT series, fold, arm, position, value FROM imputed JOIN wanted USING ("column")),
tfidf_part AS (SELECT f.series, f.fold, r - 1 AS position, coalesce(weight, 0.0::DOUBLE) AS value
               FROM folds f JOIN (SELECT series, fold, max(rank) AS width FROM vocabulary GROUP BY ALL) v USING (series, fold), LATERAL (SELECT unnest(range(1, width + 1)) AS r) LEFT JOIN weights w
               ON w.series = f.series AND w.fold = f.fold AND w.rank = r),
vector_cells AS (SELECT series, i, generate_subscripts(embedding, 1) - 1 AS position, unnest(embedding)::DOUBLE AS x FROM embeddings JOIN dealt ON doc_id = vec_id),
vector_means AS (SELECT series, i, position, avg(x) AS x FROM vector_cells GROUP BY ALL),
vector_units AS (SELECT series, i, position, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY series, i)), 1e-15) AS x FROM vector_means),
vectors AS (SELECT d.series, d.i, p AS position, coalesce(x, 0.0::DOUBLE) AS x FROM data d CROSS JOIN range(64) r(p) LEFT JOIN vector_units u ON u.series = d.series AND u.i = d.i AND u.position = p),
vector_fit AS (SELECT p.series, p.fold, position, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM pairs p JOIN vectors v ON v.series = p.series AND v.i = p.j GROUP BY ALL),
encoder_part AS (SELECT f.series, f.fold, v.position, (x - mean) / sd AS value FROM folds f JOIN vectors v ON v.series = f.series AND v.i = f.i
                 JOIN vector_fit t ON t.series = f.series AND t.fold = f.fold AND t.position = v.position),
parts AS (
  SELECT series, fold, 'tfidf' AS part, position, value FROM tfidf_part UNION ALL SELECT series, fold, 'encoder', position, value FROM encoder_part
  UNION ALL SELECT series, fold, arm, position, value FROM axes_part
),
arm_list(arm, arm_no, part) AS (VALUES ('history_tfidf', 1, 'tfidf'), ('history_encoder', 2, 'encoder'), ('history_axes_all', 3, 'axes_all'), ('history_axes_first', 4, 'axes_first'),
  ('history_axes_second', 5, 'axes_second'), ('history_axes_third', 6, 'axes_third'), ('history_axes_scores', 7, 'axes_scores'), ('history_axes_missing', 8, 'axes_missing')),
designs AS (
  SELECT series, fold, 'history' AS arm, 0 AS arm_no, position, value FROM history_part
  UNION ALL SELECT series, fold, arm, arm_no, position, value FROM history_part, arm_list
  UNION ALL SELECT series, fold, arm, arm_no, position + 6, value FROM parts JOIN arm_list USING (part)
)
"""
)

ORACLES: dict[str, str] = {
    "panel_imputed_scores": f'WITH {_SCORED} SELECT series, fold, j, "column", round(value, 9) AS value FROM imputed',
    "panel_missing_only": f"WITH {_SCORED} SELECT series, fold, j, \"column\", round(value, 9) AS value FROM imputed WHERE \"column\" LIKE 'missing_%'",
    "ablation_designs": f'WITH {_SCORED} SELECT series, fold, arm, position, round(value, 9) AS value FROM imputed JOIN wanted USING ("column")',
    "panel_vocabulary": f"WITH {_ORIGINS} {_DEALT}, {_TEXT} SELECT * FROM vocabulary",
    "panel_tfidf": f"WITH {_ORIGINS} {_DEALT}, {_TEXT} SELECT series, fold, j, token, round(weight, 9) AS weight FROM weights",
    "market_proxy": f"WITH {_ORIGINS} {_MARKET} SELECT series, i, {', '.join(_MARKET_FIELDS)} FROM data JOIN proxy USING (origin_id)",
    "market_violations": f"""WITH {_ORIGINS}, kinds AS (SELECT origin_id, ('0x' || substr(md5(origin_id), 3, 12))::BIGINT % 11 AS kind, label_status FROM dataset)
        SELECT 'repeated_key' AS rule, count(*) FILTER (kind = 3) AS violations FROM kinds UNION ALL SELECT 'missing_key', count(*) FILTER (kind = 0 AND label_status = 'observed') FROM kinds
        UNION ALL SELECT 'monthly_rule', 0 UNION ALL SELECT 'daily_rule', count(*) FILTER (kind = 1) FROM kinds UNION ALL SELECT 'not_a_number', count(*) FILTER (kind = 2) FROM kinds""",
    "arm_designs": f"WITH {_PARTS} SELECT series, fold, arm, arm_no::INT AS arm_no, position::INT AS position, round(value, 9) AS value FROM designs",
    "nested_designs": f"""WITH {_PARTS} {_MARKET},
        market_cells AS (SELECT series, i, unnest([{", ".join(f"{{'c': '{f}', 'v': {f}}}" for f in _MARKET_FIELDS)}], recursive := true) FROM data JOIN proxy USING (origin_id)),
        market_median AS (SELECT p.series, p.fold, c, coalesce(median(v), 0.0::DOUBLE) AS m FROM pairs p JOIN market_cells k ON k.series = p.series AND k.i = p.j GROUP BY ALL),
        market_long AS (SELECT k.series, m.fold, k.i, c, coalesce(v, m) AS x FROM market_cells k JOIN market_median m USING (series, c)
          UNION ALL SELECT k.series, m.fold, k.i, 'missing_' || c, (v IS NULL)::INT::DOUBLE FROM market_cells k JOIN market_median m USING (series, c)),
        market_fit AS (SELECT p.series, p.fold, l.c, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd
          FROM pairs p JOIN market_long l ON l.series = p.series AND l.fold = p.fold AND l.i = p.j GROUP BY ALL),
        market_sum AS (SELECT f.series, f.fold, sum((x - mean) / sd) AS s FROM folds f JOIN market_long l ON l.series = f.series AND l.fold = f.fold AND l.i = f.i
          JOIN market_fit t ON t.series = f.series AND t.fold = f.fold AND t.c = l.c GROUP BY ALL),
        all_raw AS (SELECT p.series, p.fold, p.j, c.token, (1 + ln(tf::DOUBLE)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w
          FROM pairs p JOIN origin_counts c ON c.series = p.series AND c.j = p.j JOIN vocabulary v ON v.series = p.series AND v.fold = p.fold AND v.token = c.token
          JOIN fold_sizes s ON s.series = p.series AND s.fold = p.fold),
        all_weights AS (SELECT series, fold, j, token, w / sqrt(sum(w * w) OVER (PARTITION BY series, fold, j)) AS weight FROM all_raw),
        tfidf_train AS (SELECT series, fold, sum(weight) AS s FROM all_weights GROUP BY ALL),
        token_rows AS (SELECT p.series, p.fold, p.j, v.token, v.rank, coalesce(a.weight, 0.0::DOUBLE) AS x FROM pairs p JOIN vocabulary v ON v.series = p.series AND v.fold = p.fold
          LEFT JOIN all_weights a ON a.series = p.series AND a.fold = p.fold AND a.j = p.j AND a.token = v.token),
        token_fit AS (SELECT series, fold, token, rank, avg(x) AS mean, stddev_pop(x) AS sd FROM token_rows GROUP BY ALL),
        scaled_sum AS (SELECT t.series, t.fold, sum((coalesce(weight, 0) - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END) AS s FROM token_fit t LEFT JOIN weights w ON w.series = t.series AND w.fold = t.fold AND w.rank = t.rank GROUP BY ALL),
        design_sums AS (
          SELECT series, fold, arm, 'fixed' AS scaling, count(*) AS width, sum(value) AS query_sum, 0.0::DOUBLE AS train_sum FROM designs WHERE arm <> 'history_tfidf' GROUP BY ALL
          UNION ALL SELECT series, fold, arm, 'row_only', count(*), sum(value), coalesce(any_value(s), 0) FROM designs LEFT JOIN tfidf_train USING (series, fold) WHERE arm = 'history_tfidf' GROUP BY ALL
          UNION ALL SELECT series, fold, 'history_tfidf', 'column_standardized', 6 + (SELECT count(*) FROM vocabulary v WHERE v.series = h.series AND v.fold = h.fold), sum(value) + coalesce(any_value(s), 0), 0
            FROM history_part h LEFT JOIN scaled_sum USING (series, fold) GROUP BY ALL
          UNION ALL SELECT series, fold, 'market', 'fixed', 20, sum(value) + any_value(s), 0 FROM history_part JOIN market_sum USING (series, fold) GROUP BY ALL
        )
        SELECT series, fold, arm, scaling, n + 1 AS n, width::INT AS width, round(query_sum, 6) + 0.0 AS query_sum, round(train_sum, 6) + 0.0 AS train_sum FROM design_sums JOIN fold_sizes USING (series, fold)""",
    "selection_rule_deltas": f"""WITH {_PREDICTIONS},
        earlier AS (SELECT p.*, f.fold AS outer_fold FROM predictions p JOIN data d ON d.series = p.series AND d.i = p.i JOIN folds f ON f.series = p.series AND p.fold < f.fold AND d.target_pub <= f.bucket),
        scores AS ({_metrics("earlier", "series, outer_fold, arm")}),
        picked AS (SELECT series, outer_fold AS fold, arg_max(arm, row(macro_f1, -brier, arm)) AS direction, arg_min(arm, row(brier, log_loss, arm)) AS probability, arg_min(arm, row(mae_bp, arm)) AS magnitude
          FROM scores WHERE n >= 5 GROUP BY ALL),
        rules AS (SELECT series, fold, unnest([{{'rule': 'direction', 'arm': direction}}, {{'rule': 'probability', 'arm': probability}}, {{'rule': 'magnitude', 'arm': magnitude}}], recursive := true) FROM picked),
        chosen AS (SELECT r.series, r.fold, r.rule, (p_cut - (true_class = 'cut')::INT) ** 2 + (p_hold - (true_class = 'hold')::INT) ** 2 + (p_hike - (true_class = 'hike')::INT) ** 2 AS brier,
            -ln(CASE true_class WHEN 'cut' THEN p_cut WHEN 'hold' THEN p_hold ELSE p_hike END) AS log_loss FROM rules r JOIN predictions p ON p.series = r.series AND p.fold = r.fold AND p.arm = r.arm),
        span AS (SELECT series, min(fold) AS first, max(fold) - min(fold) + 1 AS n FROM chosen GROUP BY ALL),
        draws AS (SELECT series, first, rep, ((rep * 7919 + (pos // 4) * 104729) % n + pos % 4) % n AS idx FROM span, range(200) r(rep), LATERAL (SELECT unnest(range(n)) AS pos)),
        reps AS (SELECT d.series, d.rep, c.rule, avg(brier) AS brier, avg(log_loss) AS log_loss FROM draws d JOIN chosen c ON c.series = d.series AND c.fold = d.idx + d.first GROUP BY ALL),
        long AS (SELECT series, rep, rule, unnest([{{'metric': 'brier', 'x': brier}}, {{'metric': 'log_loss', 'x': log_loss}}], recursive := true) FROM reps),
        bounds AS (SELECT a.series, a.rule, a.metric, quantile_cont(a.x - b.x, 0.025) AS low, quantile_cont(a.x - b.x, 0.975) AS high
          FROM long a JOIN long b ON b.series = a.series AND b.rep = a.rep AND b.metric = a.metric AND b.rule = 'direction' WHERE a.rule <> 'direction' GROUP BY ALL),
        whole AS (SELECT series, rule, unnest([{{'metric': 'brier', 'x': avg(brier)}}, {{'metric': 'log_loss', 'x': avg(log_loss)}}], recursive := true) FROM chosen GROUP BY series, rule)
        SELECT w.series, w.rule, w.metric, round(w.x - b.x, 9) AS delta, round(low, 9) AS low, round(high, 9) AS high FROM whole w JOIN whole b ON b.series = w.series AND b.metric = w.metric AND b.rule = 'direction'
        JOIN bounds ON bounds.series = w.series AND bounds.rule = w.rule AND bounds.metric = w.metric WHERE w.rule <> 'direction'""",
}
