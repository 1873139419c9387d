"""DuckDB SQL for the catalogue's queries, written on its own: it shares no expression with the plans."""

from __future__ import annotations

_ORIGINS = """
origins AS (
  SELECT series, row_number() OVER w - 1 AS i, series || '-' || bucket AS origin_id, bucket, rate,
         CAST(floor((rate - lag(rate) OVER w) * 100 + 0.5) AS BIGINT) AS change_bp
  FROM (SELECT event_type AS series, epoch_us(ts) // 21600000000 AS bucket,
               CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) / (count(*) * 100.0::DOUBLE) AS rate
        FROM events GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY series ORDER BY bucket)
),
dataset AS (
  SELECT *, lead(change_bp) OVER w AS action_bp,
         CASE WHEN lead(change_bp) OVER w < -300 THEN 'cut' WHEN lead(change_bp) OVER w > 300 THEN 'hike' WHEN lead(change_bp) OVER w IS NOT NULL THEN 'hold' END AS direction,
         lead(bucket) OVER w + i % 3 AS target_pub,
         CASE WHEN lead(bucket) OVER w IS NULL THEN 'unobserved' ELSE 'observed' END AS label_status
  FROM origins WINDOW w AS (PARTITION BY series ORDER BY bucket)
),
data AS (SELECT * FROM dataset WHERE label_status = 'observed'),
folds AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY i) AS fold, i, bucket FROM data WHERE i >= 80),
pairs AS (SELECT f.series, f.fold, f.i, d.i AS j FROM folds f JOIN data d ON d.series = f.series AND d.i < f.i AND d.target_pub <= f.bucket)
"""

_PREDICTIONS = (
    _ORIGINS
    + """,
known AS (
  SELECT f.series, f.fold, f.i, f.bucket, d.action_bp, d.direction AS true_class, d.change_bp, count(t.i) AS n,
         count(*) FILTER (t.direction = 'cut') AS n_cut, count(*) FILTER (t.direction = 'hold') AS n_hold, count(*) FILTER (t.direction = 'hike') AS n_hike,
         CAST(sum(t.action_bp) AS BIGINT) AS total_bp
  FROM folds f JOIN data d USING (series, i) LEFT JOIN pairs p ON p.series = f.series AND p.fold = f.fold LEFT JOIN data t ON t.series = p.series AND t.i = p.j
  GROUP BY ALL
),
arms AS (
  SELECT *, CASE WHEN change_bp < -300 THEN 'cut' WHEN change_bp > 300 THEN 'hike' ELSE 'hold' END AS now_class,
         CASE WHEN -change_bp < -300 THEN 'cut' WHEN -change_bp > 300 THEN 'hike' ELSE 'hold' END AS back_class,
         (n_cut + 1.0::DOUBLE) / (n + 3.0::DOUBLE) AS b0, (n_hold + 1.0::DOUBLE) / (n + 3.0::DOUBLE) AS b1, (n_hike + 1.0::DOUBLE) / (n + 3.0::DOUBLE) AS b2, total_bp / n::DOUBLE AS mean_bp
  FROM known
),
raw_predictions AS (
  SELECT series, fold, i, bucket, true_class, action_bp AS true_bp, 'base_rate' AS arm, b0 AS p_cut, b1 AS p_hold, b2 AS p_hike, mean_bp AS predicted_bp FROM arms
  UNION ALL
  SELECT series, fold, i, bucket, true_class, action_bp, 'persistence', if(now_class = 'cut', 0.6::DOUBLE, 0.2::DOUBLE), if(now_class = 'hold', 0.6::DOUBLE, 0.2::DOUBLE), if(now_class = 'hike', 0.6::DOUBLE, 0.2::DOUBLE), change_bp * 1.0::DOUBLE FROM arms
  UNION ALL
  SELECT series, fold, i, bucket, true_class, action_bp, 'reversal', if(back_class = 'cut', 0.5::DOUBLE, 0.25::DOUBLE), if(back_class = 'hold', 0.5::DOUBLE, 0.25::DOUBLE), if(back_class = 'hike', 0.5::DOUBLE, 0.25::DOUBLE), change_bp * -1.0::DOUBLE FROM arms
  UNION ALL
  SELECT series, fold, i, bucket, true_class, action_bp, 'shrunk', (b0 + if(now_class = 'cut', 0.6::DOUBLE, 0.2::DOUBLE)) / 2.0::DOUBLE, (b1 + if(now_class = 'hold', 0.6::DOUBLE, 0.2::DOUBLE)) / 2.0::DOUBLE,
         (b2 + if(now_class = 'hike', 0.6::DOUBLE, 0.2::DOUBLE)) / 2.0::DOUBLE, (mean_bp + change_bp) / 2.0::DOUBLE FROM arms
),
predictions AS (
  SELECT *, CASE WHEN p_hold >= p_cut AND p_hold >= p_hike THEN 'hold' WHEN p_cut >= p_hike THEN 'cut' ELSE 'hike' END AS predicted_class FROM raw_predictions
)
"""
)


def _metrics(source: str, by: str, extra: str = "") -> str:
    """Metrics of predictions, by group, from one pass of counts."""
    f1 = " + ".join(
        f"CASE WHEN count(*) FILTER (true_class = '{c}') + count(*) FILTER (predicted_class = '{c}') = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * count(*) FILTER (true_class = '{c}' AND predicted_class = '{c}')"
        f" / (count(*) FILTER (true_class = '{c}') + count(*) FILTER (predicted_class = '{c}')) END"
        for c in ("cut", "hold", "hike")
    )
    return f"""SELECT {by}, count(*) AS n, count(*) FILTER (true_class = predicted_class) AS correct,
      round(count(*) FILTER (true_class = predicted_class) / count(*)::DOUBLE, 9) AS accuracy, round(({f1}) / 3.0::DOUBLE, 9) AS macro_f1,
      round(avg(abs(true_bp - predicted_bp)), 9) AS mae_bp,
      round(avg((p_cut - (true_class = 'cut')::INT) ** 2 + (p_hold - (true_class = 'hold')::INT) ** 2 + (p_hike - (true_class = 'hike')::INT) ** 2), 9) AS brier,
      round(avg(-ln(greatest(least(CASE true_class WHEN 'cut' THEN p_cut WHEN 'hold' THEN p_hold ELSE p_hike END, 1.0::DOUBLE), 1e-15::DOUBLE))), 9) AS log_loss,
      count(*) FILTER (true_class = 'cut') AS cut_n, count(*) FILTER (true_class = 'hold') AS hold_n, count(*) FILTER (true_class = 'hike') AS hike_n {extra}
    FROM {source} GROUP BY {by}"""


_LABELS = """
axis_labels AS (
  SELECT doc_id, CASE WHEN doc_id < 80 THEN 'train' WHEN doc_id < 98 THEN 'validation' ELSE 'test' END AS split, first, second,
         CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN -first ELSE first END AS first_repeat
  FROM (SELECT d.doc_id, CASE WHEN quality IS NULL THEN NULL WHEN d.doc_id % 4 = 0 THEN 0 ELSE 2 * quality - 1 END AS first,
               CASE WHEN toxic IS NULL THEN NULL WHEN d.doc_id % 4 = 0 THEN 0 ELSE 2 * toxic - 1 END AS second
        FROM documents d LEFT JOIN labels USING (doc_id))
)
"""

_RUNS = (
    _LABELS
    + """,
seeded AS (
  SELECT split, doc_id, seed, axis, truth, CASE WHEN (doc_id + seed) % 11 = 0 THEN NULL ELSE (doc_id * 7 + seed * 3) % 3 - 1 END AS predicted
  FROM (SELECT split, doc_id, 'first' AS axis, first AS truth FROM axis_labels UNION ALL SELECT split, doc_id, 'second', second FROM axis_labels), (VALUES (0), (1), (2)) s(seed)
)
"""
)


def _masked(where: str) -> str:
    parts = " + ".join(
        f"CASE WHEN count(*) FILTER (truth = {v}) + count(*) FILTER (predicted = {v}) = 0 THEN 0 ELSE 2.0::DOUBLE * count(*) FILTER (truth = {v} AND predicted = {v})"
        f" / (count(*) FILTER (truth = {v}) + count(*) FILTER (predicted = {v})) END"
        for v in (-1, 0, 1)
    )
    return f"""WITH {_RUNS}, per AS (SELECT split, seed, axis, ({parts}) / 3.0::DOUBLE AS f1, count(*) FILTER (truth = predicted) / count(*)::DOUBLE AS acc
      FROM seeded WHERE truth IS NOT NULL {where} GROUP BY ALL),
    seeds AS (SELECT split, seed, avg(f1) AS f1, avg(acc) AS acc FROM per GROUP BY ALL)
    SELECT split, count(*) AS runs, round(avg(f1), 9) AS macro_f1, round(avg(acc), 9) AS accuracy, round(stddev_samp(f1), 9) AS seed_sd FROM seeds GROUP BY split"""


_TOKENS = """
tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(translate(text, 'İI', 'iı')), '[a-zçğıöşü]{2,}')) AS token FROM documents),
counts AS (SELECT doc_id, token, count(*) AS tf FROM tokens GROUP BY ALL)
"""

_DRAWS = """,
sizes AS (SELECT series, max(fold) AS n FROM predictions GROUP BY series),
draws AS (
  SELECT series, rep::INT AS rep, ((rep * 7919 + (pos // 4) * 104729) % n + pos % 4) % n AS idx, count(*) AS times
  FROM sizes, range(200) r(rep), LATERAL (SELECT unnest(range(n)) AS pos) GROUP BY ALL
),
resampled AS (SELECT p.*, d.rep, d.times FROM predictions p JOIN draws d ON d.series = p.series AND d.idx = p.fold - 1)
"""


def _weighted_f1() -> str:
    def total(where: str) -> str:
        return f"coalesce(sum(times) FILTER ({where}), 0)::DOUBLE"

    return " + ".join(
        f"coalesce(2 * {total(f"true_class = '{c}' AND predicted_class = '{c}'")} / nullif({total(f"true_class = '{c}'")} + {total(f"predicted_class = '{c}'")}, 0), 0)" for c in ("cut", "hold", "hike")
    )


def _intervals(benchmark: str, names: tuple[str, str]) -> str:
    return f"""WITH {_PREDICTIONS}{_DRAWS}, reps AS (
      SELECT series, rep, arm, ({_weighted_f1()}) / 3.0::DOUBLE AS macro_f1, sum(abs(true_bp - predicted_bp) * times) / sum(times)::DOUBLE AS mae_bp,
             sum(((p_cut - (true_class = 'cut')::INT) ** 2 + (p_hold - (true_class = 'hold')::INT) ** 2 + (p_hike - (true_class = 'hike')::INT) ** 2) * times) / sum(times)::DOUBLE AS brier,
             sum(-ln(CASE true_class WHEN 'cut' THEN p_cut WHEN 'hold' THEN p_hold ELSE p_hike END) * times) / sum(times)::DOUBLE AS log_loss
      FROM resampled GROUP BY ALL),
    diffs AS (SELECT a.series, a.arm, unnest([{{'metric': '{names[0]}', 'd': a.{names[0]} - b.{names[0]}}}, {{'metric': '{names[1]}', 'd': a.{names[1]} - b.{names[1]}}}], recursive := true)
      FROM reps a JOIN reps b ON b.series = a.series AND b.rep = a.rep AND b.arm = '{benchmark}' WHERE a.arm <> '{benchmark}')
    SELECT series, arm, metric, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high FROM diffs GROUP BY ALL"""


_LOO = (
    _PREDICTIONS
    + """,
held AS (SELECT p.series, p.arm, p.i, q.true_class AS t, q.predicted_class AS c, q.true_bp, q.predicted_bp
         FROM predictions p JOIN predictions q ON q.series = p.series AND q.arm = p.arm AND q.i <> p.i),
loo AS (SELECT series, arm, i, (
"""
    + " + ".join(
        f"coalesce(2.0::DOUBLE * count(*) FILTER (t = '{k}' AND c = '{k}') / nullif(count(*) FILTER (t = '{k}') + count(*) FILTER (c = '{k}'), 0), 0)" for k in ("cut", "hold", "hike")
    )
    + """) / 3.0::DOUBLE AS f, avg(abs(true_bp - predicted_bp)) AS e FROM held GROUP BY ALL)
"""
)

_DISCORDANT = (
    _PREDICTIONS
    + """,
beside AS (SELECT p.*, r.predicted_class AS ref_predicted_class FROM predictions p JOIN predictions r ON r.series = p.series AND r.i = p.i AND r.arm = 'persistence' WHERE p.arm <> 'persistence')
"""
)

_INNER = """
items AS (
  SELECT l_orderkey % 37 AS fold, l_returnflag AS arm, [0.001, 0.01, 0.1, 1.0, 10.0][l_linenumber % 5 + 1]::DOUBLE AS "lambda",
         if(l_linestatus = 'O', 'row_only', 'column_standardized') AS scaling, l_quantity, l_discount, l_tax FROM lineitem
),
sums AS (
  SELECT fold, arm, "lambda", scaling, count(*) AS inner_n, sum(floor(l_quantity * 100 + 0.5)::BIGINT)::BIGINT AS q, sum(floor(l_discount * 100 + 0.5)::BIGINT)::BIGINT AS d, sum(floor(l_tax * 100 + 0.5)::BIGINT)::BIGINT AS t
  FROM items GROUP BY ALL
),
inner_scores AS (SELECT fold, arm, "lambda", scaling, inner_n, q % 4 / 4.0::DOUBLE AS macro_f1, d % 3 / 2.0::DOUBLE AS brier, t % 5 / 3.0::DOUBLE AS log_loss, (q % 7)::DOUBLE AS mae_bp FROM sums),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fold, arm ORDER BY macro_f1 DESC, brier, "lambda" DESC, scaling DESC) AS r1,
         row_number() OVER (PARTITION BY fold, arm ORDER BY mae_bp, "lambda" DESC, scaling DESC) AS r2,
         row_number() OVER (PARTITION BY fold, arm ORDER BY brier, log_loss, "lambda" DESC, scaling DESC) AS r3
  FROM inner_scores WHERE inner_n >= 20
),
chosen AS (
  SELECT fold, arm, 'direction' AS objective, "lambda", scaling, inner_n FROM ranked WHERE r1 = 1
  UNION ALL SELECT fold, arm, 'magnitude', "lambda", scaling, inner_n FROM ranked WHERE r2 = 1
  UNION ALL SELECT fold, arm, 'probability', "lambda", scaling, inner_n FROM ranked WHERE r3 = 1
)
"""

ORACLES: dict[str, str] = {
    "origin_series": f"WITH {_ORIGINS} SELECT * FROM dataset",
    "history_features": f"""WITH {_ORIGINS} SELECT series, i, rate AS rate_now, change_bp / 100.0::DOUBLE AS change_now,
        coalesce(lag(change_bp / 100.0::DOUBLE) OVER w, 0.0::DOUBLE) AS change_before,
        CAST(sum(change_bp) OVER l AS BIGINT) / (100.0::DOUBLE * count(change_bp) OVER l) AS change_mean3,
        coalesce(bucket - lag(bucket) OVER w, 0) AS steps_since, (lag(bucket) OVER w IS NOT NULL)::INT AS has_before
        FROM origins WINDOW w AS (PARTITION BY series ORDER BY bucket), l AS (PARTITION BY series ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "chronological_split": f"""WITH {_ORIGINS} SELECT series, CASE WHEN i < 80 THEN 'train' WHEN i < 98 THEN 'validation' ELSE 'test' END AS split,
        count(*) AS n, min(bucket) AS first, max(bucket) AS last FROM origins GROUP BY 1, 2""",
    "training_sets": f"WITH {_ORIGINS} SELECT * FROM pairs",
    "fold_summary": f"""WITH {_ORIGINS} SELECT f.*, count(d.i) AS n_train, max(d.target_pub) AS latest_target, count(*) FILTER (direction = 'cut') AS n_cut,
        count(*) FILTER (direction = 'hold') AS n_hold, count(*) FILTER (direction = 'hike') AS n_hike, count(DISTINCT direction) = 3 AND count(d.i) >= 40 AS complete
        FROM folds f LEFT JOIN pairs p ON p.series = f.series AND p.fold = f.fold LEFT JOIN data d ON d.series = p.series AND d.i = p.j GROUP BY f.series, f.fold, f.i, f.bucket""",
    "expanding_class_counts": f"""WITH {_ORIGINS} SELECT f.*, count(d.i) AS n, count(*) FILTER (direction = 'cut') AS n_cut, count(*) FILTER (direction = 'hold') AS n_hold,
        count(*) FILTER (direction = 'hike') AS n_hike FROM folds f LEFT JOIN pairs p ON p.series = f.series AND p.fold = f.fold LEFT JOIN data d ON d.series = p.series AND d.i = p.j
        GROUP BY f.series, f.fold, f.i, f.bucket""",
    "leakage_violations": f"""WITH {_ORIGINS}, used AS (SELECT p.*, d.target_pub, d.label_status, f.bucket FROM pairs p JOIN data d ON d.series = p.series AND d.i = p.j JOIN folds f ON f.series = p.series AND f.fold = p.fold)
        SELECT 'future_index' AS rule, count(*) FILTER (j >= i) AS violations FROM used UNION ALL SELECT 'unannounced_target', count(*) FILTER (target_pub > bucket) FROM used
        UNION ALL SELECT 'unobserved_target', count(*) FILTER (label_status <> 'observed') FROM used UNION ALL SELECT 'target_not_after_origin', count(*) FILTER (target_pub <= bucket) FROM data""",
    "market_asof_prev_day": """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, o_totalprice FROM orders),
        last AS (SELECT o_custkey, day, arg_max(o_totalprice, o_orderkey) AS prev_price FROM o GROUP BY ALL)
        SELECT o.o_orderkey, last.prev_price FROM o ASOF LEFT JOIN last ON o.o_custkey = last.o_custkey AND o.day > last.day""",
    "fold_scaled_history": f"""WITH {_ORIGINS}, h AS (SELECT series, i AS j, rate AS rate_now, change_bp / 100.0::DOUBLE AS change_now,
          CAST(sum(change_bp) OVER l AS BIGINT) / (100.0::DOUBLE * count(change_bp) OVER l) AS change_mean3, (lag(bucket) OVER w IS NOT NULL)::INT AS has_before FROM data
          WINDOW w AS (PARTITION BY series ORDER BY bucket), l AS (PARTITION BY series ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
        long AS (SELECT series, j, unnest([{{'c': 'rate_now', 'x': rate_now}}, {{'c': 'change_now', 'x': change_now}}, {{'c': 'change_mean3', 'x': change_mean3}}, {{'c': 'has_before', 'x': has_before::DOUBLE}}], recursive := true) FROM h),
        fit AS (SELECT series, fold, c, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM pairs JOIN long USING (series, j) GROUP BY ALL)
        SELECT f.series, f.fold, fit.c AS "column", round(mean, 9) AS mean, round(sd, 9) AS sd, round((x - mean) / sd, 9) AS query
        FROM folds f JOIN fit USING (series, fold) JOIN long ON long.series = f.series AND long.j = f.i AND long.c = fit.c""",
    "token_counts": f"WITH {_TOKENS} SELECT * FROM counts",
    "document_frequency": f"WITH {_TOKENS} SELECT token, count(*) AS df FROM counts GROUP BY token",
    "hash_embedding_buckets": f"""WITH {_TOKENS}, signed AS (SELECT doc_id, (('0x' || substr(sha256(token), 1, 8))::BIGINT % 64)::INT AS bucket,
          if(('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 1, tf, -tf) AS s FROM counts),
        sums AS (SELECT doc_id, bucket, sum(s)::BIGINT AS s FROM signed GROUP BY ALL HAVING sum(s) <> 0)
        SELECT doc_id, bucket, round(s / sqrt((sum(s * s) OVER (PARTITION BY doc_id))::DOUBLE), 9) AS value FROM sums""",
    "encoder_chunks": """WITH words AS (SELECT doc_id, list_transform(regexp_extract_all(lower(translate(text, 'İI', 'iı')), '[a-zçğıöşü]{2,}'), lambda w: ('0x' || substr(md5(w), 1, 4))::INT) AS ids FROM documents),
        cut AS (SELECT doc_id, unnest(range(0, len(ids), 54)) AS start, ids FROM words WHERE len(ids) > 0),
        chunks AS (SELECT doc_id, start // 54 AS chunk, ids[start + 1 : start + 62] AS c FROM cut)
        SELECT doc_id, chunk, 64::BIGINT AS width, (len(c) + 2)::BIGINT AS held, (list_sum(c) + 203)::BIGINT AS id_sum FROM chunks""",
    "pooled_embeddings": """WITH cells AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
        means AS (SELECT label, pos, avg(x) AS x FROM cells GROUP BY ALL)
        SELECT label, pos::INT AS pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-15), 9) AS value FROM means""",
    "predictions": f"""WITH {_PREDICTIONS} SELECT series, fold, i, bucket, true_class, true_bp, arm, predicted_class, round(p_cut, 9) AS p_cut, round(p_hold, 9) AS p_hold, round(p_hike, 9) AS p_hike,
        round(predicted_bp, 9) AS predicted_bp FROM predictions""",
    "confusion": f"""WITH {_PREDICTIONS}, k(c) AS (VALUES ('cut'), ('hold'), ('hike'))
        SELECT arm, t.c AS true_class, p.c AS predicted_class, count(*) FILTER (true_class = t.c AND predicted_class = p.c) AS n FROM predictions, k t, k p GROUP BY ALL""",
    "arm_metrics": f"WITH {_PREDICTIONS} {_metrics('predictions', 'arm')}",
    "subperiod_metrics": f"""WITH {_PREDICTIONS}, named AS (SELECT * FROM predictions JOIN (VALUES ('early', 0, 78920), ('middle', 78900, 78940), ('late', 78941, 79100), ('all', 0, 1000000000)) v(period, a, b)
        ON bucket BETWEEN a AND b) {_metrics("named", "period, arm", ", min(bucket) AS first, max(bucket) AS last")}""",
    "loo_influence": f"WITH {_LOO} SELECT series, arm, i, round(f, 9) AS macro_f1_without, round(e, 9) AS mae_without FROM loo",
    "loo_range": f"WITH {_LOO} SELECT series, arm, round(min(f), 9) AS low, round(max(f), 9) AS high FROM loo GROUP BY ALL",
    "class_support": f"""WITH {_LABELS}, long AS (SELECT split, 'first' AS axis, first AS v FROM axis_labels UNION ALL SELECT split, 'second', second FROM axis_labels)
        SELECT split, axis, count(*) AS documents, count(*) FILTER (v = -1) AS negative, count(*) FILTER (v = 0) AS neutral, count(*) FILTER (v = 1) AS positive, count(*) - count(v) AS uncertain FROM long GROUP BY ALL""",
    "kappa_by_axis": f"""WITH {_LABELS}, long AS (SELECT split, 'quality' AS axis, first AS a, first_repeat AS b FROM axis_labels UNION ALL SELECT split, 'mixed', first, second FROM axis_labels),
        totals AS (SELECT split, axis, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, count(*) - count(a) AS ua, count(*) - count(b) AS ub FROM long GROUP BY ALL),
        cells AS (SELECT split, axis, a, b, count(*)::DOUBLE AS c FROM long WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
        observed AS (SELECT split, axis, sum(c) FILTER (a = b) AS same, sum(c * abs(a - b)) AS apart FROM cells GROUP BY ALL),
        ra AS (SELECT split, axis, a, sum(c) AS m FROM cells GROUP BY ALL), rb AS (SELECT split, axis, b, sum(c) AS m FROM cells GROUP BY ALL),
        chance AS (SELECT ra.split, ra.axis, sum(ra.m * rb.m) FILTER (a = b) AS same, sum(ra.m * rb.m * abs(a - b)) AS apart FROM ra JOIN rb ON ra.split = rb.split AND ra.axis = rb.axis GROUP BY ALL)
        SELECT t.split, t.axis, n AS paired_n, ua AS uncertain_first, ub AS uncertain_second, round(coalesce(o.same, 0) / nullif(n, 0)::DOUBLE, 9) AS agreement,
          round(CASE WHEN n::DOUBLE * n > coalesce(c.same, 0) THEN (n * coalesce(o.same, 0) - coalesce(c.same, 0)) / (n::DOUBLE * n - coalesce(c.same, 0)) END, 9) AS cohen_kappa,
          round(CASE WHEN c.apart > 0 THEN 1 - n * o.apart / c.apart END, 9) AS linear_weighted_kappa
        FROM totals t LEFT JOIN observed o ON o.split = t.split AND o.axis = t.axis LEFT JOIN chance c ON c.split = t.split AND c.axis = t.axis""",
    "masked_multirun_scores": _masked(""),
    "common_support_scores": _masked("AND doc_id IN (SELECT doc_id FROM axis_labels WHERE first IS NOT NULL AND second IS NOT NULL)"),
    "choose_class_ties": """SELECT a.v AS p_cut, b.v AS p_hold, c.v AS p_hike, arg_max(label, row(p, priority)) AS chosen
        FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) a(v), (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) b(v), (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) c(v),
        LATERAL (VALUES ('hold', b.v, 2), ('cut', a.v, 1), ('hike', c.v, 0)) k(label, p, priority) GROUP BY ALL""",
    "changed_predictions": f"""WITH {_DISCORDANT} SELECT series, i, arm, true_class, ref_predicted_class, predicted_class, ref_predicted_class = true_class AS ref_correct, predicted_class = true_class AS arm_correct
        FROM beside WHERE predicted_class <> ref_predicted_class""",
    "pairing_errors": f"WITH {_DISCORDANT} SELECT arm, 0::BIGINT AS unmatched, 0::BIGINT AS differing FROM beside GROUP BY arm",
    "mcnemar_holm": f"""WITH {_DISCORDANT}, t AS (SELECT series, arm, count(*) FILTER (ref_predicted_class = true_class AND predicted_class <> true_class) AS b,
          count(*) FILTER (ref_predicted_class <> true_class AND predicted_class = true_class) AS c FROM beside GROUP BY ALL),
        p AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda k: exp(lgamma(b + c + 1.0) - lgamma(k + 1.0) - lgamma(b + c - k + 1.0) + (b + c) * ln(0.5))))) END AS p_value FROM t),
        r AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY round(p_value, 9)) + 1) * p_value) AS step FROM p),
        h AS (SELECT *, max(step) OVER (ORDER BY round(p_value, 9)) AS holm FROM r)
        SELECT series, arm, b, c, round(p_value, 9) AS p_value, round(holm, 9) AS holm_p, holm <= 0.05 AS reject FROM h""",
    "bootstrap_draws": f"WITH {_PREDICTIONS}{_DRAWS} SELECT * FROM draws",
    "block_bootstrap_ci": _intervals("persistence", ("macro_f1", "mae_bp")),
    "probability_selection_delta": _intervals("base_rate", ("brier", "log_loss")),
    "reality_check": f"""WITH {_PREDICTIONS}{_DRAWS}, d AS (SELECT p.series, p.fold - 1 AS idx, p.arm, (r.predicted_class <> r.true_class)::INT - (p.predicted_class <> p.true_class)::INT AS d
          FROM predictions p JOIN predictions r ON r.series = p.series AND r.i = p.i AND r.arm = 'persistence' WHERE p.arm <> 'persistence'),
        totals AS (SELECT series, arm, count(*) AS n, sum(d)::BIGINT AS total FROM d GROUP BY ALL),
        best AS (SELECT series, max(n) AS n, count(*) AS arms, max(total) AS top FROM totals GROUP BY ALL),
        named AS (SELECT t.series, min(arm) AS best_arm FROM totals t JOIN best b ON b.series = t.series AND b.top = t.total GROUP BY ALL),
        reps AS (SELECT series, rep, max(c) AS c FROM (SELECT d.series, w.rep, d.arm, sum(d.d * w.times) - any_value(t.total) AS c FROM d JOIN draws w ON w.series = d.series AND w.idx = d.idx
          JOIN totals t ON t.series = d.series AND t.arm = d.arm GROUP BY ALL) GROUP BY ALL)
        SELECT b.series, b.n, b.arms, best_arm, round(b.top / b.n::DOUBLE, 9) AS best_advantage, round(sqrt(b.n::DOUBLE) * b.top / b.n, 9) AS statistic,
          round((1.0 + count(*) FILTER (c >= b.top)) / (count(*) + 1.0::DOUBLE), 9) AS p_value
        FROM best b JOIN named ON named.series = b.series JOIN reps ON reps.series = b.series GROUP BY b.series, b.n, b.arms, b.top, best_arm""",
    "candidate_selection": f"WITH {_INNER} SELECT * FROM chosen",
    "selection_stability": f"""WITH {_INNER} SELECT arm, objective, "lambda", scaling, selections, round(selections / (sum(selections) OVER (PARTITION BY arm, objective))::DOUBLE, 9) AS share
        FROM (SELECT arm, objective, "lambda", scaling, count(*) AS selections FROM chosen GROUP BY 1, 2, 3, 4)""",
    "unselected_groups": f"WITH {_INNER} SELECT fold, arm, max(inner_n - 30 * fold) AS most FROM inner_scores GROUP BY ALL HAVING max(inner_n - 30 * fold) < 60",
    "ordered_stability": f"""WITH {_INNER}, s AS (SELECT arm, objective, "lambda", scaling, selections, round(selections / (sum(selections) OVER (PARTITION BY arm, objective))::DOUBLE, 9) AS share
        FROM (SELECT arm, objective, "lambda", scaling, count(*) AS selections FROM chosen GROUP BY 1, 2, 3, 4))
        SELECT *, row_number() OVER (ORDER BY arm, objective, "lambda", scaling) - 1 AS position FROM s""",
    "candidate_keys": f"""WITH {_INNER} SELECT DISTINCT arm || '|lambda=' || format('{{:g}}', "lambda") || '|scaling=' || scaling AS candidate, arm, "lambda", scaling, format('{{:g}}', "lambda" * 1234567.0::DOUBLE) AS shown FROM inner_scores""",
    "opaque_ids": f"""WITH {_ORIGINS} SELECT origin_id, 'T-' || substr(sha256('salt|' || origin_id), 1, 12) AS item_id, 'B-' || substr(sha256('20260923:' || origin_id), 1, 12) AS blind_id FROM origins""",
    "duplicate_keys": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    "key_set_difference": """SELECT doc_id, 'left_only' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
        UNION ALL SELECT doc_id, 'right_only' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""",
    "expected_identities": """SELECT line, flag, status FROM (SELECT DISTINCT l_linenumber AS line FROM lineitem), (VALUES ('A'), ('N'), ('R'), ('X')) f(flag), (VALUES ('F'), ('O')) s(status)
        EXCEPT SELECT l_linenumber, l_returnflag, l_linestatus FROM lineitem""",
    "stored_metric_mismatches": """WITH c AS (SELECT l_orderkey AS key, sum(floor(l_quantity * 100 + 0.5)::BIGINT)::BIGINT / 100.0::DOUBLE AS computed FROM lineitem GROUP BY ALL),
        s AS (SELECT o_orderkey AS key, (floor(o_totalprice + 0.5)::BIGINT % 100)::DOUBLE AS stored FROM orders)
        SELECT key, 'amount' AS metric, computed, stored FROM c FULL JOIN s USING (key) WHERE computed IS NULL OR stored IS NULL OR abs(computed - stored) > greatest(1e-9, 1e-9 * greatest(abs(computed), abs(stored)))""",
    "json_extract_validate": """SELECT event_id, try_cast(props ->> '$.k' AS BIGINT) AS k, if(json_keys(props) = ['k'] AND json_type(props, '$.k') IN ('BIGINT', 'UBIGINT'), 'valid', 'invalid_output') AS status FROM events""",
    "status_counts": f"WITH {_LABELS} SELECT split, count(first) AS valid, count(*) - count(first) AS invalid FROM axis_labels GROUP BY split",
    "answer_validation": """SELECT doc_id, CASE WHEN doc_id % 9 IN (1, 2, 3, 4, 5, 6, 7, 8) THEN 'invalid_output' WHEN regexp_extract(text, '[A-Za-z]+') = '' THEN 'invalid_output' ELSE 'valid' END AS status FROM documents""",
    "lookup_joins": """SELECT r_name, n_name, c_mktsegment, count(*) AS n, sum(floor(o_totalprice * 100 + 0.5)::BIGINT)::BIGINT / 100.0::DOUBLE AS total
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "text_hash_check": "SELECT sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1",
    "embedding_checks": """SELECT count(*) AS n, count(*) - count(doc_id) AS unknown, count(*) FILTER (len(embedding) <> 64) AS wrong_length,
        count(*) FILTER (list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))) AS not_finite FROM embeddings LEFT JOIN documents ON doc_id = vec_id""",
    "answer_columns": """SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN '2' WHEN 2 THEN '1.0' WHEN 3 THEN 'true' ELSE '1' END AS demand_score,
        CASE doc_id % 9 WHEN 5 THEN 'not in any text 0123' WHEN 6 THEN ' ' ELSE regexp_extract(text, '[A-Za-z]+') END AS demand_evidence, CASE WHEN doc_id % 9 = 7 THEN NULL ELSE '0' END AS prices_score FROM documents""",
    "union_analyses": f"""WITH {_PREDICTIONS} SELECT 'arm' AS analysis, arm AS name, count(*) AS n, count(*) FILTER (true_class = predicted_class) AS correct FROM predictions GROUP BY arm
        UNION ALL SELECT 'series', series, count(*), count(*) FILTER (true_class = predicted_class) FROM predictions GROUP BY series""",
    "one_hot_rows": f"""WITH {_ORIGINS} SELECT series, i, CASE direction WHEN 'cut' THEN 0 WHEN 'hold' THEN 1 ELSE 2 END AS class_index, (direction = 'cut')::INT AS is_cut, (direction = 'hold')::INT AS is_hold,
        (direction = 'hike')::INT AS is_hike, action_bp / 100.0::DOUBLE AS points FROM data""",
    "label_codes": "SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN NULL ELSE quality * 2 - 1 END AS code FROM labels",
    "numeric_text": "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) THEN NULL ELSE c_custkey + 0.5::DOUBLE END AS x FROM customer",
}
