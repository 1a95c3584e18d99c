"""Oracle SQL for the time-series queries."""

from __future__ import annotations

from kasaflow.plans.oracle import MEASURES, sql

_DENSE_COLS = ", ".join(f'CASE WHEN f.data IS NULL THEN 0.0 ELSE f.{m.lower()} END AS "{m}"' for m in MEASURES)
_UNPIVOT_ON = ", ".join(f'"{m}"' for m in MEASURES)

SERIES = f"""
, branches AS (SELECT DISTINCT nazwa_kasy FROM fact)
, grid AS (SELECT b.nazwa_kasy, CAST(g.d AS DATE) AS data
           FROM branches b, span, generate_series(span.lo, span.hi, INTERVAL 1 DAY) AS g(d))
, dense AS (SELECT g.nazwa_kasy, g.data, {_DENSE_COLS}
            FROM grid g LEFT JOIN fact f ON f.nazwa_kasy = g.nazwa_kasy AND f.data = g.data)
, series AS (SELECT nazwa_kasy, measure, data, value
             FROM dense UNPIVOT INCLUDE NULLS (value FOR measure IN ({_UNPIVOT_ON})))
, sdiff AS (SELECT nazwa_kasy, measure, data, value,
                   value - lag(value) OVER (PARTITION BY nazwa_kasy, measure ORDER BY data) AS diff,
                   row_number() OVER (PARTITION BY nazwa_kasy, measure ORDER BY data) AS rn,
                   count(*) OVER (PARTITION BY nazwa_kasy, measure) AS n
            FROM series)
, split AS (SELECT *, CAST(ceil(CAST(0.1 AS DOUBLE) * n) AS BIGINT) AS n_test,
                   CASE WHEN rn > n - CAST(ceil(CAST(0.1 AS DOUBLE) * n) AS BIGINT) THEN 'test' ELSE 'train' END AS split
            FROM sdiff)
, train AS (SELECT nazwa_kasy, measure, data, value,
                   CASE WHEN rn = 1 THEN COALESCE(diff, 0.0) ELSE diff END AS diff
            FROM split WHERE split = 'train')
"""


def ts_sql(name: str, body: str) -> None:
    sql(name, SERIES + body)


ts_sql("series_long", "SELECT nazwa_kasy, measure, data, value FROM series")
ts_sql("series_diff", "SELECT nazwa_kasy, measure, data, value, diff FROM sdiff")
ts_sql("train_test_split", "SELECT nazwa_kasy, measure, data, value, diff, rn, n, n_test, split FROM split")
ts_sql("last_train_value", """SELECT nazwa_kasy, measure, max(data) AS last_date, arg_max(value, data) AS last_value
  FROM split WHERE split = 'train' GROUP BY 1, 2""")
ts_sql("train_series", "SELECT nazwa_kasy, measure, data, value, diff FROM train")
ts_sql("null_counts", """SELECT nazwa_kasy, measure, count(*) AS n_rows,
  count(*) FILTER (WHERE data IS NULL) AS null_data, count(*) FILTER (WHERE value IS NULL) AS null_value,
  count(*) FILTER (WHERE diff IS NULL) AS null_diff FROM train GROUP BY 1, 2""")
ts_sql("undiff_actual", """SELECT nazwa_kasy, measure, data, value, diff,
  round(start_value + sum(CASE WHEN split = 'test' THEN diff END) OVER (PARTITION BY nazwa_kasy, measure
        ORDER BY data ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) + 0.0 AS level
  FROM (SELECT *, max(CASE WHEN rn = n - n_test THEN value END) OVER (PARTITION BY nazwa_kasy, measure) AS start_value
        FROM split) t
  QUALIFY split = 'test'""")
ts_sql("diff_histogram", """SELECT h.nazwa_kasy, h.measure, CAST(g.k AS INTEGER) AS bin, lo + g.k * ((hi - lo) / 20.0) AS bin_lo,
  lo + (g.k + 1) * ((hi - lo) / 20.0) AS bin_hi, c[g.k + 1] AS n
  FROM (SELECT nazwa_kasy, measure, lo, hi, [""" + ", ".join(f"count(*) FILTER (bin = {k})" for k in range(20)) + """] AS c
        FROM (SELECT nazwa_kasy, measure, lo, hi,
                CASE WHEN hi - lo = 0 THEN 0
                     ELSE least(19, CAST(floor((diff - lo) * 20.0 / (hi - lo)) AS INTEGER)) END AS bin
              FROM (SELECT *, min(diff) OVER (PARTITION BY nazwa_kasy, measure) AS lo,
                              max(diff) OVER (PARTITION BY nazwa_kasy, measure) AS hi
                    FROM sdiff WHERE diff IS NOT NULL) a) b
        GROUP BY nazwa_kasy, measure, lo, hi) h, range(0, 20) AS g(k)""")
_PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]]
ts_sql("measure_correlation", "SELECT nazwa_kasy, measure_a, measure_b, round(r, 9) AS corr FROM ("
       + " UNION ALL ".join(
           f"SELECT nazwa_kasy, '{a}' AS measure_a, '{b}' AS measure_b, corr({a.lower()}, {b.lower()}) AS r "
           f"FROM fact GROUP BY nazwa_kasy" for a, b in _PAIRS) + ") t")
_LAGS = ",\n    ".join(f"lag(u, {k}) OVER w AS l{k}" for k in range(1, 31))
_SUMS = ", ".join(["sum(u * u) AS s0"] + [f"sum(u * l{k}) AS s{k}" for k in range(1, 31)])
_ARR = ", ".join(f"s{k}" for k in range(0, 31))
ts_sql("acf", f"""SELECT nazwa_kasy, measure, CAST(g.k - 1 AS INTEGER) AS lag,
  round(COALESCE(s[g.k], 0.0) / NULLIF(s0, 0.0), 9) AS acf, nobs
  FROM (SELECT nazwa_kasy, measure, nobs, s0, [{_ARR}] AS s FROM (
          SELECT nazwa_kasy, measure, count(*) AS nobs, {_SUMS} FROM (
            SELECT nazwa_kasy, measure, u,
              {_LAGS}
            FROM (SELECT nazwa_kasy, measure, data,
                         diff - avg(diff) OVER (PARTITION BY nazwa_kasy, measure) AS u
                  FROM sdiff WHERE diff IS NOT NULL) x
            WINDOW w AS (PARTITION BY nazwa_kasy, measure ORDER BY data)) y
          GROUP BY 1, 2) z) t,
       generate_series(1, 31) AS g(k)""")

ts_sql("acf_bounds", f"""SELECT nazwa_kasy, measure, lag, round(r, 9) + 0.0 AS acf,
  round(CASE WHEN lag = 0 THEN 0.0 ELSE 1.959963984540054 * sqrt((1.0 + 2.0 * COALESCE(sum(CASE WHEN lag > 0 THEN r * r END)
    OVER (PARTITION BY nazwa_kasy, measure ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / nobs) END, 9) AS bound
  FROM (SELECT nazwa_kasy, measure, CAST(g.k - 1 AS INTEGER) AS lag, COALESCE(s[g.k], 0.0) / NULLIF(s0, 0.0) AS r, nobs
  FROM (SELECT nazwa_kasy, measure, nobs, s0, [{_ARR}] AS s FROM (
          SELECT nazwa_kasy, measure, count(*) AS nobs, {_SUMS} FROM (
            SELECT nazwa_kasy, measure, u,
              {_LAGS}
            FROM (SELECT nazwa_kasy, measure, data,
                         diff - avg(diff) OVER (PARTITION BY nazwa_kasy, measure) AS u
                  FROM sdiff WHERE diff IS NOT NULL) x
            WINDOW w AS (PARTITION BY nazwa_kasy, measure ORDER BY data)) y
          GROUP BY 1, 2) z) t,
       generate_series(1, 31) AS g(k)) q""")

# ---------------------------------------------------------------- forecast --
_GRID = ", ".join(f"({k}, CAST({round(-0.95 + 0.05 * k, 2)!r} AS DOUBLE))" for k in range(39))


def _fold(level: int, candidates: str) -> str:
    """Residual chains and the best theta for the candidates (nazwa_kasy, measure, k, theta) of a level."""
    return f"""
, cand{level} AS ({candidates})
, rec{level} AS (
    SELECT c.nazwa_kasy, c.measure, c.phase, g.k, g.theta, c.j,
           c.w - g.theta * 0.0 AS e, 0.0 + (c.w - g.theta * 0.0) * (c.w - g.theta * 0.0) AS sse
    FROM chain c JOIN cand{level} g ON c.nazwa_kasy = g.nazwa_kasy AND c.measure = g.measure WHERE c.j = 1
    UNION ALL
    SELECT r.nazwa_kasy, r.measure, r.phase, r.k, r.theta, c.j,
           c.w - r.theta * r.e AS e, r.sse + (c.w - r.theta * r.e) * (c.w - r.theta * r.e) AS sse
    FROM rec{level} r JOIN chain c ON c.nazwa_kasy = r.nazwa_kasy AND c.measure = r.measure
                           AND c.phase = r.phase AND c.j = r.j + 1)
, ends{level} AS (SELECT * FROM rec{level}
           QUALIFY row_number() OVER (PARTITION BY nazwa_kasy, measure, phase, k ORDER BY j DESC) = 1)
, css{level} AS (SELECT nazwa_kasy, measure, k, any_value(theta) AS theta, sum(sse) AS css FROM ends{level} GROUP BY 1, 2, 3)
, fit{level} AS (SELECT * FROM css{level}
          QUALIFY row_number() OVER (PARTITION BY nazwa_kasy, measure ORDER BY css, k) = 1)"""


def _around(level: int, step: str, places: int) -> str:
    return (f"SELECT nazwa_kasy, measure, g.i + 9 AS k, round(theta + {step} * g.i, {places}) AS theta "
            f"FROM fit{level}, range(-9, 10) AS g(i)")


FORECAST = f"""
, wrows AS (SELECT nazwa_kasy, measure, rn,
                   ((value - lag(value, 1) OVER w) - lag(value, 7) OVER w) + lag(value, 8) OVER w AS w,
                   CAST(rn % 7 AS INTEGER) AS phase
            FROM split WHERE split = 'train'
            WINDOW w AS (PARTITION BY nazwa_kasy, measure ORDER BY data))
, chain AS (SELECT nazwa_kasy, measure, phase, w,
                   row_number() OVER (PARTITION BY nazwa_kasy, measure, phase ORDER BY rn) AS j
            FROM wrows WHERE w IS NOT NULL)
{_fold(0, f"SELECT DISTINCT c.nazwa_kasy, c.measure, g.k, g.theta FROM chain c, (VALUES {_GRID}) AS g(k, theta)")}
{_fold(1, _around(0, "0.005::DOUBLE", 3))}
{_fold(2, _around(1, "0.0005::DOUBLE", 4))}
, anchors AS (SELECT s.nazwa_kasy, s.measure, CAST(s.rn % 7 AS INTEGER) AS phase, s.diff AS v, f.theta,
                     COALESCE(e.e, 0.0) AS e_last
              FROM split s JOIN fit2 f ON f.nazwa_kasy = s.nazwa_kasy AND f.measure = s.measure
              LEFT JOIN ends2 e ON e.nazwa_kasy = s.nazwa_kasy AND e.measure = s.measure
                              AND e.k = f.k AND e.phase = CAST(s.rn % 7 AS INTEGER)
              WHERE s.split = 'train' AND s.rn > s.n - s.n_test - 7)
, fc0 AS (SELECT t.nazwa_kasy, t.measure, t.data, t.rn - (t.n - t.n_test) AS h, t.value, t.diff,
                 t.y_t, a.theta, a.v + a.theta * a.e_last AS pred_diff
          FROM (SELECT *, max(CASE WHEN rn = n - n_test THEN value END)
                          OVER (PARTITION BY nazwa_kasy, measure) AS y_t FROM split) t
          LEFT JOIN anchors a ON a.nazwa_kasy = t.nazwa_kasy AND a.measure = t.measure
                             AND a.phase = CAST(t.rn % 7 AS INTEGER)
          WHERE t.split = 'test')
, fc AS (SELECT *, y_t + sum(pred_diff) OVER (PARTITION BY nazwa_kasy, measure ORDER BY data
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pred_level,
                y_t + sum(diff) OVER (PARTITION BY nazwa_kasy, measure ORDER BY data
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS orig_level
         FROM fc0)
, lbx AS (SELECT nazwa_kasy, measure, data, diff - pred_diff AS resid FROM fc)
, cmp AS (SELECT nazwa_kasy, measure, data, h, o AS dane_oryg,
                 round(pred_level, 2) + 0.0 AS dane_pred,
                 round(o - pred_level, 2) + 0.0 AS roznica,
                 round(pred_level / NULLIF(o, 0.0) * 100.0, 2) + 0.0 AS "roznica_%"
          FROM (SELECT *, round(orig_level, 2) + 0.0 AS o FROM fc) t)
"""


def fc_sql(name: str, body: str) -> None:
    sql(name, SERIES + FORECAST + body)
    from kasaflow.plans.oracle import _SQL
    _SQL[name] = "WITH RECURSIVE " + _SQL[name][len("WITH "):]


fc_sql("forecast_seasonal_ma", """SELECT nazwa_kasy, measure, data, h, theta, round(pred_diff, 6) + 0.0 AS pred_diff,
  round(pred_level, 2) + 0.0 AS pred_level FROM fc""")
fc_sql("undiff_forecast", "SELECT nazwa_kasy, measure, data, h, round(pred_level, 2) + 0.0 AS level FROM fc")
fc_sql("forecast_metrics", """SELECT nazwa_kasy, measure, count(*) AS n,
  round(sqrt(avg((diff - pred_diff) * (diff - pred_diff))), 6) AS rmse,
  round(avg(abs(diff - pred_diff)), 6) AS mae,
  round(1.0 - sum((diff - pred_diff) * (diff - pred_diff)) / NULLIF(sum(dev * dev), 0.0), 6) AS r2,
  'sarima_010_011_7' AS model
  FROM (SELECT *, diff - avg(diff) OVER (PARTITION BY nazwa_kasy, measure) AS dev FROM fc) t
  GROUP BY 1, 2""")
fc_sql("ljung_box", """SELECT nazwa_kasy, measure, n, 1 AS lags,
  round(n * (n + 2.0) * pow(COALESCE(s1, 0.0) / s0, 2) / (n - 1.0), 6) AS lb_stat
  FROM (SELECT nazwa_kasy, measure, count(*) AS n, sum(u * u) AS s0, sum(u * l1) AS s1
        FROM (SELECT nazwa_kasy, measure, u, lag(u, 1) OVER (PARTITION BY nazwa_kasy, measure ORDER BY data) AS l1
              FROM (SELECT nazwa_kasy, measure, data,
                           resid - avg(resid) OVER (PARTITION BY nazwa_kasy, measure) AS u
                    FROM lbx WHERE resid IS NOT NULL) a) b
        GROUP BY 1, 2) c""")
# erf by its series with positive terms, exp(-z^2) * sum of 2^k z^(2k+1) / (2k+1)!!, as a running product
fc_sql("ljung_box_pvalue", """, lb AS (
  SELECT nazwa_kasy, measure, n, n * (n + 2.0) * pow(COALESCE(s1, 0.0) / s0, 2) / (n - 1.0) AS q
  FROM (SELECT nazwa_kasy, measure, count(*) AS n, sum(u * u) AS s0, sum(u * l1) AS s1
        FROM (SELECT nazwa_kasy, measure, u, lag(u, 1) OVER (PARTITION BY nazwa_kasy, measure ORDER BY data) AS l1
              FROM (SELECT nazwa_kasy, measure, data,
                           resid - avg(resid) OVER (PARTITION BY nazwa_kasy, measure) AS u
                    FROM lbx WHERE resid IS NOT NULL) a) b
        GROUP BY 1, 2) c)
, terms AS (
  SELECT nazwa_kasy, measure, n, q, sqrt(q / 2.0) AS z, 0 AS k, sqrt(q / 2.0) AS term, sqrt(q / 2.0) AS total FROM lb
  UNION ALL
  SELECT nazwa_kasy, measure, n, q, z, k + 1, term * 2.0 * z * z / (2 * k + 3), total + term * 2.0 * z * z / (2 * k + 3)
  FROM terms WHERE k < 400)
SELECT nazwa_kasy, measure, n, 1 AS lags, round(q, 6) AS lb_stat,
  round(greatest(0.0, 1.0 - 2.0 / sqrt(pi()) * exp(-z * z) * total), 9) + 0.0 AS lb_pvalue
FROM terms WHERE k = 400""")
fc_sql("forecast_compare", 'SELECT nazwa_kasy, measure, data, h, dane_oryg, dane_pred, roznica, "roznica_%" FROM cmp')
fc_sql("forecast_mean_ratio", """SELECT nazwa_kasy, measure,
  round(CAST(sum(CAST("roznica_%" AS DECIMAL(38,2))) AS DOUBLE) / count("roznica_%"), 6) AS srednia_roznica
  FROM cmp GROUP BY 1, 2""")


# ------------------------------------------------------------------ adf gram --
_ADF_MAX_LAG = 57  # static lag columns; the rule gives L <= 57 below ~5 million days
_DZ_LAGS = ", ".join(f"COALESCE(lag(dz, {k}) OVER w, 0.0)" for k in range(1, _ADF_MAX_LAG + 1))
ts_sql("adf_gram", f"""
SELECT nazwa_kasy, measure, n, l AS "l", CAST(a.i - 1 AS INTEGER) AS i, CAST(b.j - 1 AS INTEGER) AS j,
       round(sum(v[a.i] * v[b.j]), 4) + 0.0 AS g
FROM (
  SELECT nazwa_kasy, measure, n, l, s, [dz, zl, 1.0, {_DZ_LAGS}] AS v
  FROM (SELECT *, z - lag(z) OVER w AS dz, lag(z) OVER w AS zl
        FROM (SELECT *, CAST(least(floor(n / 2) - 2, ceil(12.0 * pow(CAST(n AS DOUBLE) / 100.0, 0.25))) AS INTEGER) AS l,
                     CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0.0 END AS z,
                     row_number() OVER (PARTITION BY nazwa_kasy, measure ORDER BY data) - 1 AS s
              FROM (SELECT nazwa_kasy, measure, data, diff AS x,
                           count(*) OVER (PARTITION BY nazwa_kasy, measure) AS n,
                           avg(diff) OVER (PARTITION BY nazwa_kasy, measure) AS m,
                           stddev_samp(diff) OVER (PARTITION BY nazwa_kasy, measure) AS sd
                    FROM sdiff WHERE diff IS NOT NULL) a0) a1
        WINDOW w AS (PARTITION BY nazwa_kasy, measure ORDER BY data)) a2
  WINDOW w AS (PARTITION BY nazwa_kasy, measure ORDER BY data)) d,
  range(1, {_ADF_MAX_LAG + 4}) AS a(i), range(1, {_ADF_MAX_LAG + 4}) AS b(j)
WHERE d.s >= 1 AND d.s >= d.l + 1 AND a.i <= d.l + 3 AND b.j <= d.l + 3
GROUP BY nazwa_kasy, measure, n, l, a.i, b.j""")

# ------------------------------------------------------------------ adf test --
# The Gram matrix of list columns (a lag is a slice), eliminated column by column: the last entry is the
# residual sum of each nested lag. The chosen lag is fitted again on all its days.

def _eliminate(name: str, source: str, keep: str = "") -> str:
    """Recursion: ``g`` of ``source`` (nazwa_kasy, measure, g, pivots, ...) with its first k columns taken out."""
    return f"""
, {name} AS (
    SELECT nazwa_kasy, measure, pivots, {keep} 0 AS k, g FROM {source}
    UNION ALL
    SELECT nazwa_kasy, measure, pivots, {keep} k + 1, list_transform(g, lambda r, i: CASE WHEN i <= k + 1 THEN r
             ELSE list_transform(r, lambda x, j: x - r[k + 1] * g[k + 1][j] / g[k + 1][k + 1]) END)
    FROM {name} WHERE k < pivots)"""


_GRAM = "list_transform(c, lambda a: list_transform(c, lambda b: list_dot_product(a, b)))"
_ADF = f"""
, ax AS (SELECT nazwa_kasy, measure, data, diff AS x, count(*) OVER s AS n, avg(diff) OVER s AS m, stddev_samp(diff) OVER s AS sd
         FROM sdiff WHERE diff IS NOT NULL WINDOW s AS (PARTITION BY nazwa_kasy, measure))
, az AS (SELECT nazwa_kasy, measure, data, n, CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0.0 END AS z FROM ax)
, al AS (SELECT nazwa_kasy, measure, n, list(z ORDER BY data) AS zs, list(dz ORDER BY data) AS ds,
                CAST(least(floor(n / 2) - 2, ceil(12.0 * pow(CAST(n AS DOUBLE) / 100.0, 0.25))) AS BIGINT) AS l
         FROM (SELECT *, z - lag(z) OVER (PARTITION BY nazwa_kasy, measure ORDER BY data) AS dz FROM az) t GROUP BY 1, 2, 3)
, ac AS (SELECT nazwa_kasy, measure, n, zs, ds, l, l + 2 AS pivots, list_concat(
             [list_transform(zs[l + 2:n], lambda v: 1.0), zs[l + 1:n - 1]],
             list_transform(range(1, l + 1), lambda k: ds[l + 2 - k:n - k]), [ds[l + 2:n]]) AS c FROM al)
, ag AS (SELECT nazwa_kasy, measure, n, l, pivots, {_GRAM} AS g FROM ac)
{_eliminate("ae", "ag", "n, l,")}
, ap AS (SELECT nazwa_kasy, measure, k - 2 AS p FROM (
           SELECT *, (n - l - 1) * (ln(2 * pi()) + ln(g[-1][-1] / (n - l - 1)) + 1.0) + 2.0 * k AS aic FROM ae WHERE k >= 2) t
         QUALIFY row_number() OVER (PARTITION BY nazwa_kasy, measure ORDER BY aic, k) = 1)
, bc AS (SELECT nazwa_kasy, measure, n, p, p + 1 AS pivots, list_concat([list_transform(zs[p + 2:n], lambda v: 1.0)],
             list_transform(range(1, p + 1), lambda k: ds[p + 2 - k:n - k]), [zs[p + 1:n - 1], ds[p + 2:n]]) AS c
         FROM al JOIN ap USING (nazwa_kasy, measure))
, bg AS (SELECT nazwa_kasy, measure, n, p, pivots, {_GRAM} AS g FROM bc)
{_eliminate("be", "bg", "n, p,")}
, bt AS (SELECT nazwa_kasy, measure, p, n - p - 1 AS nobs, sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - p - 1 - p - 2) / sxx) AS t
         FROM (SELECT *, g[-2][-2] AS sxx, g[-2][-1] AS sxy, g[-1][-1] AS syy FROM be WHERE k = pivots) u)
, bp AS (SELECT *, CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t
                        ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END / sqrt(2.0) AS q FROM bt)
, bv AS (SELECT *, CASE WHEN t > 2.74 THEN 1.0 WHEN t < -18.83 OR q < -5 THEN 0.0
           ELSE 0.5 + exp(-q * q) / sqrt(pi()) * list_reduce(list_prepend([q, q], list_transform(range(1, 300), lambda k: [k * 1.0, 0.0])),
                lambda a, b: [a[1] * 2 * q * q / (2 * b[1] + 1), a[2] + a[1] * 2 * q * q / (2 * b[1] + 1)])[2] END AS pv FROM bp)
SELECT nazwa_kasy, measure, round(t, 6) AS adf_stat, round(pv, 6) + 0.0 AS p_value, CAST(p AS INTEGER) AS used_lag, CAST(nobs AS INTEGER) AS nobs,
  round(-3.43035 - 6.5393 / nobs - 16.786 / nobs ** 2 - 79.433 / nobs ** 3, 6) AS crit_1pct,
  round(-2.86154 - 2.8903 / nobs - 4.234 / nobs ** 2 - 40.040 / nobs ** 3, 6) AS crit_5pct,
  round(-2.56677 - 1.5384 / nobs - 2.809 / nobs ** 2, 6) AS crit_10pct, pv <= 0.05 AS stationary,
  CASE WHEN pv <= 0.05 THEN 'stationary' ELSE 'possibly non-stationary' END AS verdict
FROM bv"""


# --------------------------------------------------------------------- pacf --
_R_LIST = ", ".join(["s0 / s0"] + [f"COALESCE(s{k}, 0.0) / s0" for k in range(1, 31)])


def rec_sql(name: str, body: str) -> None:
    sql(name, SERIES + body)
    from kasaflow.plans.oracle import _SQL
    _SQL[name] = "WITH RECURSIVE " + _SQL[name][len("WITH "):]


# Durbin-Levinson on the unrounded biased ACF (lags 0..30), as a recursion over k
_PACF = f"""
, acf_sums AS (
    SELECT nazwa_kasy, measure, {_SUMS} FROM (
      SELECT nazwa_kasy, measure, u,
        {_LAGS}
      FROM (SELECT nazwa_kasy, measure, data,
                   diff - avg(diff) OVER (PARTITION BY nazwa_kasy, measure) AS u
            FROM sdiff WHERE diff IS NOT NULL) x
      WINDOW w AS (PARTITION BY nazwa_kasy, measure ORDER BY data)) y
    GROUP BY 1, 2)
, acf_list AS (SELECT nazwa_kasy, measure, [{_R_LIST}] AS r FROM acf_sums)
, lev AS (
    SELECT nazwa_kasy, measure, r, 1 AS k, [r[2] / r[1]] AS phi,
           r[1] * (1 - (r[2] / r[1]) * (r[2] / r[1])) AS v, r[2] / r[1] AS pk
    FROM acf_list
    UNION ALL
    SELECT nazwa_kasy, measure, r, k + 1,
           list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - pk2 * phi[k + 1 - j]), [pk2]),
           v * (1 - pk2 * pk2), pk2
    FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 2 - i]))) / v
                    AS pk2 FROM lev) t
    WHERE k < 30)
"""
rec_sql("adf_test", _ADF)
rec_sql("pacf", _PACF + """SELECT nazwa_kasy, measure, 0 AS lag, 1.0 AS pacf FROM acf_list
UNION ALL
SELECT nazwa_kasy, measure, CAST(k AS INTEGER) AS lag, round(pk, 9) + 0.0 AS pacf FROM lev""")

rec_sql("pacf_bounds", _PACF + """, obs AS (SELECT nazwa_kasy, measure, count(*) AS nobs FROM sdiff WHERE diff IS NOT NULL GROUP BY 1, 2)
SELECT nazwa_kasy, measure, 0 AS lag, 1.0 AS pacf, 0.0 AS bound FROM acf_list
UNION ALL
SELECT lev.nazwa_kasy, lev.measure, CAST(k AS INTEGER) AS lag, round(pk, 9) + 0.0 AS pacf,
  round(1.959963984540054 / sqrt(nobs), 9) AS bound
FROM lev JOIN obs ON obs.nazwa_kasy = lev.nazwa_kasy AND obs.measure = lev.measure""")


# ------------------------------------------------------------ lag regression --
# Two least-squares stages by the normal equations, solved by elimination (a recursion over
# the pivots of an augmented matrix), then the forecast recursion step by step.
from kasaflow.plans.oracle import _SQL as _ALL  # noqa: E402


def _solve(name: str, gram: str, size: int) -> str:
    """CTEs: ``{name}_x`` (nazwa_kasy, measure, b) solves the equations whose (i, j, g) are in
    ``gram``; entry 1 is the dependent variable."""
    return f"""
, {name}_row AS (
    SELECT nazwa_kasy, measure, i, list(g ORDER BY CASE WHEN j = 1 THEN 9999 ELSE j END) AS r
    FROM {gram} WHERE i > 1 GROUP BY 1, 2, 3)
, {name}_e AS (
    SELECT nazwa_kasy, measure, 1 AS k, list(r ORDER BY i) AS m FROM {name}_row GROUP BY 1, 2
    UNION ALL
    SELECT nazwa_kasy, measure, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN p
             ELSE list_transform(r, lambda x, c: x - r[k] * p[c]) END)
    FROM (SELECT *, list_transform(m[k], lambda x: x / m[k][k]) AS p FROM {name}_e) t WHERE k <= {size})
, {name}_x AS (SELECT nazwa_kasy, measure, list_transform(m, lambda r: r[{size + 1}]) AS b FROM {name}_e WHERE k = {size + 1})"""


_AR, _MA = [1, 2, 7, 8, 9, 14, 15, 16], [1, 2, 7, 8, 9]
_X28 = ", ".join(f"lag(x, {k}) OVER w" for k in range(1, 29))
LAG_REGRESSION = f"""
, lx AS (SELECT nazwa_kasy, measure, rn, x, [x, {_X28}] AS v FROM (SELECT nazwa_kasy, measure, data, diff AS x,
           row_number() OVER (PARTITION BY nazwa_kasy, measure ORDER BY data) AS rn FROM train) t
         WINDOW w AS (PARTITION BY nazwa_kasy, measure ORDER BY rn))
, g1 AS (SELECT nazwa_kasy, measure, a.i, b.j, sum(v[a.i] * v[b.j]) AS g
         FROM lx, range(1, 30) AS a(i), range(1, 30) AS b(j) WHERE v[29] IS NOT NULL GROUP BY 1, 2, 3, 4)
{_solve("s1", "g1", 28)}
, le AS (SELECT lx.nazwa_kasy, lx.measure, rn, x, CASE WHEN v[29] IS NOT NULL THEN x - list_dot_product(b, v[2:29]) END AS e
         FROM lx JOIN s1_x ON s1_x.nazwa_kasy = lx.nazwa_kasy AND s1_x.measure = lx.measure)
, l2 AS (SELECT nazwa_kasy, measure, [x, {", ".join(f"lag(x, {k}) OVER w" for k in _AR)}, {", ".join(f"lag(e, {k}) OVER w" for k in _MA)}] AS v
         FROM le WINDOW w AS (PARTITION BY nazwa_kasy, measure ORDER BY rn))
, g2 AS (SELECT nazwa_kasy, measure, a.i, b.j, sum(v[a.i] * v[b.j]) AS g
         FROM l2, range(1, 15) AS a(i), range(1, 15) AS b(j) WHERE v[14] IS NOT NULL GROUP BY 1, 2, 3, 4)
{_solve("s2", "g2", 13)}
, ends AS (SELECT nazwa_kasy, measure, list(x ORDER BY rn) AS xs, list(COALESCE(e, 0.0) ORDER BY rn) AS es FROM le GROUP BY 1, 2)
, fr AS (
    SELECT s.nazwa_kasy, s.measure, b, xs[-16:] AS xs, es[-16:] AS es, 0 AS h, 0.0::DOUBLE AS pred_diff
    FROM ends s JOIN s2_x ON s2_x.nazwa_kasy = s.nazwa_kasy AND s2_x.measure = s.measure
    UNION ALL
    SELECT nazwa_kasy, measure, b, list_append(xs, p)[-16:], list_append(es, 0.0)[-16:], h + 1, p
    FROM (SELECT *, {" + ".join(f"b[{i}] * xs[-{k}]" for i, k in enumerate(_AR, 1))} + {" + ".join(f"b[{i}] * es[-{k}]" for i, k in enumerate(_MA, 9))} AS p FROM fr) t
    WHERE h < (SELECT max(n_test) FROM split))
, fc0 AS (SELECT t.nazwa_kasy, t.measure, t.data, t.h, t.diff, t.y_t, fr.pred_diff
          FROM (SELECT *, rn - (n - n_test) AS h, max(CASE WHEN rn = n - n_test THEN value END)
                          OVER (PARTITION BY nazwa_kasy, measure) AS y_t FROM split) t
          LEFT JOIN fr ON fr.nazwa_kasy = t.nazwa_kasy AND fr.measure = t.measure AND fr.h = t.h
          WHERE t.split = 'test')
""" + FORECAST[FORECAST.index(", fc AS ("):]


def _seven(*columns: str) -> str:
    return ", ".join(f'CAST(CAST("{c}" AS FLOAT) AS DOUBLE) AS "{c}"' for c in columns)


def lag_sql(name: str, like: str, columns: str = "*") -> None:
    """The query ``like`` of the first model, on the second one's forecast."""
    from kasaflow.plans.oracle import _SQL, BASE
    tail = FORECAST[FORECAST.index(", fc AS ("):]
    body = _SQL[like].split(tail)[1].strip()
    ctes, select = (body.split("\nSELECT", 1)[0], "SELECT" + body.split("\nSELECT", 1)[1]) if body.startswith(",") else ("", body)
    _SQL[name] = ("WITH RECURSIVE " + BASE[len("WITH "):] + "\n" + (SERIES + LAG_REGRESSION).strip() + "\n" + ctes
                  + f"\nSELECT {columns} FROM ({select}) q").replace("sarima_010_011_7", "sarima_202_201_7_hr")


_STEP = "nazwa_kasy, measure, data, h, "
lag_sql("ljung_box_lag_regression", "ljung_box_pvalue")
lag_sql("forecast_mean_ratio_lag_regression", "forecast_mean_ratio")
lag_sql("forecast_lag_regression_metrics", "forecast_metrics", "nazwa_kasy, measure, n, " + _seven("rmse", "mae", "r2") + ", model")
lag_sql("forecast_compare_lag_regression", "forecast_compare", _STEP + "dane_oryg, " + _seven("dane_pred", "roznica", "roznica_%"))
for _name, _columns in (("undiff_forecast_lag_regression", "CAST(CAST(pred_level AS FLOAT) AS DOUBLE) AS level"),
                        ("forecast_lag_regression", _seven("pred_diff", "pred_level"))):
    sql(_name, SERIES + LAG_REGRESSION + f"SELECT {_STEP}{_columns} FROM fc")
    _ALL[_name] = "WITH RECURSIVE " + _ALL[_name][len("WITH "):]


# ----------------------------------------------------------- exact likelihood --
# The (0,1,0)(0,1,1,7) model: with t mod 7 fixed, w is a moving average of order 1 whose exact likelihood
# follows from r_1 = 1 + theta^2, r_t = 1 + theta^2 - theta^2 / r_(t-1), e_t = w_t - theta e_(t-1) / r_(t-1).
# Theta is searched for on ever finer grids.

def _exact_level(level: int, candidates: str) -> str:
    return f"""
, xcand{level} AS (SELECT DISTINCT nazwa_kasy, measure, CAST(greatest(-0.999, least(0.999, theta)) AS DOUBLE) AS theta FROM ({candidates}) c)
, xend{level} AS (
    SELECT nazwa_kasy, measure, phase, m, theta, list_reduce(list_prepend([0.0, 'infinity'::DOUBLE, 0.0, 0.0], ws), lambda a, b:
        [b[1] - theta * a[1] / a[2], 1 + theta * theta - theta * theta / a[2],
         a[3] + (b[1] - theta * a[1] / a[2]) ** 2 / (1 + theta * theta - theta * theta / a[2]),
         a[4] + ln(1 + theta * theta - theta * theta / a[2])]) AS z
    FROM wlists JOIN xcand{level} USING (nazwa_kasy, measure))
, xll{level} AS (
    SELECT nazwa_kasy, measure, theta, sum(m) AS n, -0.5 * (sum(m) * (ln(2 * pi() * sum(z[3]) / sum(m)) + 1) + sum(z[4])) AS llf
    FROM xend{level} GROUP BY 1, 2, 3)
, xfit{level} AS (SELECT * FROM xll{level} QUALIFY row_number() OVER (PARTITION BY nazwa_kasy, measure ORDER BY llf DESC, theta) = 1)"""


_finer = "".join(_exact_level(i, f"SELECT nazwa_kasy, measure, theta + {step} * g.i AS theta FROM xfit{i - 1}, range(-10, 11) AS g(i)")
                 for i, step in enumerate(("0.005", "0.0005", "0.00005", "0.000005"), 1))
EXACT_SEASONAL = f"""
, wrows AS (SELECT nazwa_kasy, measure, rn, CAST(rn % 7 AS INTEGER) AS phase,
                   ((value - lag(value, 1) OVER w) - lag(value, 7) OVER w) + lag(value, 8) OVER w AS w
            FROM split WHERE split = 'train' WINDOW w AS (PARTITION BY nazwa_kasy, measure ORDER BY data))
, wlists AS (SELECT nazwa_kasy, measure, phase, count(*) AS m, list([w, 0.0, 0.0, 0.0] ORDER BY rn) AS ws
             FROM wrows WHERE w IS NOT NULL GROUP BY 1, 2, 3)
{_exact_level(0, "SELECT DISTINCT nazwa_kasy, measure, 0.0333 * g.i AS theta FROM wlists, range(-30, 31) AS g(i)")}
{_finer}
{_exact_level(5, "SELECT nazwa_kasy, measure, round(theta, 4) AS theta FROM xfit4")}
, fc0 AS (SELECT t.nazwa_kasy, t.measure, t.data, t.rn - (t.n - t.n_test) AS h, t.value, t.diff, t.y_t, x.theta,
                 a.diff + x.theta * x.z[1] / x.z[2] AS pred_diff
          FROM (SELECT *, max(CASE WHEN rn = n - n_test THEN value END) OVER (PARTITION BY nazwa_kasy, measure) AS y_t
                FROM split) t
          JOIN split a ON a.nazwa_kasy = t.nazwa_kasy AND a.measure = t.measure AND a.split = 'train'
                      AND a.rn > a.n - a.n_test - 7 AND a.rn % 7 = t.rn % 7
          JOIN xend5 x ON x.nazwa_kasy = t.nazwa_kasy AND x.measure = t.measure AND x.phase = t.rn % 7
          WHERE t.split = 'test')
, fc AS (SELECT *, y_t + sum(pred_diff) OVER (PARTITION BY nazwa_kasy, measure ORDER BY data
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pred_level FROM fc0)
"""
ts_sql("exact_fit_seasonal", EXACT_SEASONAL + """SELECT nazwa_kasy, measure, round(theta, 3) + 0.0 AS theta, round(llf, 2) AS llf,
  round(4.0 - 2.0 * llf, 2) AS aic, CAST(n AS BIGINT) AS nobs FROM xfit5""")
ts_sql("forecast_exact_seasonal", EXACT_SEASONAL + """SELECT nazwa_kasy, measure, data, h, round(pred_diff, 2) + 0.0 AS pred_diff,
  round(pred_level, 2) + 0.0 AS pred_level FROM fc""")
ts_sql("forecast_exact_seasonal_metrics", EXACT_SEASONAL + """SELECT nazwa_kasy, measure, count(*) AS n,
  round(sqrt(avg((diff - pred_diff) * (diff - pred_diff))), 4) AS rmse,
  round(avg(abs(diff - pred_diff)), 4) AS mae,
  round(1.0 - sum((diff - pred_diff) * (diff - pred_diff)) / NULLIF(sum(dev * dev), 0.0), 4) AS r2,
  'sarima_010_011_7_exact' AS model
  FROM (SELECT *, diff - avg(diff) OVER (PARTITION BY nazwa_kasy, measure) AS dev FROM fc) t GROUP BY 1, 2""")


# -------------------------------------------------------------- order search --
# Differencing by the strength of the week and the KPSS test; then 96 sub-models, each by elimination on the Gram matrix.
_SL = sorted({i + 7 * j for i in range(6) for j in range(3)} - {0})
_N = len(_SL)


def _lag_set(p: int, P: int) -> list[int]:
    return sorted({i + 7 * j for i in range(p + 1) for j in range(P + 1)} - {0})


_CANDIDATES = [(p, q, P, Q) for p in range(6) for q in range(6) for P in range(3) for Q in range(3) if p + q + P + Q <= 5]
_CAND_ROWS = ", ".join(
    "({}, {}, {}, {}, {}, {})".format(p, q, P, Q, [2 + _SL.index(k) for k in _lag_set(p, P)] + [2 + _N + _SL.index(k) for k in _lag_set(q, Q)] or "CAST([] AS INTEGER[])",
                                      "'" + ",".join([f"x{k}" for k in _lag_set(p, P)] + [f"e{k}" for k in _lag_set(q, Q)]) + "'")
    for p, q, P, Q in _CANDIDATES)


def _kpss(level: int) -> str:
    """Differences once more where the KPSS statistic around a level exceeds its 5 % point."""
    u = "list_transform(z, lambda v: v - list_avg(z))"
    weights = f"""list_sum(list_transform(range(1, CAST(floor(4 * (len(z) / 100.0) ** 0.25) AS BIGINT) + 1), lambda k:
             (1 - k / (floor(4 * (len(z) / 100.0) ** 0.25) + 1)) * list_dot_product(u[k + 1:], u[:len(z) - k])))"""
    return f"""
, ku{level} AS (SELECT *, {u} AS u FROM kz{level})
, ks{level} AS (SELECT *, (list_dot_product(u, u) + 2 * {weights}) / len(z) AS s2, list_reduce(list_prepend([0.0, 0.0],
                  list_transform(u, lambda v: [v, 0.0])), lambda a, b: [a[1] + b[1], a[2] + (a[1] + b[1]) ** 2])[2] AS ss FROM ku{level})
, kz{level + 1} AS (SELECT nazwa_kasy, measure, sd, CASE WHEN go THEN d + 1 ELSE d END AS d, go AS open,
                  CASE WHEN go THEN list_transform(range(1, len(z)), lambda i: z[i + 1] - z[i]) ELSE z END AS z
           FROM (SELECT *, open AND len(z) > 10 AND s2 > 0 AND ss / (len(z) * len(z) * s2) > 0.463 AS go FROM ks{level}) t)"""


ORDER_SEARCH = f"""
, ot AS (SELECT nazwa_kasy, measure, data, diff AS x, row_number() OVER w AS rn, avg(diff) OVER near AS trend, count(*) OVER near AS m
         FROM train WINDOW w AS (PARTITION BY nazwa_kasy, measure ORDER BY data),
                           near AS (PARTITION BY nazwa_kasy, measure ORDER BY data ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
, od AS (SELECT nazwa_kasy, measure, x - trend AS v, avg(x - trend) OVER (PARTITION BY nazwa_kasy, measure, rn % 7) AS season FROM ot WHERE m = 7)
, os AS (SELECT nazwa_kasy, measure, CASE WHEN count(*) < 15 OR var_pop(v) = 0 THEN 0 WHEN 1 - var_pop(v - season) / var_pop(v) > 0.64 THEN 1 ELSE 0 END AS sd
         FROM od GROUP BY 1, 2)
, ol AS (SELECT nazwa_kasy, measure, list(x ORDER BY rn) AS x FROM ot GROUP BY 1, 2)
, kz0 AS (SELECT nazwa_kasy, measure, sd, 0 AS d, true AS open,
                 CASE WHEN sd = 1 THEN list_transform(range(1, len(x) - 6), lambda i: x[i + 7] - x[i]) ELSE x END AS z FROM ol JOIN os USING (nazwa_kasy, measure))
{_kpss(0)}{_kpss(1)}
, zr AS (SELECT nazwa_kasy, measure, sd, d, unnest(z) AS x, unnest(range(1, len(z) + 1)) AS rn FROM kz2)
, lx AS (SELECT nazwa_kasy, measure, rn, x, [x, {_X28}] AS v FROM zr WINDOW w AS (PARTITION BY nazwa_kasy, measure ORDER BY rn))
, g1 AS (SELECT nazwa_kasy, measure, a.i, b.j, sum(v[a.i] * v[b.j]) AS g
         FROM lx, range(1, 30) AS a(i), range(1, 30) AS b(j) WHERE v[29] IS NOT NULL GROUP BY 1, 2, 3, 4)
{_solve("s1", "g1", 28)}
, le AS (SELECT nazwa_kasy, measure, list(x ORDER BY rn) AS x, list(CASE WHEN v[29] IS NOT NULL THEN x - list_dot_product(b, v[2:29]) ELSE 0.0 END ORDER BY rn) AS e
         FROM lx JOIN s1_x USING (nazwa_kasy, measure) GROUP BY 1, 2)
, lc AS (SELECT nazwa_kasy, measure, len(x) - 47 AS n, list_concat([x[48:]],
             list_concat(list_transform({_SL}, lambda k: x[48 - k:len(x) - k]), list_transform({_SL}, lambda k: e[48 - k:len(x) - k]))) AS c FROM le)
, lg AS (SELECT nazwa_kasy, measure, n, {_GRAM} AS g FROM lc)
, lk AS (SELECT nazwa_kasy, measure, n, p, q, sp, sq, terms, len(cols) AS pivots,
                list_transform(list_append(cols, 1), lambda a: list_transform(list_append(cols, 1), lambda b: g[a][b])) AS g
         FROM lg, (VALUES {_CAND_ROWS}) AS c(p, q, sp, sq, cols, terms))
{_eliminate("lq", "lk", "n, p, q, sp, sq, terms,")}
, lb AS (SELECT nazwa_kasy, measure, n, p, q, sp, sq, terms, pivots, n * ln(g[-1][-1] / n) + 2.0 * pivots AS aic,
                count(*) OVER (PARTITION BY nazwa_kasy, measure) AS tried FROM lq WHERE k = pivots)
, lw AS (SELECT * FROM lb QUALIFY row_number() OVER (PARTITION BY nazwa_kasy, measure ORDER BY aic, pivots, p, q, sp, sq) = 1)
"""
rec_sql("order_search", ORDER_SEARCH + """SELECT nazwa_kasy, measure, p, CAST(d AS INTEGER) AS d, q, sp, CAST(sd AS INTEGER) AS sd, sq, 7 AS s, round(aic, 4) AS aic,
  CAST(pivots AS INTEGER) AS n_params, CAST(tried AS INTEGER) AS n_candidates, terms FROM lw JOIN kz2 USING (nazwa_kasy, measure)""")
rec_sql("order_search_terms", ORDER_SEARCH + """
, jg AS (SELECT lk.nazwa_kasy, lk.measure, lk.terms, lk.pivots, lk.g FROM lk JOIN lw USING (nazwa_kasy, measure, p, q, sp, sq) WHERE lk.pivots > 0)
, je AS (
    SELECT nazwa_kasy, measure, terms, pivots, 0 AS k, g FROM jg
    UNION ALL
    SELECT nazwa_kasy, measure, terms, pivots, k + 1, list_transform(g, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1])
             ELSE list_transform(r, lambda x, j: x - r[k + 1] * g[k + 1][j] / g[k + 1][k + 1]) END)
    FROM je WHERE k < pivots)
SELECT nazwa_kasy, measure, unnest(string_split(terms, ',')) AS term,
  unnest(list_transform(g[:pivots], lambda r: round(r[-1], 5) + 0.0)) AS coef FROM je WHERE k = pivots""")
