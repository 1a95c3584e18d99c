"""DuckDB SQL for each registered query (the correctness oracle).

The test tables are registered as views (region, nation, supplier, lineitem,
...). The common table expressions below rebuild the fact, the deadline
calendar and the enriched fact in plain SQL, independently of the Spark code
path (the calendar here is a min(k) FILTER search per nominal date).
DuckDB's dayofweek is 0-6 from Sunday; Spark's is 1-7.
"""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

# --- fixed values, written out here and not taken from the package, so that a
# wrong constant there shows up as a difference
MEASURES = ["zas_pl_R", "zas_kz_R", "nad_pl", "nad_kz", "zas_pl_W", "zas_kz_W"]
BINDING_MEASURES = [("A", "F", "zas_pl_R"), ("A", "O", "zas_kz_R"), ("N", "F", "nad_pl"),
                    ("N", "O", "nad_kz"), ("R", "F", "zas_pl_W"), ("R", "O", "zas_kz_W")]
BINDING_HOLIDAYS = ["01-01", "05-01", "05-03", "12-25", "12-26"]
WEEKDAYS = [(1, "niedziela"), (2, "poniedziałek"), (3, "wtorek"), (4, "środa"), (5, "czwartek"),
            (6, "piątek"), (7, "sobota")]
WEEKDAY_DISPLAY_ORDER = ["poniedziałek", "wtorek", "środa", "czwartek", "piątek", "sobota", "niedziela"]
DEADLINE_LABELS = ["T1", "T1D-1", "T5", "T5D-1", "T10", "T10D-1", "T15", "T15D-1", "T20", "T20D-1", "T25", "T25D-1"]
P = SimpleNamespace(REPORT_YEAR=1998, REPORT_MONTH=7, REPORT_MONTHS_PAIR=[7, 8], REPORT_DAY="1998-07-01",
                    REPORT_BRANCH="ASIA", SELECTED_BRANCHES=["AMERICA", "ASIA", "EUROPE"])

_SQL: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _flag(d: str) -> str:
    hol = ", ".join(_q(h) for h in BINDING_HOLIDAYS)
    return (f"CASE WHEN {d} IS NULL THEN NULL WHEN dayofweek({d}) IN (0, 6) "
            f"OR strftime({d}, '%m-%d') IN ({hol}) THEN 'DW' ELSE 'D' END")


_MEASURE_SUMS = ",\n    ".join(
    f"COALESCE(CAST(SUM(CASE WHEN l.l_returnflag = '{rf}' AND l.l_linestatus = '{ls}' "
    f"THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE), 0.0) AS {name.lower()}"
    for rf, ls, name in BINDING_MEASURES)
_M = ", ".join(m.lower() for m in MEASURES)
_WEEKDAY_VALUES = ", ".join(f"({i}, {_q(n)})" for i, n in WEEKDAYS)

FACT_CTE = f"""
geo AS (SELECT n.n_nationkey, r.r_name AS nazwa_kasy
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
sb AS (SELECT s.s_suppkey, g.nazwa_kasy FROM supplier s JOIN geo g ON s.s_nationkey = g.n_nationkey),
fact0 AS (
  SELECT CAST(l.l_shipdate AS DATE) AS data, sb.nazwa_kasy,
    {_MEASURE_SUMS}
  FROM lineitem l JOIN sb ON l.l_suppkey = sb.s_suppkey
  GROUP BY 1, 2),
fact AS (SELECT data, nazwa_kasy, {_flag('data')} AS dzien_wolny, {_M} FROM fact0)"""

CAL_CTE = f"""
span AS (SELECT min(data) AS lo, max(data) AS hi FROM fact),
own AS (SELECT DISTINCT data AS day, dzien_wolny AS flag FROM fact),
cal AS (SELECT x.d AS data1, CASE WHEN own.day IS NOT NULL THEN own.flag ELSE {_flag('x.d')} END AS dzien_wolny
        FROM (SELECT CAST(g.d AS DATE) AS d FROM span, generate_series(span.lo, span.hi, INTERVAL 1 DAY) AS g(d)) x
        LEFT JOIN own ON own.day = x.d),
nominal AS (SELECT data1 AS anchor_date, CAST(day(data1) AS INTEGER) AS n FROM cal
            WHERE day(data1) IN (1, 5, 10, 15, 20, 25)),
due_c AS (SELECT a.anchor_date, a.n, k.k, CAST(a.anchor_date - k.k AS DATE) AS cand_date
          FROM nominal a, (VALUES (0), (1), (2), (3)) AS k(k)),
due_f AS (SELECT c.anchor_date, c.n,
                 min(c.k) FILTER (WHERE cal.dzien_wolny IS DISTINCT FROM 'DW') AS kmin
          FROM due_c c LEFT JOIN cal ON cal.data1 = c.cand_date GROUP BY 1, 2),
due AS (SELECT f.n, cal.data1 AS hit_date FROM due_f f
        JOIN cal ON cal.data1 = CAST(f.anchor_date - f.kmin AS DATE) WHERE cal.dzien_wolny = 'D'),
eve_c AS (SELECT a.hit_date AS anchor_date, a.n, k.k, CAST(a.hit_date - k.k AS DATE) AS cand_date
          FROM due a, (VALUES (1), (2), (3)) AS k(k)),
eve_f AS (SELECT c.anchor_date, c.n,
                 min(c.k) FILTER (WHERE cal.dzien_wolny IS DISTINCT FROM 'DW') AS kmin
          FROM eve_c c LEFT JOIN cal ON cal.data1 = c.cand_date GROUP BY 1, 2),
eve AS (SELECT f.n, cal.data1 AS hit_date FROM eve_f f
        JOIN cal ON cal.data1 = CAST(f.anchor_date - f.kmin AS DATE) WHERE cal.dzien_wolny = 'D'),
due_l AS (SELECT hit_date AS data1, string_agg('T' || n, ';' ORDER BY n) AS t FROM due GROUP BY 1),
eve_l AS (SELECT hit_date AS data1, string_agg('T' || n || 'D-1', ';' ORDER BY n) AS t FROM eve GROUP BY 1),
calendar AS (
  SELECT cal.data1, cal.dzien_wolny, COALESCE(due_l.t, '') AS wyk_term,
         COALESCE(eve_l.t, '') AS razemd_1,
         COALESCE(due_l.t, '') || COALESCE(eve_l.t, '') AS terminy
  FROM cal LEFT JOIN due_l ON cal.data1 = due_l.data1 LEFT JOIN eve_l ON cal.data1 = eve_l.data1)"""

ENRICHED_CTE = f"""
wd AS (SELECT * FROM (VALUES {_WEEKDAY_VALUES}) AS t(id, dzien)),
enriched AS (
  SELECT f.data, f.nazwa_kasy, f.dzien_wolny, {", ".join("f." + m.lower() for m in MEASURES)},
         CAST(dayofweek(f.data) + 1 AS INTEGER) AS id_dnia_tygodnia, CAST(w.id AS BIGINT) AS id, w.dzien,
         CAST(date_trunc('month', f.data) AS DATE) AS miesiac_rok, c.terminy
  FROM fact f JOIN wd w ON dayofweek(f.data) + 1 = w.id
  JOIN calendar c ON f.data = c.data1)"""

NATION_FACT = f"""
nation_sb AS (SELECT s.s_suppkey, n.n_name AS nazwa_kasy FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
nation_fact AS (
  SELECT CAST(l.l_shipdate AS DATE) AS data, b.nazwa_kasy,
    {_MEASURE_SUMS}
  FROM lineitem l JOIN nation_sb b ON l.l_suppkey = b.s_suppkey
  GROUP BY 1, 2)"""

BASE = "WITH " + FACT_CTE.strip() + ",\n" + CAL_CTE.strip() + ",\n" + ENRICHED_CTE.strip()


def sql(name: str, body: str) -> None:
    _SQL[name] = BASE + "\n" + body.strip()


def oracle_sql() -> dict[str, str]:
    from kasaflow.plans import oracle_series  # noqa: F401  (registers more SQL)
    return dict(_SQL)


_MONTH_LO = f"DATE '{P.REPORT_YEAR:04d}-{P.REPORT_MONTH:02d}-01'"
_MONTH_HI = (f"DATE '{P.REPORT_YEAR + (P.REPORT_MONTH == 12):04d}-"
             f"{(P.REPORT_MONTH % 12) + 1:02d}-01'")
_IN_MONTH = f"data >= {_MONTH_LO} AND data < {_MONTH_HI}"
_IN_PAIR = "(" + " OR ".join(
    f"(data >= DATE '{P.REPORT_YEAR:04d}-{m:02d}-01' AND data < DATE '"
    f"{P.REPORT_YEAR + (m == 12):04d}-{(m % 12) + 1:02d}-01')" for m in P.REPORT_MONTHS_PAIR) + ")"


def _rank(c: str) -> str:
    whens = " ".join(f"WHEN {c} = {_q(n)} THEN {i}" for i, n in enumerate(WEEKDAY_DISPLAY_ORDER, 1))
    return f"CASE {whens} ELSE 99 END"


_ML = ", ".join(m.lower() for m in MEASURES)
_MONTHLY = [("zas_pl_R", "suma_mc_zasilki_do_placowek_r"), ("zas_kz_R", "suma_mc_zasilki_dla_klientaz_r"),
            ("nad_pl", "suma_mc_nadmiary_z_placowek"), ("nad_kz", "suma_mc_nadmiary_od_kientaz"),
            ("zas_pl_W", "suma_mc_zasilki_do_placowek_w"), ("zas_kz_W", "suma_mc_zasilki_dla_klientaz_w")]


def _xsum(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


sql("csv_scan", f"SELECT data, nazwa_kasy, dzien_wolny, {_ML} FROM fact")
sql("csv_scan_inferred", f"SELECT data, nazwa_kasy, dzien_wolny, {_ML} FROM fact")
sql("csv_scan_checked", f"SELECT data, nazwa_kasy, dzien_wolny, {_ML} FROM fact WHERE day(data) NOT IN (13, 29)")
sql("csv_rejected", """SELECT CASE day(data) WHEN 13 THEN 'nad_kz' ELSE 'Data' END AS reason, count(*) AS n_rows
  FROM fact WHERE day(data) IN (13, 29) GROUP BY 1""")
sql("weekday_dim", "SELECT DISTINCT id, dzien FROM enriched")
sql("filter_day", f"SELECT data, nazwa_kasy, dzien_wolny, {_ML} FROM fact WHERE data = DATE '{P.REPORT_DAY}'")
sql("filter_month", f"SELECT data, nazwa_kasy, dzien_wolny, {_ML} FROM fact WHERE {_IN_MONTH}")
sql("weekday_enrich", f"""SELECT f.data, f.nazwa_kasy, f.dzien_wolny, {", ".join("f." + m.lower() for m in MEASURES)},
  CAST(dayofweek(f.data) + 1 AS INTEGER) AS id_dnia_tygodnia, CAST(w.id AS BIGINT) AS id, w.dzien
  FROM fact f JOIN wd w ON dayofweek(f.data) + 1 = w.id""")
sql("month_key", f"""SELECT data, nazwa_kasy, dzien_wolny, {_ML},
  CAST(date_trunc('month', data) AS DATE) AS miesiac_rok FROM fact""")
sql("calendar_distinct", "SELECT DISTINCT data AS data1, dzien_wolny FROM fact")
sql("calendar_head", "SELECT data1, terminy FROM calendar ORDER BY data1 LIMIT 10")
sql("calendar_next_flag", """SELECT a.data1, a.dzien_wolny, b.dzien_wolny AS next_dzien_wolny
  FROM cal a LEFT JOIN cal b ON b.data1 = CAST(a.data1 + 1 AS DATE)""")
sql("deadline_nominal", """SELECT data1, dzien_wolny,
  CASE WHEN day(data1) IN (1, 5, 10, 15, 20, 25) AND dzien_wolny = 'D' THEN 'T' || day(data1)
       WHEN day(data1) IN (1, 5, 10, 15, 20, 25) AND dzien_wolny = 'DW' THEN 'T' || day(data1) || 'x'
       ELSE '' END AS termin_nominal FROM cal""")
sql("deadline_due", "SELECT data1, dzien_wolny, wyk_term FROM calendar")
sql("deadline_eve", "SELECT data1, dzien_wolny, razemd_1 FROM calendar")
sql("deadline_calendar", "SELECT data1, dzien_wolny, terminy FROM calendar")
_ROW_DAYS = "[" + ", ".join(["1", "5", "10", "15", "20", "25"]) + "]"


def _row_due(j: int) -> str:
    cases = [f"CASE WHEN f[{j + 1}] = 'D' AND len(list_filter(f[{j + 2}:{j + k + 1}], lambda x: x = 'DW')) = {k} "
             f"AND list_contains({_ROW_DAYS}, m[{j + k + 1}]) THEN m[{j + k + 1}] END" for k in range(4)]
    return f"list_sort(list_distinct(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)))"


_ROW_EVES = ", ".join(f"CASE WHEN f[1] = 'D' AND len(list_filter(f[2:{j}], lambda x: x = 'DW')) = {j - 1} AND len(d{j}) = 1 THEN d{j}[1] END"
                      for j in (1, 2, 3))
sql("deadline_calendar_rows", f"""SELECT data1, dzien_wolny, array_to_string(list_transform(d0, lambda n: 'T' || n), ';')
    || array_to_string(list_transform(list_sort(list_distinct(list_filter([{_ROW_EVES}], lambda x: x IS NOT NULL))), lambda n: 'T' || n || 'D-1'), ';') AS terminy
  FROM (SELECT *, {", ".join(f"{_row_due(j)} AS d{j}" for j in range(4))} FROM (
    SELECT data1, dzien_wolny, [{", ".join(f"lead(dzien_wolny, {k}) OVER w" for k in range(7))}] AS f,
           [{", ".join(f"lead(day(data1), {k}) OVER w" for k in range(7))}] AS m
    FROM (SELECT DISTINCT data AS data1, dzien_wolny FROM fact) c
    WINDOW w AS (ORDER BY data1, dzien_wolny NULLS FIRST)) a) b""")
sql("deadline_enrich", f"""SELECT f.data, f.nazwa_kasy, f.dzien_wolny, {", ".join("f." + m.lower() for m in MEASURES)}, c.terminy
  FROM fact f JOIN calendar c ON f.data = c.data1""")
sql("monthly_sums", "SELECT miesiac_rok, " + ", ".join(
    f"round({_xsum(m)}, 2) AS {alias}" for m, alias in _MONTHLY) + " FROM enriched GROUP BY 1")
sql("monthly_sums_published", "SELECT miesiac_rok, " + ", ".join(
    f"round({_xsum(m)}, 2) AS {alias}" for m, alias in _MONTHLY) + ", CAST(year(miesiac_rok) AS INTEGER) AS rok FROM enriched GROUP BY 1")
sql("monthly_report", "SELECT miesiac_rok, " + ", ".join(
    f"format('{{:,.2f}}', round({_xsum(m)}, 2)) AS {alias}" for m, alias in _MONTHLY)
    + " FROM enriched GROUP BY 1")


def _columns(days: list[dt.date], col: str, value: str) -> str:
    """One column a date, named by it."""
    return ", ".join(value.format(f"CASE WHEN {col} = DATE '{d}' THEN") + f' AS "{d}"' for d in days)


_MONTHS = [dt.date(y, m, 1) for y in range(1995, 2002) for m in range(1, 13)]
_DAYS = [dt.date(P.REPORT_YEAR, P.REPORT_MONTH, 1) + dt.timedelta(days=i) for i in range(31)]
for _m in ("nad_kz", "zas_pl_R"):
    sql(f"monthly_pivot_{_m.lower()}", "SELECT nazwa_kasy, " + _columns(
        _MONTHS, "miesiac_rok", f"CAST(SUM({{}} CAST({_m} AS DECIMAL(18,2)) END) AS DOUBLE)")
        + " FROM enriched GROUP BY nazwa_kasy")
sql("monthly_pivot_selected", "SELECT miesiac_rok, " + ", ".join(
    f"{_xsum(f'CASE WHEN nazwa_kasy = {_q(b)} THEN nad_kz END')} AS \"{b.lower()}\""
    for b in P.SELECTED_BRANCHES)
    + " FROM enriched WHERE nazwa_kasy IN (" + ", ".join(_q(b) for b in P.SELECTED_BRANCHES)
    + ") GROUP BY 1")
sql("monthly_pivot_selected_zas_pl_r", "SELECT miesiac_rok, " + ", ".join(
    f"{_xsum(f'CASE WHEN nazwa_kasy = {_q(b)} THEN zas_pl_R END')} AS \"{b.lower()}\""
    for b in P.SELECTED_BRANCHES)
    + " FROM enriched WHERE nazwa_kasy IN (" + ", ".join(_q(b) for b in P.SELECTED_BRANCHES)
    + ") GROUP BY 1")
for _m in MEASURES:
    sql(f"daily_pivot_{_m.lower()}", "SELECT nazwa_kasy, " + _columns(_DAYS, "data", f"max({{}} {_m} END)")
        + f" FROM enriched WHERE {_IN_MONTH} GROUP BY nazwa_kasy")
    _SQL["daily_pivot_top5" if _m == "nad_kz" else f"daily_pivot_top5_{_m.lower()}"] = (
        "WITH " + NATION_FACT.strip() + "\nSELECT nazwa_kasy, " + _columns(_DAYS, "data", f"max({{}} {_m} END)")
        + f" FROM nation_fact WHERE {_IN_MONTH} GROUP BY nazwa_kasy ORDER BY nazwa_kasy LIMIT 5")
sql("daily_long", f"""SELECT nazwa_kasy, data, measure, value FROM (
  UNPIVOT (SELECT nazwa_kasy, data, {", ".join(f'{m.lower()} AS "{m}"' for m in MEASURES)}
           FROM enriched WHERE {_IN_MONTH})
  ON {", ".join(f'"{m}"' for m in MEASURES)} INTO NAME measure VALUE value)""")
sql("branch_month_detail", f"""SELECT data, terminy,
  COALESCE(printf('%,.0f', sign(CAST(CAST(zas_pl_R AS FLOAT) AS DOUBLE))
           * floor(abs(CAST(CAST(zas_pl_R AS FLOAT) AS DOUBLE)) + 0.5)), '') AS zas_pl_r,
  COALESCE(printf('%,.0f', sign(CAST(CAST(zas_pl_W AS FLOAT) AS DOUBLE))
           * floor(abs(CAST(CAST(zas_pl_W AS FLOAT) AS DOUBLE)) + 0.5)), '') AS zas_pl_w
  FROM enriched WHERE {_IN_MONTH} AND nazwa_kasy = {_q(P.REPORT_BRANCH)}""")
sql("weekday_ordered", f"""SELECT data, dzien, nad_kz, {_rank('dzien')} AS weekday_rank
  FROM enriched WHERE nazwa_kasy = {_q(P.REPORT_BRANCH)} AND {_IN_PAIR}""")
sql("weekday_profile", f"""SELECT dzien, {_xsum('nad_kz')} / count(*) AS avg_nad_kz, count(*) AS n_days,
  {_rank('dzien')} AS weekday_rank
  FROM enriched WHERE nazwa_kasy = {_q(P.REPORT_BRANCH)} AND {_IN_PAIR} GROUP BY dzien""")
sql("series_by_weekday", f"""SELECT data, dzien, nad_kz FROM enriched
  WHERE nazwa_kasy = {_q(P.REPORT_BRANCH)} AND dzien IN ({", ".join(_q(d) for d in WEEKDAY_DISPLAY_ORDER)})""")
sql("series_by_deadline", f"""SELECT data, terminy, zas_pl_R AS zas_pl_r FROM enriched
  WHERE nazwa_kasy = {_q(P.REPORT_BRANCH)} AND terminy IN ({", ".join(_q(t) for t in DEADLINE_LABELS)})""")
