import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kasaflow.functions.constants import DEADLINE_DAYS
from pyspark.sql import functions as F

from kasaflow.functions.dates import binding_day_flag
from kasaflow.operators import deadlines as DL


def _cal(spark, start, end):
    """Calendar of a fact that has no rows but on the first and last day."""
    fact = spark.sql(f"SELECT explode(array(DATE'{start}', DATE'{end}')) AS Data")
    fact = fact.withColumn("dzien_wolny", binding_day_flag(F.col("Data")))
    return DL.deadline_calendar(DL.dense_calendar(fact))


def _terminy(spark, start, end):
    return {r.data1.isoformat(): r.Terminy for r in _cal(spark, start, end).collect()}


def test_glued_tags_may_2024(spark):
    # 2024-05-01 and 05-03 are holidays in the binding rule
    t = _terminy(spark, "2024-04-01", "2024-06-30")
    assert t["2024-04-30"] == "T1T5D-1"
    assert t["2024-05-02"] == "T5"


def test_glued_tags_dec_2024(spark):
    # 24-26 Dec off plus weekends: T25 rolls to Mon 23rd, its eve is Fri 20th
    days = [dt.date(2024, 12, 1) + dt.timedelta(days=i) for i in range(31)]
    flags = [(d, "DW" if d.weekday() >= 5 or 24 <= d.day <= 26 else "D") for d in days]
    cal = spark.createDataFrame(flags, "data1 date, dzien_wolny string")
    t = {r.data1.isoformat(): r.Terminy for r in DL.deadline_calendar(cal).collect()}
    assert t["2024-12-20"] == "T20T25D-1"
    assert t["2024-12-23"] == "T25"


def test_binding_rule_dec_2024(spark):
    # binding rule: only 25 and 26 Dec off -> T25 on Tue 24th, eve Mon 23rd
    t = _terminy(spark, "2024-12-01", "2024-12-31")
    assert t["2024-12-24"] == "T25"
    assert t["2024-12-23"] == "T25D-1"


def test_binding_example_1996(spark):
    t = _terminy(spark, "1996-04-01", "1996-05-31")
    assert t["1996-04-30"] == "T1T5D-1"


def test_weekend_roll_and_eve(spark):
    # 2021-12-05 is a Sunday: T5 rolls to Friday 3rd, eve Thursday 2nd
    t = _terminy(spark, "2021-11-20", "2021-12-31")
    assert t["2021-12-03"] == "T5"
    assert t["2021-12-02"] == "T5D-1"


def test_lost_tag_long_closure(spark):
    rows = [(dt.date(2024, 9, 1) + dt.timedelta(days=i)) for i in range(30)]
    flags = [(d, "DW" if (16 <= d.day <= 20 or d.weekday() >= 5) else "D") for d in rows]
    cal = spark.createDataFrame(flags, "data1 date, dzien_wolny string")
    out = {r.data1.day: r for r in DL.deadline_calendar(cal).collect()}
    assert all("T20" not in (r.Terminy or "").replace("T20D-1", "") for r in out.values())


def test_null_and_foreign_flags_end_search(spark):
    days = [dt.date(2023, 3, 1) + dt.timedelta(days=i) for i in range(20)]
    flags = {d: "D" for d in days}
    flags[dt.date(2023, 3, 5)] = "DW"
    flags[dt.date(2023, 3, 4)] = None      # search ends here: T5 lost
    flags[dt.date(2023, 3, 10)] = "X"      # foreign flag on the nominal day: lost
    cal = spark.createDataFrame(list(flags.items()), "data1 date, dzien_wolny string")
    t = {r.data1.day: r.Terminy for r in DL.deadline_calendar(cal).collect()}
    assert "T5" not in "".join(t.values()).replace("T5D", "")
    assert "T10" not in "".join(t.values())


def test_every_row_kept_and_empty_string_default(spark):
    cal = _cal(spark, "2022-01-01", "2022-12-31").collect()
    assert len(cal) == 365
    assert all(r.Terminy is not None for r in cal)


# ---- equivalence with a day-by-day lag chain (the notebook's formulation) ---

def lag_chain_oracle(days, flags):
    """Row-by-row restatement of the nominal/roll/eve columns over a dense calendar."""
    n = len(days)
    nominal = []
    for d, f in zip(days, flags):
        if d.day in DEADLINE_DAYS and f == "D":
            nominal.append(f"T{d.day}")
        elif d.day in DEADLINE_DAYS and f == "DW":
            nominal.append(f"T{d.day}x")
        else:
            nominal.append("")
    cols = [nominal]
    for _ in range(3):
        prev = cols[-1]
        cur = []
        for i in range(n):
            nxt = prev[i + 1] if i + 1 < n else None
            if nxt and nxt.endswith("x") and flags[i] == "D":
                cur.append(nxt[:-1])
            elif nxt and nxt.endswith("x") and flags[i] == "DW":
                cur.append(nxt)
            else:
                cur.append("")
        cols.append(cur)
    due = []
    for i in range(n):
        tags = [f"T{k}" for k in DEADLINE_DAYS if any(c[i] == f"T{k}" for c in cols)]
        due.append(";".join(tags))
    eve_cols = []
    prev = due
    first = []
    for i in range(n):
        nxt = prev[i + 1] if i + 1 < n else None
        tag = next((f"T{k}" for k in DEADLINE_DAYS if nxt == f"T{k}"), None)
        if tag and flags[i] == "D":
            first.append(tag + "D-1")
        elif tag and flags[i] == "DW":
            first.append(tag + "D-1x")
        else:
            first.append("")
    eve_cols.append(first)
    for _ in range(2):
        prev = eve_cols[-1]
        cur = []
        for i in range(n):
            nxt = prev[i + 1] if i + 1 < n else None
            if nxt and nxt.endswith("x") and flags[i] == "D":
                cur.append(nxt[:-1])
            elif nxt and nxt.endswith("x") and flags[i] == "DW":
                cur.append(nxt)
            else:
                cur.append("")
        eve_cols.append(cur)
    eve = []
    for i in range(n):
        tags = [f"T{k}D-1" for k in DEADLINE_DAYS if any(c[i] == f"T{k}D-1" for c in eve_cols)]
        eve.append(";".join(tags))
    return [a + b for a, b in zip(due, eve)]


@settings(max_examples=15, deadline=None)
@given(st.integers(min_value=0, max_value=10_000), st.floats(min_value=0.1, max_value=0.7))
def test_closed_form_equals_lag_chain(spark, seed, p_off):
    rnd = random.Random(seed)
    start = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 300))
    days = [start + dt.timedelta(days=i) for i in range(150)]
    flags = [rnd.choice(["DW"] if rnd.random() < p_off else ["D"]) for _ in days]
    if rnd.random() < 0.3:
        flags[rnd.randrange(len(flags))] = None
    expected = lag_chain_oracle(days, flags)
    cal = spark.createDataFrame(list(zip(days, flags)), "data1 date, dzien_wolny string")
    got = {r.data1: r.Terminy for r in DL.deadline_calendar(cal).collect()}
    assert [got[d] for d in days] == expected


def test_two_flags_on_a_date_fan_out(spark):
    days = [dt.date(2023, 5, 1) + dt.timedelta(days=i) for i in range(10)]
    rows = [(d, "D") for d in days] + [(dt.date(2023, 5, 5), "DW")]
    cal = spark.createDataFrame(rows, "data1 date, dzien_wolny string")
    out = DL.deadline_calendar(cal).filter("data1 = DATE'2023-05-05'").collect()
    assert sorted(r.dzien_wolny for r in out) == ["D", "DW"]
    assert {r.dzien_wolny: r.Terminy for r in out}["D"] == "T5"


def test_month_crossing_roll(spark):
    # 2022-05-01 is a Sunday and a holiday, 04-30 a Saturday: T1 rolls back into April
    t = _terminy(spark, "2022-04-15", "2022-05-15")
    assert t["2022-04-29"] == "T1"
    assert t["2022-04-28"] == "T1D-1"
    assert t["2022-05-05"] == "T5" and t["2022-05-04"] == "T5D-1"


# ---- rolled over rows -------------------------------------------------------------

@settings(max_examples=15, deadline=None)
@given(st.integers(min_value=0, max_value=10_000), st.floats(min_value=0.1, max_value=0.7), st.floats(min_value=0.0, max_value=0.8))
def test_rows_equal_the_lag_chain_on_calendars_with_gaps(spark, seed, p_off, p_gap):
    rnd = random.Random(seed)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(300) if rnd.random() >= p_gap]
    flags = [rnd.choice(["DW"] if rnd.random() < p_off else ["D"]) for _ in days]
    if days and rnd.random() < 0.3:
        flags[rnd.randrange(len(flags))] = None
    rows = list(zip(days, flags))
    rnd.shuffle(rows)
    cal = spark.createDataFrame(rows, "data1 date, dzien_wolny string").repartition(5)
    got = {r.data1: r.Terminy for r in DL.deadline_calendar(cal, by="rows").collect()}
    assert [got[d] for d in days] == lag_chain_oracle(days, flags)


def test_rows_and_dates_agree_without_gaps(spark):
    cal = DL.dense_calendar(spark.sql("SELECT explode(array(DATE'1999-03-01', DATE'2004-09-30')) AS Data")
                            .withColumn("dzien_wolny", binding_day_flag(F.col("Data"))))
    by = [sorted(map(tuple, DL.deadline_calendar(cal, by=b).select("data1", "Terminy").collect())) for b in ("date", "rows")]
    assert by[0] == by[1] and len(by[0]) == 2041


def test_row_numbers_run_over_the_whole_calendar_without_one_task(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=3 * i) for i in range(500)]
    cal = spark.createDataFrame([(d, "D") for d in days] + [(days[7], None)], "data1 date, dzien_wolny string").repartition(7)
    numbered = DL.row_numbers(cal)
    rows = sorted((r.pos, r.data1, r.dzien_wolny) for r in numbered.collect())
    assert [p for p, _, _ in rows] == list(range(1, 502)) and [d for _, d, _ in rows] == sorted([*days, days[7]])
    assert rows[7][2] is None and rows[8][2] == "D"
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert not any("SinglePartition" in line and "Window" in plan.splitlines()[max(0, i - 2)] for i, line in enumerate(plan.splitlines()))


def test_a_row_due_for_two_days_has_no_eve(spark):
    rows = [(dt.date(2024, 1, 3), "D"), (dt.date(2024, 1, 4), "D"), (dt.date(2024, 1, 5), "DW"), (dt.date(2024, 1, 10), "DW"), (dt.date(2024, 1, 11), "D")]
    cal = spark.createDataFrame(rows, "data1 date, dzien_wolny string")
    got = {r.data1.day: (r.Terminy, r.tags) for r in DL.deadline_calendar(cal, by="rows").collect()}
    assert got[4] == ("T5;T10", ["T5", "T10"]) and got[3] == ("", [])
