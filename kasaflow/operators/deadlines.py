"""Business calendar with payment-deadline tags.

Rule (per nominal day n in 1, 5, 10, 15, 20, 25 of every month):

* due day: among dates x, x-1, x-2, x-3 take the first one not flagged 'DW'.
  If it exists and is flagged 'D', tag it ``T<n>``; otherwise (four days off in
  a row, a foreign/NULL flag, or a date missing from the calendar) the tag is
  lost.
* eve: the same search from the due day over offsets 1..3; the day found is
  tagged ``T<n>D-1``.
* ``Terminy`` = due tags joined by ';' followed directly (no separator) by the
  eve tags, so collisions glue, e.g. ``T1T5D-1``. ``tags`` holds the same
  labels as an array for membership tests.

Plan: instead of a chain of lag windows over the whole calendar (one
partition), every day collects the flags of itself and the next six days with
one explode and one grouped shuffle keyed by date (at most 7 entries per
group). Due and eve tags are then row expressions over that
map. Everything is keyed by date, so the work partitions, and a calendar key
(branch, country) could be added to the grouping key.

By rows (``by="rows"``): a calendar with gaps can also be rolled over its rows, as
a lag over the ordered dates does: "x-1" is then the row before, whatever its
date. Rows get a number over the whole calendar without one task that sorts it:
they are numbered within each month and shifted by the rows of earlier months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kasaflow.functions.constants import DAY_OFF, DEADLINE_DAYS, ROLL_DEPTH, WORKING_DAY
from kasaflow.functions.dates import binding_day_flag


def calendar_from_fact(fact: DataFrame) -> DataFrame:
    """Distinct (date, flag) pairs of a fact, key renamed to ``data1``."""
    return fact.select("Data", "dzien_wolny").distinct().withColumnRenamed("Data", "data1")


def dense_calendar(fact: DataFrame, flag=binding_day_flag) -> DataFrame:
    """(data1, dzien_wolny) for every day of the fact's span. Flags are the
    fact's own; only dates without a row in the fact get the day-off rule. A
    date with two flags gives two rows."""
    own = calendar_from_fact(fact)
    days = (own.agg(F.min("data1").alias("lo"), F.max("data1").alias("hi"))
            .select(F.explode(F.sequence("lo", "hi")).alias("data1")))
    known = days.join(own.withColumn("known", F.lit(True)), "data1", "left")
    return known.select("data1", F.when(F.col("known"), F.col("dzien_wolny")).otherwise(flag(F.col("data1")))
                        .alias("dzien_wolny"))


def nominal_tags(cal: DataFrame) -> DataFrame:
    """``T<n>`` on a working nominal day, ``T<n>x`` on a day off, '' otherwise."""
    dom = F.dayofmonth("data1")
    tag = (F.when(dom.isin(DEADLINE_DAYS) & (F.col("dzien_wolny") == WORKING_DAY),
                  F.concat(F.lit("T"), dom.cast("string")))
           .when(dom.isin(DEADLINE_DAYS) & (F.col("dzien_wolny") == DAY_OFF),
                 F.concat(F.lit("T"), dom.cast("string"), F.lit("x")))
           .otherwise(F.lit("")))
    return cal.select("data1", "dzien_wolny", tag.alias("termin_nominal"))


def next_day_flag(cal: DataFrame) -> DataFrame:
    """Flag of the following calendar day (NULL on the last day).

    An equi-join on ``data1 + 1`` replaces the unpartitioned lag window.
    """
    nxt = cal.select(F.date_sub("data1", 1).alias("prev_key"),
                     F.col("dzien_wolny").alias("next_dzien_wolny"))
    return (cal.join(nxt, cal.data1 == nxt.prev_key, "left")
            .select("data1", "dzien_wolny", "next_dzien_wolny"))


def row_numbers(cal: DataFrame) -> DataFrame:
    """``cal`` with ``pos``, the number of each row by date (equal dates by flag, NULL first). A month is sorted by
    itself; only the months' row counts meet in one row."""
    month = F.trunc("data1", "MM")
    own = Window.partitionBy("_month").orderBy("data1", "dzien_wolny")
    rows = cal.withColumn("_month", month).withColumn("_at", F.row_number().over(own))
    counts = cal.groupBy(month.alias("_month")).agg(F.count("*").alias("n"))
    total = F.sort_array(F.collect_list(F.struct("_month", "n")))
    start = F.struct(F.lit(0).cast("long").alias("before"), F.array().cast("array<struct<_month:date,before:bigint>>").alias("out"))
    summed = F.aggregate(total, start, lambda acc, m: F.struct(
        (acc["before"] + m["n"]).alias("before"), F.array_append(acc["out"], F.struct(m["_month"], acc["before"].alias("before"))).alias("out")))
    offsets = counts.agg(summed["out"].alias("o")).select(F.explode("o").alias("o")).select("o.*")
    return rows.join(offsets, "_month").withColumn("pos", F.col("before") + F.col("_at")).drop("_month", "_at", "before")


def _ahead_flags(cal: DataFrame, span: int, by: str = "date") -> DataFrame:
    """(data1, dzien_wolny, ahead): ``ahead`` = (k, flag, day of the month) entries of the days (or rows)
    k = 0..span later. One explode and one grouped shuffle; a group holds
    span + 1 entries (more only if a date carries several flags). Each of the
    day's own rows (k = 0) is kept, so a date with two flags yields two rows,
    like a join on the date would."""
    k = F.explode(F.sequence(F.lit(0), F.lit(span))).alias("k")
    if by == "rows":
        spread = row_numbers(cal).select("data1", "dzien_wolny", "pos", k)
        key = F.col("pos") - F.col("k")
    else:
        spread = cal.select("data1", "dzien_wolny", k)
        key = F.date_sub("data1", F.col("k"))
    entry = F.struct("k", "dzien_wolny", F.dayofmonth("data1").alias("dom"), "data1")
    grouped = spread.groupBy(key.alias("at")).agg(F.collect_list(entry).alias("ahead"))
    own = F.explode(F.filter("ahead", lambda e: e["k"] == 0)).alias("own")
    return (grouped.select("ahead", own)
            .select(F.col("own.data1").alias("data1"), F.col("own.dzien_wolny").alias("dzien_wolny"), "ahead"))


def _lookahead_sql(span: int) -> list[str]:
    """f<k> = flag of day + k, m<k> = its day of the month (NULL where the calendar has no such day) (k = 1..span)."""
    out = []
    for k in range(1, span + 1):
        out.append(f"try_element_at(filter(ahead, e -> e.k = {k}), 1).dzien_wolny AS f{k}")
        out.append(f"try_element_at(filter(ahead, e -> e.k = {k}), 1).dom AS m{k}")
    return out


def _due_sql(j: int, depth: int) -> str:
    """Nominal days that are due on the day (or row) j later: it works, and only days off lie between."""
    def at(prefix: str, i: int) -> str:
        own = {"f": "dzien_wolny", "m": "dayofmonth(data1)"}
        return own[prefix] if i == 0 else f"{prefix}{i}"
    days = ", ".join(map(str, DEADLINE_DAYS))
    cases = []
    for k in range(depth + 1):
        conds = [f"{at('f', j)} = '{WORKING_DAY}'", *[f"{at('f', j + i)} = '{DAY_OFF}'" for i in range(1, k + 1)],
                 f"{at('m', j + k)} IN ({days})"]
        cases.append(f"CASE WHEN {' AND '.join(conds)} THEN {at('m', j + k)} END")
    return f"array_sort(array_distinct(filter(array({', '.join(cases)}), n -> n IS NOT NULL)))"


def deadline_calendar(cal: DataFrame, by: str = "date") -> DataFrame:
    """(data1, dzien_wolny, wyk_term, razemD_1, Terminy, tags) for every calendar date.

    With f(i) the flag i days after day d:
    * d is the due day of nominal day d+k (k = 0..3) iff f(0) = 'D' and
      f(1..k) are all 'DW';
    * d is the eve of due day d+j (j = 1..3) iff f(0) = 'D', f(1..j-1) are
      'DW' and d+j is the due day of one nominal day (rows of a calendar with
      gaps can be due for two: such a label matches none, and has no eve).
    A missing day or a flag other than D/DW ends a search, as does a fourth
    day off. The expressions are generated as SQL text (one call to build the
    projection instead of hundreds of Column objects).
    """
    depth = ROLL_DEPTH
    ahead = _ahead_flags(cal.select("data1", "dzien_wolny"), 2 * depth, by)
    ahead = ahead.selectExpr("data1", "dzien_wolny", *_lookahead_sql(2 * depth))
    due = ahead.selectExpr("data1", "dzien_wolny", *[f"f{j}" for j in range(1, depth + 1)],
                           *[f"{_due_sql(j, depth)} AS due{j}" for j in range(depth + 1)])
    eve = []
    for j in range(1, depth + 1):
        conds = [f"dzien_wolny = '{WORKING_DAY}'", *[f"f{i} = '{DAY_OFF}'" for i in range(1, j)], f"size(due{j}) = 1"]
        eve.append(f"CASE WHEN {' AND '.join(conds)} THEN due{j}[0] END")
    eves = f"array_sort(array_distinct(filter(array({', '.join(eve)}), n -> n IS NOT NULL)))"
    out = due.selectExpr("data1", "dzien_wolny", "transform(due0, n -> concat('T', n)) AS due_tags",
                         f"transform({eves}, n -> concat('T', n, 'D-1')) AS eve_tags")
    return out.selectExpr("data1", "dzien_wolny",
                          "array_join(due_tags, ';') AS wyk_term",
                          "array_join(eve_tags, ';') AS razemD_1",
                          "concat(array_join(due_tags, ';'), array_join(eve_tags, ';')) AS Terminy",
                          "concat(due_tags, eve_tags) AS tags")


def has_tag(tags: Column, label: str) -> Column:
    """Membership test that also finds glued labels (``T1T5D-1`` contains ``T5D-1``)."""
    return F.array_contains(tags, label)
