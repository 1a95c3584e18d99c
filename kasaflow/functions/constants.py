"""Fixed values of the data model.

These must equal the source notebook's values for the results to agree; they
are stated here once, in natural order.
"""

# --- fixed values: measure columns, in report order -------------------------
MEASURES = ["zas_pl_R", "zas_kz_R", "nad_pl", "nad_kz", "zas_pl_W", "zas_kz_W"]

# --- fixed values: weekday dimension (Spark dayofweek numbering, Sunday = 1) -
WEEKDAYS = [
    (1, "niedziela"),
    (2, "poniedziałek"),
    (3, "wtorek"),
    (4, "środa"),
    (5, "czwartek"),
    (6, "piątek"),
    (7, "sobota"),
]

# --- fixed values: display order of weekdays (Monday first; others rank 99) --
WEEKDAY_DISPLAY_ORDER = ["poniedziałek", "wtorek", "środa", "czwartek", "piątek", "sobota", "niedziela"]
OTHER_WEEKDAY_RANK = 99

# --- fixed values: day-off flags -------------------------------------------
WORKING_DAY = "D"
DAY_OFF = "DW"

# --- fixed values: nominal payment days of the month ------------------------
DEADLINE_DAYS = [1, 5, 10, 15, 20, 25]
# A deadline on a day off moves back at most this many days; the eve
# (working day before a deadline) is searched the same number of days back.
ROLL_DEPTH = 3

# --- fixed values: deadline labels used by the per-deadline series report ---
DEADLINE_LABELS = ["T1", "T1D-1", "T5", "T5D-1", "T10", "T10D-1", "T15", "T15D-1",
                   "T20", "T20D-1", "T25", "T25D-1"]
