"""Parameters of the registered queries (the binding's stand-ins for the
source notebook's July 2022 / Houston / Miami / Portland choices)."""

REPORT_YEAR = 1998
REPORT_MONTH = 7
REPORT_MONTHS_PAIR = [7, 8]
REPORT_DAY = "1998-07-01"
REPORT_BRANCH = "ASIA"
SELECTED_BRANCHES = ["AMERICA", "ASIA", "EUROPE"]
TOP_N = 5
PIVOT_YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]  # months shown by the branch x month matrices
CALENDAR_HEAD = 10
