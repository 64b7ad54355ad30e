"""Counter dumps (plain text) to four counters per dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The counters that are read.
COUNTERS = (
    "router_l2_trigger_total",
    "router_deadline_miss_total",
    "router_l2_skipped_budget_total",
    "router_timeout_before_l2_total",
)
_NUMBER = r"[+-]?(?:inf|infinity|nan|[0-9]+[.]?[0-9]*(?:e[+-]?[0-9]+)?|[.][0-9]+(?:e[+-]?[0-9]+)?)"


def scrape_counters(scrapes: DataFrame, body: str = "body") -> DataFrame:
    """Adds one column per counter, null when the dump has no such line.

    Lines are `name value`; comments, blank lines, labelled names and values that
    are no number are skipped, and the last line of a name wins. A dump is
    one row and is read within it, so there is no shuffle.
    """
    out = scrapes
    for name in COUNTERS:
        line = rf"(?m)(?d)^[^\S\n]*{name}[^\S\n]+((?i:{_NUMBER}))(?=\s|$)"
        found = F.regexp_extract_all(body, F.lit(line), F.lit(1))
        out = out.withColumn(name, F.try_element_at(found, F.lit(-1)).try_cast("double"))
    return out
