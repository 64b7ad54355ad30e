"""Row-level risk signals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cardwatch.config import Config

# Risk signals and the categories they apply to.
AMOUNT_FLOOR = 0.01
HOME_COUNTRY = "JP"
MCC_RISK = {7995: 1.0, 6011: 0.8, 4829: 0.6}
MCC_RISK_OTHER = 0.2
RISKY_DEVICE_SUFFIX = "0"
RISKY_IP_PREFIX = "198."


def amount_log(amount: Column) -> Column:
    # greatest() ranks NaN highest, so it has to be replaced beforehand.
    floor = F.lit(AMOUNT_FLOOR)
    return F.ln(F.greatest(F.nanvl(amount, floor), floor))


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def is_foreign(country: Column) -> Column:
    return flag(country != HOME_COUNTRY)


def mcc_risk(mcc: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MCC_RISK.items() for x in pair])
    return F.coalesce(table[mcc], F.lit(MCC_RISK_OTHER))


def device_risky(device_id: Column) -> Column:
    return flag(device_id.endswith(RISKY_DEVICE_SUFFIX))


def ip_risky(ip_prefix: Column) -> Column:
    return flag(ip_prefix.startswith(RISKY_IP_PREFIX))


def event_time(event_time_ms: Column, ingest_time_ms: Column | None, cfg: Config) -> Column:
    """Event time, at most `max_future_skew_ms` past ingest; no ingest time, no limit."""
    if ingest_time_ms is None:
        return event_time_ms
    return F.least(event_time_ms, ingest_time_ms + F.lit(cfg.max_future_skew_ms))


def floor_div(x: Column, width: int) -> Column:
    """Whole-number division that floors below zero too; `div` alone truncates."""
    w = F.lit(width).cast("long")
    return F.call_function("div", x - F.pmod(x, w), w)


def bucket(time_ms: Column, cfg: Config) -> Column:
    return floor_div(time_ms, cfg.bucket_ms)


def trace_id(given: Column | None, arrival: Column | None = None) -> Column:
    """The given id, else a new one; with `arrival`, a repeatable one (UUID v4 form)."""
    if arrival is None:
        fresh = F.uuid()
    else:
        h = F.md5(arrival.cast("string"))
        fresh = F.concat_ws(
            "-",
            F.substring(h, 1, 8),
            F.substring(h, 9, 4),
            F.concat(F.lit("4"), F.substring(h, 14, 3)),
            F.concat(F.lit("8"), F.substring(h, 18, 3)),
            F.substring(h, 21, 12),
        )
    return fresh if given is None else F.coalesce(given, fresh)
