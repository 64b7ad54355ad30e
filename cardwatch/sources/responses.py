"""Response log lines to load-test samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.schemas import STAGES
from cardwatch.sources.requests import json_kind


def decode_responses(raw: DataFrame, value: str = "value") -> DataFrame:
    """Adds `ok` and the stage timings.

    A line that is absent (the call failed) or breaks the response contract is
    not ok and has zero timings.
    """
    number = "(k IN ('BIGINT', 'DOUBLE', 'FLOAT') OR k LIKE 'DECIMAL%')"
    rules = [
        f"{json_kind('_doc', 'trace_id')} = 'STRING'",
        number.replace("k ", f"{json_kind('_doc', 'score')} "),
        f"{json_kind('_doc', 'decision')} = 'STRING'",
        f"{json_kind('_doc', 'reason')} LIKE 'ARRAY%'",
    ] + [
        f"{json_kind('_doc', f'timings_us.{s}')} = 'BIGINT' "
        f"AND variant_get(_doc, '$.timings_us.{s}', 'bigint') >= 0"
        for s in STAGES
    ]
    ok = " AND ".join(f"coalesce({rule}, false)" for rule in rules)
    stages = {
        f"{s}_us": F.expr(
            f"CASE WHEN ok THEN try_variant_get(_doc, '$.timings_us.{s}', 'bigint') ELSE 0L END"
        )
        for s in STAGES
        if s != "parse"
    }
    # As for requests: a filter on `ok` must not repeat the parsing.
    judged = F.array(F.struct("_doc", F.expr(ok).alias("ok")))
    return (
        raw.withColumn("_doc", F.try_parse_json(value))
        .select(*raw.columns, F.inline(judged).alias("_doc", "ok"))
        .withColumns(stages)
        .drop("_doc")
    )
