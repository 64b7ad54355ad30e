from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cardwatch import sinks


def test_summary_file(spark, tmp_path):
    numbers = [c for c in sinks.SUMMARY_COLUMNS if c.endswith(("_us", "_ticks_total"))]
    row = spark.range(1).select(
        F.lit('a,"b"').alias("runtime"),
        *[F.lit(i).cast("long").alias(c) for i, c in enumerate(["rps", "ok", "err", "dropped", *numbers])],
        F.lit(12.0).alias("router_l2_trigger_total"),
        F.lit(None).cast("double").alias("router_deadline_miss_total"),
    )
    path = str(tmp_path / "summary")
    for i in range(2):
        sinks.sink_bench_csv(sinks.summary_rows(row, F.lit(i), {"a,\"b\"": ("http://x", "http://x/m")}), path)
    text = spark.read.text(path).collect()
    headers = [r.value for r in text if r.value.startswith("ts_ms")]
    assert set(headers) == {",".join(sinks.SUMMARY_COLUMNS)} and len(headers) >= 2
    assert any(r.value.startswith('1,"a,""b""",http://x,') for r in text)
    back = spark.read.option("header", True).option("escape", '"').csv(path).orderBy("ts_ms")
    first = back.first()
    assert back.count() == 2
    assert (first.runtime, first.router_l2_trigger_total) == ('a,"b"', "12")
    assert first.router_deadline_miss_total is None


def test_no_folder_without_a_shared_one():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.shared_folder(session)


def test_shared_folder_follows_the_session(spark):
    assert sinks.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
