"""The counter stream on a table whose micro-batches span more than ten minutes."""

import duckdb

from cardwatch.checks import oracle
from cardwatch.streaming import checks, score
from tests.check import differences
from tests.conftest import SF001


def test_no_row_is_dropped_where_micro_batches_are_long(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE e AS SELECT * FROM '{SF001}/events.parquet'")
    longer = "SELECT * REPLACE ((SELECT min(ts) FROM e) + (ts - (SELECT min(ts) FROM e)) * 4 AS ts) FROM e"
    con.execute(f"COPY ({longer}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    sql = oracle.oracle_sql()["stream_metrics"]
    assert differences(spark, con, checks.queries()["stream_metrics"], sql, str(tmp_path)) is None


def test_lateness_is_the_longest_way_back():
    assert checks.needed_lateness([]) == 0
    assert checks.needed_lateness([(None, None), (5, 5)]) == 0
    assert checks.needed_lateness([(0, 10), (8, 20), (None, None), (19, 25)]) == 12
    assert checks.needed_lateness([(0, 10), (12, 30), (3, 14)]) == 27


def test_micro_batches_do_not_grow_with_files(spark, monkeypatch):
    monkeypatch.setattr(score, "FILE_ROWS", 40)
    published, started = [], []

    def noted(function, results):
        def run(*args, **options):
            results.append(function(*args, **options))
            return results[-1]

        return run

    monkeypatch.setattr(score, "publish", noted(score.publish, published))
    for name in ("start_sink", "start_report"):
        monkeypatch.setattr(score, name, noted(getattr(score, name), started))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF001}/events.parquet'")
    sql = oracle.oracle_sql()["stream_metrics"]
    assert differences(spark, con, checks.queries()["stream_metrics"], sql, SF001) is None
    assert published[0] > 3 * checks.BATCHES
    batches = [sum(p.numInputRows > 0 for p in query.recentProgress) for query in started]
    assert len(batches) == 2 and all(2 <= n <= checks.BATCHES for n in batches)
