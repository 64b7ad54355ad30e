import json
import os
import random

import pytest

from cardwatch.config import Config
from cardwatch.operators.windows import STORE_FEATURES
from cardwatch.plans.score import scored_features
from cardwatch.sources.requests import dead_letter_split, decode_requests
from cardwatch.streaming import score, state
from tests.model import history_features


def request(rnd, seq, clock):
    return {
        "trace_id": None,
        "event_time_ms": clock - rnd.choice([0, 0, 0, 300, 1_900, 2_500, 60_000]),
        "user_id": f"u_{rnd.randrange(4)}",
        "card_id": "c",
        "merchant_id": "m",
        "mcc": rnd.choice([5411, 7995, 6011]),
        "amount": rnd.randrange(1, 9_000) / 100,
        "currency": "JPY",
        "country": rnd.choice(["JP", "US"]),
        "channel": "ecom",
        "device_id": f"d_{seq}",
        "ip_prefix": "203.0.113",
        "is_3ds": True,
    }


def write(folder, number, rows):
    """One file of lines; later files are newer by whole seconds."""
    path = folder / f"{9 - number}.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (1_700_000_000 + 10 * number,) * 2)


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rnd, clock, lines = random.Random(5), 1_700_000_000_000, []
    for seq in range(240):
        clock += rnd.choice([0, 50, 400, 3_000, 20_000])
        lines.append({"arrival_seq": seq, "value": json.dumps(request(rnd, seq, clock))})
    lines[7]["value"] = "{bad"
    source = tmp_path / "in"
    source.mkdir()
    parts = [lines[:80], lines[80:90], lines[90:200], lines[200:]]
    for part in parts:
        rnd.shuffle(part)

    def run():
        raw = score.read_requests(spark, str(source), maxFilesPerTrigger="1")
        valid, _ = dead_letter_split(raw)
        scored = score.with_live_counters(score.stream_scored_features(valid))
        query = score.start_sink(
            scored, str(tmp_path / "out"), str(tmp_path / "state"), "parquet", available_now=True
        )
        query.awaitTermination()
        return query

    write(source, 0, parts[0])
    write(source, 1, parts[1])
    first = run()
    observed = [p.observedMetrics["router"].rows for p in first.recentProgress if p.observedMetrics]
    assert sum(observed) == 89
    # A new query picks up offsets and state from the checkpoint.
    write(source, 2, parts[2])
    write(source, 3, parts[3])
    run()

    got = {r.arrival_seq: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    tx, _ = dead_letter_split(decode_requests(spark.createDataFrame(lines)))
    batch = {r.arrival_seq: r for r in scored_features(tx).collect()}
    assert got.keys() == batch.keys() and len(got) == 239
    for seq, row in batch.items():
        for name in (*STORE_FEATURES, "score"):
            assert got[seq][name] == pytest.approx(row[name], abs=1e-9), (seq, name)
        assert got[seq].decision == row.decision

    want = history_features(
        [(r.user_id, r.arrival_seq, r.event_time_ms, r.amount) for r in tx.collect()]
    )
    for (_, seq), values in want.items():
        assert tuple(got[seq][c] for c in STORE_FEATURES) == pytest.approx(values, abs=1e-6)


@pytest.mark.parametrize(("chunks", "files"), [(1, "1"), (4, "1"), (16, "1"), (16, "3")])
def test_cuts_change_no_result(spark, tmp_path, chunks, files):
    rnd, clock, rows = random.Random(8), 1_700_000_000_000, []
    for seq in range(400):
        clock += rnd.choice([0, 50, 400, 3_000, 20_000])
        rows.append((seq, json.dumps(request(rnd, seq, clock))))
    rnd.shuffle(rows)
    lines = spark.createDataFrame(rows, "arrival_seq long, value string").repartition(3)
    score.publish(lines, str(tmp_path / "in"), chunks)
    raw = score.read_requests(spark, str(tmp_path / "in"), maxFilesPerTrigger=files)
    scored = score.stream_scored_features(dead_letter_split(raw)[0])
    query = score.start_sink(
        scored, str(tmp_path / "out"), str(tmp_path / "state"), "parquet", available_now=True
    )
    query.awaitTermination()
    batches = sum(p.numInputRows > 0 for p in query.recentProgress)
    assert batches == -(-chunks // int(files))
    got = {r.arrival_seq: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = scored_features(dead_letter_split(decode_requests(lines))[0]).collect()
    assert len(got) == len(batch) == 400
    for row in batch:
        for name in (*STORE_FEATURES, "score"):
            assert got[row.arrival_seq][name] == pytest.approx(row[name], abs=1e-9)


def test_cells_and_pieces_change_no_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "INLINE", 3)
    monkeypatch.setattr(state, "CELL", 16)
    rnd, clock, rows = random.Random(8), 1_700_000_000_000, []
    for seq in range(600):
        clock += rnd.choice([0, 50, 100, 400, 900])
        late = rnd.choice([0, 0, 0, 500, 2_500])
        rows.append((rnd.choice("aaab"), seq, clock - late, float(rnd.randrange(99))))
    source = spark.createDataFrame(rows, "user_id string, arrival_seq long, event_time_ms long, amount double")
    for low in (0, 200, 400):
        part = source.filter(f"arrival_seq between {low} and {low + 199}").repartition(3)
        part.write.mode("append").parquet(str(tmp_path / f"in{low}"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    cfg = Config(short_window_s=5, long_window_s=20)
    try:
        for low in (0, 200, 400):
            live = tmp_path / "in"
            live.mkdir(exist_ok=True)
            for file in (tmp_path / f"in{low}").glob("part-*"):
                os.rename(file, live / file.name)
            tx = spark.readStream.schema(source.schema).parquet(str(live))
            out = state.store_features_stream(tx, cfg)
            query = score.start_sink(
                out, str(tmp_path / "out"), str(tmp_path / "state"), "parquet", available_now=True
            )
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = history_features(rows, cfg.short_buckets, cfg.long_buckets)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.user_id, r.arrival_seq): tuple(r[c] for c in STORE_FEATURES) for r in got} == want
    newest = {u: max(r[2] for r in rows if r[0] == u) // 100 for u in "ab"}
    kept = state.stored_buckets(spark, str(tmp_path / "state")).collect()
    assert all(r.bucket > newest[r.user_id] - cfg.long_buckets for r in kept)
    assert sum(r.user_id == "a" for r in kept) > 16


def test_text_lines_are_numbered_in_order(spark, tmp_path):
    rows = [(seq, f'{{"n":{seq}}}') for seq in range(90)]
    lines = spark.createDataFrame(rows, "arrival_seq long, value string").repartition(4)
    score.publish(lines, str(tmp_path / "in"), 3, text=True)
    read = score.read_request_lines(spark, str(tmp_path / "in"), stream=False)
    got = [r.value for r in read.orderBy("arrival_seq").collect()]
    assert got == [value for _, value in rows]
    assert read.select("arrival_seq").distinct().count() == 90
    assert read.filter("cause = 'missing: event_time_ms'").count() == 90


def test_idle_timeout_and_clamp_are_options(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rnd = random.Random(1)
    row = request(rnd, 1, 1_700_000_000_000) | {"event_time_ms": 4 * 10**12}
    write(source, 0, [{"arrival_seq": 1, "value": json.dumps(row)}])
    raw = score.read_requests(spark, str(source), ingest_time_ms=score.now_ms())
    valid, _ = dead_letter_split(raw)
    out = score.store_features_stream(
        valid.select("user_id", "arrival_seq", "event_time_ms", "ingest_time_ms", "amount"),
        Config(),
        idle_timeout_ms=60_000,
    )
    # A processing-time timeout keeps asking for batches: not for available_now.
    query = score.start_sink(out, str(tmp_path / "out"), str(tmp_path / "state"), "parquet")
    query.awaitTermination(15)
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_risk_table_is_read_anew_each_micro_batch(spark, tmp_path):
    rnd, source = random.Random(9), tmp_path / "in"
    source.mkdir()
    lines = [
        {"arrival_seq": i, "value": json.dumps(request(rnd, i, 1_700_000_000_000 + 100 * i) | {"mcc": 1 + i % 2})}
        for i in range(40)
    ]
    tables = {}

    def risks(session):
        # The first micro-batch opens one table, all later ones another.
        tables[len(tables)] = None
        return session.createDataFrame([(1, 0.25 if len(tables) == 1 else 0.75)], "mcc int, risk double")

    def run():
        valid, _ = dead_letter_split(score.read_requests(spark, str(source)))
        query = score.start_scoring(
            valid, risks, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True
        )
        query.awaitTermination()

    found = []
    for number, part in enumerate((lines[:20], lines[20:])):
        write(source, number, part)
        run()
        rows = spark.read.json(str(tmp_path / "out" / f"batch={number}")).collect()
        items = [{i.signal: i.value for i in r.reason}["mcc_risk"] for r in rows]
        found.append((len(rows), set(items)))
    assert found == [(20, {0.25, 0.2}), (20, {0.75, 0.2})]
