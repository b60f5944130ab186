"""Streams whose rows come in any order give the batch operators' rows, and keep no more state than they need."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.operators import rate_limit
from sparkdlp.operators.decision import decide
from sparkdlp.operators.output import LEAK_REASON
from sparkdlp.streaming.event_time_limit import PROVIDER, ROCKSDB, event_time_bucket_stream
from sparkdlp.streaming.outcomes import judged_answers, needs_answer, outcome_stream

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    yield
    spark.conf.set(PROVIDER, before)


def staged(spark, batches, schema, path):
    """A stream of one file per micro-batch, in the order given."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def run(df, tmp_path, name):
    query = (
        df.writeStream.outputMode("append").format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300)
    return [json.loads(p.json) for p in query.recentProgress]


SCHEMA = "request_id long, client_key string, ts timestamp"


def arrivals(seed, n, keys, seconds):
    rng = random.Random(seed)
    return [(i, rng.choice(keys), START + timedelta(microseconds=rng.randrange(seconds * 1_000_000) // 500 * 500)) for i in range(n)]


def shuffled_within(rows, seconds, seed, size):
    """Micro-batches whose rows are at most so many seconds out of order."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.uniform(0, seconds)))
    return [late[i : i + size] for i in range(0, len(late), size)]


def test_shuffled_batches_equal_the_batch_operator(spark, tmp_path):
    bucket = rate_limit.Bucket(3, 30)
    rows = arrivals(4, 400, ["a", "b", "c", None], 600)
    batches = shuffled_within(rows, 50, 1, 60)
    assert [r for b in batches for r in b] != sorted(rows, key=lambda r: r[2])
    # The last arrival only moves the watermark past all others.
    batches.append([(9999, "clock", START + timedelta(days=1))])
    batches.append([(9998, "clock", START + timedelta(days=1, minutes=5))])
    source = staged(spark, batches, SCHEMA, str(tmp_path / "in"))
    progress = run(event_time_bucket_stream(source, bucket), tmp_path, "event_limits")
    want = rate_limit.token_bucket(spark.createDataFrame(rows, SCHEMA), bucket)
    columns = ["request_id", "client_key", "allowed", "wait_seconds", "retry_after"]
    got = spark.table("event_limits").where("client_key IS NULL OR client_key <> 'clock'").select(columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)
    assert 0 < got.where("allowed").count() < 400
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]) == 0


def test_silent_keys_leave_no_state(spark, tmp_path):
    """Many keys that come once: the state does not grow with the keys ever seen."""
    bucket = rate_limit.Bucket(2, 60)
    rows = [(i, f"k{i}", START + timedelta(seconds=10 * i)) for i in range(120)]
    batches = [rows[i : i + 20] for i in range(0, 120, 20)]
    source = staged(spark, batches, SCHEMA, str(tmp_path / "in"))
    progress = run(event_time_bucket_stream(source, bucket, delay="5 seconds"), tmp_path, "silent")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # A key that waits has an arrival, a due time and a timer with its index; at most two batches of 20 keys wait.
    assert len(held) >= 6 and max(held) <= 2 * 20 * 6 and held[-1] <= max(held[:3])
    got = spark.table("silent")
    assert got.where("allowed").count() == got.count() >= 99


def test_arrivals_behind_the_watermark_have_no_row(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, "a", at(0)), (2, "a", at(100))], [(3, "a", at(200))], [(4, "a", at(50)), (5, "a", at(195))], [(6, "a", at(900))], [(7, "a", at(1900))]]
    source = staged(spark, batches, SCHEMA, str(tmp_path / "in"))
    progress = run(event_time_bucket_stream(source, rate_limit.Bucket(5), delay="10 seconds"), tmp_path, "late")
    assert sorted(r.request_id for r in spark.table("late").collect()) == [1, 2, 3, 5, 6]
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]) == 1


def test_other_state_stores_are_refused(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError):
            event_time_bucket_stream(spark.createDataFrame([], SCHEMA), rate_limit.Bucket(1))
    finally:
        spark.conf.set(PROVIDER, ROCKSDB)


VERDICTS = (
    "request_id long, ts timestamp, auth_ok boolean, rate_ok boolean, valid boolean, has_secret boolean, has_pii boolean, "
    "score double, stream boolean, upstream_status int, upstream_detail string"
)
ANSWERS = "request_id long, answered_at timestamp, block_reason string"


def test_outcomes_equal_batch(spark, tmp_path):
    rng = random.Random(8)
    cfg = GuardConfig(block_on_secret=True)
    verdicts, answers = [], []
    for i in range(240):
        ts = START + timedelta(seconds=i * 5)
        verdicts.append(
            (i, ts, i % 11 != 0, i % 13 != 0, i % 17 != 0, i % 7 == 0, False, 0.9 if i % 9 == 0 else 0.1, i % 2 == 0, 500 if i % 10 == 3 else 200, "down")
        )
        if i % 6:
            answers.append((i, ts + timedelta(seconds=rng.uniform(0, 200)), LEAK_REASON if i % 4 == 1 else None))
    too_late = {i for i in range(0, 240, 6) if i % 12 == 6}
    answers += [(i, START + timedelta(seconds=i * 5 + 400), LEAK_REASON) for i in sorted(too_late)]
    answers.sort(key=lambda a: a[1] + timedelta(seconds=rng.uniform(0, 40)))
    end = START + timedelta(hours=9)
    clock = lambda n: (9000 + n, end + timedelta(hours=n), True, True, True, False, False, 0.0, False, 200, "")
    half, third = len(verdicts) // 3, len(answers) // 3
    asked = [verdicts[:half], verdicts[half : 2 * half], verdicts[2 * half :], [clock(0)], [clock(1)], [clock(2)]]
    said = [answers[:third], answers[third : 2 * third], answers[2 * third :]] + [[(9100 + n, end + timedelta(hours=n), None)] for n in range(3)]
    for rows in asked[:3]:
        rng.shuffle(rows)
    stream = outcome_stream(
        staged(spark, asked, VERDICTS, str(tmp_path / "v")), staged(spark, said, ANSWERS, str(tmp_path / "a")), cfg,
        patience="5 minutes", delay="10 minutes",
    )
    progress = run(stream, tmp_path, "outcomes")
    in_time = [a for a in answers if a[0] not in too_late]
    batch = spark.createDataFrame(verdicts, VERDICTS).join(spark.createDataFrame(in_time, ANSWERS).drop("answered_at"), "request_id", "left")
    want = decide(batch, cfg)
    columns = ["request_id", "exit", "decision", "status", "code", "reason"]
    got = spark.table("outcomes").where("request_id < 9000").select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.where("exit = 'blocked_output'").count() > 10
    # All that waited has gone; only the rows that moved the clock are left.
    assert progress[-1]["stateOperators"] and sum(o["numRowsTotal"] for o in progress[-1]["stateOperators"]) <= 40


def test_verdicts_that_wait_are_those_an_answer_can_change(spark):
    rows = [(i, START, i != 1, i != 2, i != 3, i == 4, i == 5, 0.9 if i == 6 else 0.0, i == 8, 500 if i in (7, 8) else None, "x") for i in range(10)]
    df = spark.createDataFrame(rows, VERDICTS)
    cfg = GuardConfig(block_on_secret=True)
    waits = {r.request_id for r in df.where(needs_answer(cfg)).collect()}
    ends = {
        reason: {r.request_id: r.exit for r in decide(df.withColumn("block_reason", F.lit(reason).cast("string")), cfg).collect()}
        for reason in (None, LEAK_REASON)
    }
    assert waits == {i for i in range(10) if ends[None][i] != ends[LEAK_REASON][i]} == {0, 5, 8, 9}


def test_answers_are_judged_on_a_stream_as_in_batch(spark, tmp_path):
    from sparkdlp.operators import canary

    rows = [(i, START, f"answer {i}") for i in range(6)]
    cfg = GuardConfig(canary_secret="s")
    df = spark.createDataFrame(rows, "request_id long, answered_at timestamp, output_text string")
    df = df.withColumn("output_text", F.when(F.col("request_id") % 2 == 0, F.concat("output_text", F.lit(" "), canary.token(F.col("request_id"), "s"))).otherwise(F.col("output_text")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(judged_answers(source, cfg), tmp_path, "judged")
    want = judged_answers(df, cfg)
    assert sorted(map(str, spark.table("judged").collect())) == sorted(map(str, want.collect()))
    assert want.where("block_reason IS NOT NULL").count() == 3
