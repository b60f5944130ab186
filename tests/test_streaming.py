import random

from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.operators import audit, chunk_dlp, decision, inject, rate_limit, score
from sparkdlp.sources import audit_log, chunk_log
from sparkdlp.streaming.chunk_dlp import scan_chunk_stream
from sparkdlp.streaming.rate_limit import token_bucket_stream
from sparkdlp.streaming.sinks import audit_stream, counter_stream
from tests.conftest import SF
from tests.test_chunk_dlp import CHUNK, TOKEN, random_streams


def file_stream(spark, df, path, order, files=2):
    """``df`` as a stream of one file per micro-batch, cut by ``order``."""
    total = df.count()
    ranked = df.orderBy(order).collect()
    for i in range(files):
        part = ranked[i * total // files : (i + 1) * total // files]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, tmp_path, name, mode="append"):
    query = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}"))
        .trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)


def test_rate_limit_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts")
    bucket = rate_limit.Bucket(2, 1, 12 * 3600 * 1_000_000)
    source = file_stream(spark, events, str(tmp_path / "in"), "ts")
    drain(token_bucket_stream(source, bucket, "user_id", "ts", "event_id"), tmp_path, "limits")
    want = rate_limit.token_bucket(events, bucket, "user_id", "ts", "event_id")
    columns = ["event_id", "user_id", "allowed", "wait_seconds", "retry_after"]
    got = spark.table("limits").select(columns)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(columns)).count() == 0


def test_chunks_equal_batch(spark, tmp_path):
    for strict in (True, False):
        cfg = GuardConfig(strict_streaming=strict, stream_buffer_chars=40)
        rows = [r for s in random_streams(5, 20) for r in s]
        random.Random(2).shuffle(rows)
        df = spark.createDataFrame(rows, CHUNK).withColumn("token", F.lit(TOKEN))
        source = file_stream(spark, df, str(tmp_path / f"in{strict}"), "seq")
        name = f"chunks_{strict}"
        drain(scan_chunk_stream(source, cfg), tmp_path, name)
        tokens = df.select("request_id", "token").distinct()
        want = chunk_dlp.scan_chunks(df, tokens, cfg)
        got = spark.table(name).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_lines_and_texts_scan_the_same_on_a_stream(spark, tmp_path):
    lines = spark.createDataFrame(
        [(1, 'data: {"choices":[{"delta":{"content":"hi"}}]}'), (1, ": ping"), (1, "data: [DONE]"),
         (1, 'data: {"choices":[]}'), (1, "data: {broken"), (1, ""), (1, "data:[1]")],
        "request_id int, line string",
    )
    lines.coalesce(1).write.parquet(str(tmp_path / "lines"))
    source = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "lines"))
    drain(chunk_log.chat_chunks(source), tmp_path, "lines")
    want = chunk_log.chat_chunks(lines)
    assert sorted(map(str, spark.table("lines").collect())) == sorted(map(str, want.collect()))

    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    turns.write.parquet(str(tmp_path / "turns"))
    live = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns"))
    drain(score.heuristic_score(inject.scan_text(live), "sanitized"), tmp_path, "scans")
    done = score.heuristic_score(inject.scan_text(turns), "sanitized")
    got = spark.table("scans").select(done.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, done.collect()))


def test_counters_and_audit_sink(spark, tmp_path):
    rows = [(i, e, s, u) for i, (e, s, u) in enumerate(
        [("allowed", True, True), ("allowed", False, False), ("blocked_auth", False, False),
         ("upstream_error", False, True), ("blocked_output", True, False)] * 3
    )]
    df = spark.createDataFrame(rows, "i int, exit string, stream boolean, upstream_failed boolean")
    source = file_stream(spark, df, str(tmp_path / "in"), "i", files=3)
    counter_stream(source, "counters", str(tmp_path / "cp"), availableNow=True).awaitTermination(300)
    want = {r.metric: r.value for r in decision.metrics(df).collect()}
    assert {r.metric: r.value for r in spark.table("counters").collect()} == want
    assert want["sparkdlp_upstream_errors"] == 6 and want["sparkdlp_requests_allowed"] == 6

    row = ("r1", 1704067200.5, "abc", "allowed", 0.35, True, ["jwt"], [], ["s"], "p…", 1.25, "openai", None)
    events = spark.createDataFrame([row, ("r2", *row[1:])], audit.SCHEMA)
    source = file_stream(spark, events, str(tmp_path / "ev"), "request_id")
    out = str(tmp_path / "audit")
    audit_stream(source, out, str(tmp_path / "cp2"), availableNow=True).awaitTermination(300)
    back = audit_log.read_audit(spark, out).drop("day").orderBy("request_id").collect()
    assert [tuple(r) for r in back] == [row, ("r2", *row[1:])]
