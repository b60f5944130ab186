import random

import pytest
from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.operators import gates
from sparkdlp.operators.rate_limit import Bucket, _cut, apply_transfer, token_bucket, transfer


def brute_force(times, bucket):
    """Token by token, from a full bucket."""
    units, last, out = bucket.full, None, []
    for now in times:
        if last is not None:
            units = min(bucket.full, units + (now - last) * bucket.refill)
        last = now
        ok = units >= bucket.period_us
        wait = 0.0 if ok else (bucket.period_us - units) / bucket.refill
        units -= bucket.period_us if ok else 0
        out.append((ok, wait))
    return out


BUCKETS = [Bucket(1, 1, 10), Bucket(2, 3, 7), Bucket(5, 2, 100), Bucket(20, 60, 600)]


@pytest.mark.parametrize("bucket", BUCKETS)
def test_transfer_equals_fold_from_every_start(bucket):
    rng = random.Random(bucket.capacity)
    for _ in range(60):
        gaps = rng.choices([0, 1, 2, 5, 13, 40, 200], k=rng.randint(1, 40))
        times = [sum(gaps[: i + 1]) for i in range(len(gaps))]
        pieces = transfer(times, bucket)
        assert pieces[0][0] == 0 and pieces[-1][1] == bucket.full
        assert all(a[1] + 1 == b[0] for a, b in zip(pieces, pieces[1:]))
        for start in range(0, bucket.full + 1, max(1, bucket.full // 97)):
            _, _, end, _ = bucket.fold(times, start, times[0])
            assert apply_transfer(pieces, start) == end


@pytest.mark.parametrize("chunk_rows", [10, 64, 10_000])
def test_heavy_keys_are_cut_without_a_trace(spark, chunk_rows):
    rng = random.Random(3)
    bucket = Bucket(3, 1, 1_000_000)
    rows, now = [], {"hot": 0, "warm": 0, "cold": 0}
    for i in range(900):
        key = rng.choices(["hot", "warm", "cold"], [8, 2, 1])[0]
        now[key] += rng.choice([0, 0, 100_000, 900_000, 2_500_000])
        rows.append((i, key, now[key]))
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "request_id int, client_key string, us bigint")
    arrivals = df.withColumn("ts", F.timestamp_micros("us"))
    got = {r.request_id: (r.allowed, r.wait_seconds, r.retry_after)
           for r in token_bucket(arrivals, bucket, chunk_rows=chunk_rows).collect()}
    for key in now:
        ordered = [(i, us) for i, k, us in rows if k == key]
        for (i, _), (ok, wait) in zip(ordered, brute_force([us for _, us in ordered], bucket)):
            retry = 0 if ok else int(wait / 1e6) + 1
            assert got[i] == (ok, pytest.approx(wait / 1e6), retry)


def test_bursts_and_outliers_do_not_fill_a_chunk(spark):
    bucket = Bucket(3, 1, 1_000_000)
    burst = 10**15  # one arrival at a default time, then all others within a moment, half of them at once
    times = [0] + [burst + max(0, i - 400) * 300_000 for i in range(800)]
    rows = [(i, "hot" if i % 9 else "cold", us) for i, us in enumerate(times)]
    df = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "request_id int, client_key string, us bigint")
    named = df.select(F.col("request_id").alias("_tie"), F.col("client_key").alias("_key"), F.col("us").alias("_us"))
    chunks = _cut(named, 100).groupBy("_key", "_chunk").count().collect()
    assert max(r["count"] for r in chunks) < 200
    arrivals = df.withColumn("ts", F.timestamp_micros("us"))
    got = {r.request_id: r.allowed for r in token_bucket(arrivals, bucket, chunk_rows=100).collect()}
    for key in ("hot", "cold"):
        ordered = [(i, us) for i, k, us in rows if k == key]
        for (i, _), (ok, _) in zip(ordered, brute_force([us for _, us in ordered], bucket)):
            assert got[i] == ok


def test_first_request_spends_one(spark):
    df = spark.createDataFrame([(i, "k", 0) for i in range(4)], "request_id int, client_key string, us bigint")
    arrivals = df.withColumn("ts", F.timestamp_micros("us"))
    got = token_bucket(arrivals, Bucket.of(GuardConfig(burst=0)), chunk_rows=100)
    assert sorted((r.request_id, r.allowed) for r in got.collect()) == [
        (0, True), (1, False), (2, False), (3, False),
    ]


def test_client_keys_and_gates(spark):
    rows = [
        (1, "Bearer  abc ", None, "h"), (2, "BEARER xyz", "k", "h"), (3, "Basic q", "k2", "h"),
        (4, None, None, "h"), (5, "bearer ", "zzz", None), (6, "Bearerabc", None, None),
    ]
    df = spark.createDataFrame(rows, "request_id int, a string, x string, host string")
    keyed = df.select(
        "request_id", "host", gates.client_key(F.col("a"), F.col("x")).alias("client_key")
    ).withColumn("rate_key", gates.rate_key(F.col("client_key"), F.col("host")))
    got = {r.request_id: (r.client_key, r.rate_key) for r in keyed.collect()}
    assert got == {
        1: ("abc", "abc"), 2: ("xyz", "xyz"), 3: ("k2", "k2"), 4: ("", "h"), 5: ("", "unknown"),
        6: ("", "unknown"),
    }
    cfg = GuardConfig(client_keys=" abc, ,xyz ")
    keys = gates.known_keys(spark, cfg)
    ids = lambda d: sorted(r.request_id for r in d.collect())
    assert ids(gates.auth_accept(keyed, keys)) == [1, 2]
    assert ids(gates.auth_reject(keyed, keys)) == [3, 4, 5, 6]
    assert ids(gates.auth_accept(keyed, gates.known_keys(spark, GuardConfig()))) == []
    assert ids(gates.auth_accept(keyed, keys, required=False)) == [1, 2, 3, 4, 5, 6]
    assert ids(gates.auth_reject(keyed, keys, required=False)) == []
    assert ids(gates.with_auth(keyed, keys).where("auth_ok")) == [1, 2]
