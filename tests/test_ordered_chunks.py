"""Chunks in any order give the batch rows; state holds each early chunk once and expires."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.operators import chunk_dlp
from sparkdlp.streaming.ordered_chunks import borders, follow, ordered_chunk_stream
from tests.test_chunk_dlp import CHUNK, TOKEN, random_streams
from tests.test_event_time import START, rocksdb, run, staged  # noqa: F401

SCHEMA = CHUNK + ", ts timestamp, token string"


@pytest.mark.parametrize("strict", [True, False])
def test_any_order_equals_batch(spark, tmp_path, strict):
    cfg = GuardConfig(strict_streaming=strict, stream_buffer_chars=40)
    rng = random.Random(6)
    rows = [(*r[:6], START + timedelta(seconds=rng.randrange(60)), TOKEN) for s in random_streams(5, 25) for r in s]
    first = min(r[1] for r in rows)
    repeated = rows + rng.sample(rows, 20)
    rng.shuffle(repeated)
    batches = [repeated[i : i + len(repeated) // 4 + 1] for i in range(0, len(repeated), len(repeated) // 4 + 1)]
    name = f"ordered_{strict}"
    source = staged(spark, batches, SCHEMA, str(tmp_path / "in"))
    progress = run(ordered_chunk_stream(source, cfg, first_seq=first), tmp_path, name)
    df = spark.createDataFrame(rows, SCHEMA)
    want = chunk_dlp.scan_chunks(df.drop("ts", "token"), df.select("request_id", "token").distinct(), cfg)
    got = spark.table(name).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.reason for r in got.collect()} > {None} and len(batches) == 4
    # One place, one timer with its index, and at most every chunk once.
    requests = len({r[0] for r in rows})
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 4 * requests + len(rows)


def test_state_expires_and_late_parts_stay_unreleased(spark, tmp_path):
    chunk = lambda rid, seq, text, at: (rid, seq, text, text == "", False, None, START + timedelta(seconds=at), TOKEN)
    batches = [
        [chunk(1, 0, "a" * 100, 0), chunk(1, 2, "never", 1), chunk(2, 0, "key " + TOKEN, 2)],
        [chunk(9, 0, "x" * 100, 4000)], [chunk(9, 1, "y" * 100, 8000)],
        [chunk(1, 1, "b" * 100, 8000), chunk(2, 1, "c" * 200, 8000)], [chunk(9, 2, "z", 16000)], [chunk(9, 3, "z", 24000)],
    ]
    source = staged(spark, batches, SCHEMA, str(tmp_path / "in"))
    progress = run(ordered_chunk_stream(source, keep_ms=60_000, delay="30 seconds"), tmp_path, "expired")
    got = {(r.request_id, r.seq): r for r in spark.table("expired").collect()}
    assert set(got) >= {(1, 0), (2, 0), (9, 0)} and not {(1, 1), (1, 2), (2, 1)} & set(got)
    assert got[2, 0].blocked and got[2, 0].release == ""
    # Only the last chunk's request can still be open.
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 4


def test_matching_goes_on_between_texts():
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choices("ab ", k=rng.randint(1, 6)))
        text = "".join(rng.choices("ab ", k=40))
        at, ends, done = 0, [], 0
        while done < len(text):
            piece = text[done : done + rng.randint(1, 7)]
            at, found = follow(word, borders(word), at, piece)
            ends += [done + e for e in found]
            done += len(piece)
        assert ends == [i for i in range(len(word), len(text) + 1) if text[i - len(word) : i] == word]
