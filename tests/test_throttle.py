"""The exact throttle against a plain loop, at once and as a stream that is stopped and started again."""

from __future__ import annotations

import datetime
import random

from larder.operators import usage
from larder.operators.components import connected_components
from larder.streaming import streams

BASE = datetime.datetime(2026, 1, 1)
SCHEMA = "event_id long, ts timestamp, ip int, account string, success boolean"


def slow(rows, per_ip, per_account, window_s) -> dict:
    by_ip, by_account, out = {}, {}, {}
    for i, ts, ip, account, success in sorted(rows, key=lambda r: (r[1], r[0])):
        at, blocked = (ts - BASE).total_seconds(), None
        for held, key, most in ((by_ip, ip, per_ip), (by_account, account, per_account)):
            held[key] = [t for t in held.get(key, []) if t > at - window_s]
            if blocked is None and len(held[key]) >= most:
                blocked = max(1, int(held[key][0] + window_s - at) + 1)
        if blocked is None and success:
            by_account.pop(account, None)
        elif blocked is None:
            by_ip.setdefault(ip, []).append(at)
            by_account.setdefault(account, []).append(at)
        out[i] = (blocked is None, blocked)
    return out


def attempts(n, seed=1, step=7):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.randrange(step)
        # one ip has a third of all attempts
        rows.append((i, BASE + datetime.timedelta(seconds=at), 0 if rng.random() < 0.33 else rng.randrange(1, 12), rng.choice("abcdefghij"), rng.random() < 0.3))
    return rows


def decisions(df):
    return {r.event_id: (r.allowed, r.retry_after) for r in df.collect()}


def test_whole_table_equals_a_loop(spark):
    rows = attempts(1500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = slow(rows, 6, 4, 120)
    assert decisions(usage.login_throttle(df, 6, 4, 120)) == want
    assert 100 < sum(not a for a, _ in want.values()) < 1400
    assert usage.login_throttle(df.limit(0), 6, 4, 120).count() == 0


def test_state_holds_a_window_alone():
    """A component of 200,000 attempts, fed in batches: what is kept stays within the window."""
    import pyarrow as pa

    kept = []
    feed = usage._fed(10**9, 10**9, 50.0)

    def batches():
        for k in range(0, 200_000, 10_000):
            n = range(k, k + 10_000)
            yield pa.RecordBatch.from_pydict({"part": ["p"] * 10_000, "kind": [2] * 10_000, "event_id": list(n), "ip": [f"i{i}" for i in n], "account": [f"a{i}" for i in n], "success": [False] * 10_000, "at": [i / 10 for i in n]})

    run = feed(batches())
    for batch in run:
        kept.append(sum(k < 2 for k in batch.column("kind").to_pylist()))
    assert kept[:-1] == [0] * 20 and kept[-1] == 2 * 500  # ten a second, for fifty seconds, by ip and by account


def test_stream_equals_whole_table_over_a_restart(spark, tmp_path):
    rows = attempts(900, 2)
    mixed = sorted(rows, key=lambda r: (r[1].timestamp() + random.Random(r[0]).randrange(10)))  # late by under 10 s
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def arrive(k, part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(source / f"p{k}"))

    def run(flush=False):
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
        return decisions(streams.throttle_stream(stream, out, 6, 4, 120, delay_s=20.0, flush=flush))

    for k in range(3):
        arrive(k, mixed[k * 150 : (k + 1) * 150])
    want = slow(rows, 6, 4, 120)
    first = run()
    assert 300 < len(first) < 450 and all(want[i] == d for i, d in first.items())
    assert run() == first  # a restart with nothing new
    for k in range(3, 6):
        arrive(k, mixed[k * 150 : (k + 1) * 150])
    assert run(flush=True) == want


def test_components_of_text_nodes(spark):
    links = [("a", "b"), ("b", "c"), ("x", "x"), ("d", "e"), (None, "q")] + [("hub", f"n{i}") for i in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "l string, r string"), "l", "r").collect()}
    assert got["a"] == got["b"] == got["c"] == "a" and got["x"] == "x" and got["e"] == "d" and "q" not in got
    assert {got[f"n{i}"] for i in range(50)} == {"hub"}
