import random
from datetime import UTC

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliary.operators import progress
from foliary.streaming import ordered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAR = 4_000_000_000  # a row of another run so late that the watermark passes all others


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before)


def through(spark, tmp_path, make, batches, schema):
    """All rows that a stream gives for these batches of (run, seconds, ...) and one that ends them."""
    kept = []
    path, mark = f"{tmp_path}/in", f"{tmp_path}/mark"
    for n, batch in enumerate([*batches, [("end", FAR, 0, *[None] * (len(schema.split(", ")) - 3))]]):
        frame = spark.createDataFrame(batch, schema).withColumn("at", F.timestamp_seconds("secs"))
        frame.coalesce(1).write.mode("append").parquet(f"{path}/n={n}")
        stream = make(spark.readStream.schema(frame.schema).parquet(f"{path}/*"))
        stream.writeStream.foreachBatch(lambda b, _: kept.extend(b.collect())).outputMode("append").option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return [r for r in kept if r[0] != "end"]


def test_breaker_steps():
    """Two failures are put off, the third pauses; probes after 60, 120, 300, 300 ... seconds, the last cut to end at 3600."""
    machine, us = ordered.Breaker(), 1_000_000
    row = Row("outcome", "_us", "_order")
    s, told = machine.first, []
    for k, outcome in enumerate(["failed", "failed", "ok", "failed", "other", "failed", "failed"]):
        s, out = machine.step(s, row(outcome, k * us, k))
        told += out
    assert [(t[2], t[3]) for t in told] == [("deferred", 1), ("deferred", 2), ("deferred", 1), ("deferred", 2), ("paused", 3), ("probing", 3)] and told[-1][5] == 60
    after, found = machine.tick(s, 10_000 * us)
    assert [t[5] for t in found if t[2] == "probing"][:3] == [120, 300, 300] and found[-1][2:5] == ("gave_up", 3, 3600) and found[-1][0] == (6 + 3600) * us
    assert sum(t[5] for t in found if t[2] == "probing") + 60 == 3600 and [t[5] for t in found][-2] == 3600 - 60 - 120 - 300 * 11
    assert machine.step(after, row("failed", 0, 0)) == (after, []) and machine.wake(after) is None
    up, _ = machine.step(s, row("up", 30 * us, 9))
    back, said = machine.tick(up, 66 * us)
    assert said == [(66 * us, None, "recovered", 3, 60, None)] and back == machine.first


def test_live_breaker_whatever_the_batches(rocks, tmp_path):
    """The same words for rows in order and shuffled within the delay; the clock is the rows' own."""
    rows = [("a", 100 + k, k, o) for k, o in enumerate(["failed"] * 3)] + [("a", 400, 3, "up"), ("a", 700, 4, "failed")] + [("b", 100 + k, k, "failed") for k in range(4)] + [(None, 50, 0, "failed")]
    schema = "run string, secs bigint, seq bigint, outcome string"
    make = lambda stream: ordered.breaker(stream, "run", "at", "seq", "20 minutes")
    mixed = random.Random(3).sample(rows, len(rows))
    got = through(rocks, tmp_path / "x", make, [mixed[:4], mixed[2:8], mixed[8:]], schema)
    assert sorted(map(str, got)) == sorted(map(str, through(rocks, tmp_path / "y", make, [rows], schema)))
    said = lambda run: [(int(r.at.replace(tzinfo=UTC).timestamp()) if r.at.tzinfo is None else int(r.at.timestamp()), r.told, r.down_seconds) for r in got if r.run == run]
    a = said("a")
    assert [x[1] for x in a] == ["deferred", "deferred", "paused", "probing", "probing", "probing", "recovered", "deferred"] and a[6][2] == 480 and a[6][0] - a[2][0] == 480
    assert said("b")[-1][1:] == ("gave_up", 3600) and said(None)[0][1] == "deferred"


def test_live_throttle_and_fold_equal_the_batch(rocks, tmp_path):
    rng = random.Random(11)
    rows = sorted((rng.choice("abc"), rng.randrange(5000), k) for k in range(300))
    schema = "run string, secs bigint, id bigint"
    mixed = rng.sample(rows, len(rows))
    got = through(rocks, tmp_path / "t", lambda s: ordered.throttled(s, "run", "at", "id", ["id"], 4, 200.0, "2 hours"), [mixed[:100], mixed[100:250], mixed[200:]], schema)
    want = progress.throttled(rocks.createDataFrame([(r, float(s), k, (s, k)) for r, s, k in rows], "run string, secs double, id bigint, at struct<s:bigint,k:bigint>"), ["run"], "at", "secs", 4, 200.0)
    assert sorted((r.run, r.id) for r in got) == sorted((r.run, r.id) for r in want.collect())
    story = [("a", k, k, e, s, str(k)) for k, (e, s) in enumerate([("RunStarted", None), ("PhaseStarted", None)] + [(e, s) for s in ("ok", "error", "ok", "deferred") for e, s in (("ItemStarted", None), ("RequestStarted", None), ("ItemFinished", s))] + [("OutagePaused", None)])]
    schema = "run string, secs bigint, seq bigint, event_type string, status string, label string"
    mixed = rng.sample(story, len(story))
    make = lambda s: ordered.ordered_fold(s.withColumn("mono", F.col("secs").cast("double")), "at", 5.0, 2.0, "1 hour")
    last = through(rocks, tmp_path / "f", make, [mixed[:5], mixed[5:9], mixed[9:]], schema)[-1]
    want = progress.fold(rocks.createDataFrame(story, schema).withColumn("mono", F.col("secs").cast("double")), "run", "seq").first()
    assert {c: last[c] for c in want.asDict() if c in last} == {c: v for c, v in want.asDict().items() if c in last} and last.ok == 2 and last.outage_state == "paused"


def told_plainly(rows):
    """What the breaker must say of one run, read item by item with the site's answer looked up at each probe."""
    out, k, failures, rows = [], 0, 0, sorted(rows)
    while k < len(rows):
        at, order, outcome = rows[k]
        k += 1
        failures = failures + 1 if outcome == "failed" else 0 if outcome == "ok" else failures
        if outcome == "failed" and failures < 3:
            out.append((at, "deferred", None))
        if outcome != "failed" or failures < 3:
            continue
        out.append((at, "paused", 0))
        waited, waits = 0, [60, 120] + [300] * 11 + [120]
        for wait in waits:
            out.append((at + waited, "probing", waited))
            answers = [o for t, _, o in rows[k:] if t <= at + waited + wait and o != "other"]
            k += len([1 for t, _, _ in rows[k:] if t <= at + waited + wait])
            waited += wait
            if answers and answers[-1] in ("ok", "up"):
                out.append((at + waited, "recovered", waited))
                failures = 0
                break
        else:
            return [*out, (at + waited, "gave_up", waited)]
    return out


def test_breaker_query_equals_a_plain_reading(rocks):
    from foliary.plans import archive, catalog

    assert catalog
    sf = "/root/testdata/sf0.001"
    kinds, of = {"error": "failed", "view": "ok", "click": "up", "purchase": "down"}, {}
    for r in rocks.read.parquet(f"{sf}/events.parquet").selectExpr("user_id", "event_id", "event_type", "unix_micros(CAST(ts AS TIMESTAMP)) AS us").collect():
        of.setdefault(str(r.user_id), []).append((r.us / 1e6, r.event_id, kinds.get(r.event_type, "other")))
    want = sorted((u, round(at, 3), said, down) for u, rows in of.items() for at, said, down in told_plainly(rows))
    got = sorted((r.run, round(r.us / 1e6, 3), r.told, r.down_seconds) for r in archive.QUERIES["stream_breaker"](rocks, sf).withColumn("us", F.unix_micros("at")).collect())
    assert got and list(map(str, got)) == list(map(str, want))
