"""Streams against the batch jobs they extend."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from placard.operators import changes, gate
from placard.schemas import EVENT
from placard.streaming import gate as stream
from placard.streaming import log

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    own = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, own)


def runs(n=5, seed=1):
    """Runs of venues that are emptied, shifted, retitled, have a url twice, or are fine."""
    rng, shown, out = random.Random(seed), {}, []
    for run in range(n):
        rows = []
        for v in range(14):
            what = rng.choice(["same", "same", "new", "emptied", "shifted", "retitled", "few"])
            old = shown.get(v, [])
            if what == "emptied":
                fresh = []
            elif what == "shifted" and old:
                fresh = [(u, t, f"{o}x", c) for u, t, o, c in old]
            elif what == "retitled" and old:
                fresh = [(u, f"{t}!", o, c) for u, t, o, c in old]
            elif what == "few":
                fresh = [("u0", f"r{run}", "o", None)]
            elif what == "new" or not old:
                fresh = [(f"u{i}" if i else None, f"t{run}.{i}", "o", None if i % 2 else "c") for i in range(rng.randint(3, 6))] + [("u1", "twice", "o", "c")] * rng.randint(0, 1)
            else:
                fresh = old
            shown[v] = fresh or old
            rows += [(f"v{v}", run, i, *r) for i, r in enumerate(fresh)] + [(f"v{v}", run, None, None, None, None, None)]
        out.append(rows)
    return out


def test_the_gate_as_a_stream(rocks, tmp_path):
    spark, given = rocks, runs()
    source, sink, checkpoint = (str(tmp_path / x) for x in ("runs", "gated", "checkpoint"))

    def turn():
        query = stream.gated(spark.readStream.schema(stream.RUNS).parquet(source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination(240)

    for k, rows in enumerate(given):
        spark.createDataFrame(rows, stream.RUNS).coalesce(1).write.mode("append").parquet(source)
        if k in (0, 2, 4):  # the stream stops and starts anew; two of the batches have two runs
            turn()
    got = spark.read.schema(stream.GATED).parquet(sink).collect()
    prior = spark.createDataFrame([], f"venue_id string, {stream.ROW}")
    health = spark.createDataFrame([(f"v{v}", None, None, 0, 0, "unknown") for v in range(14)], "venue_id string, last_attempt string, last_success string, record_count long, consecutive_failures long, status string")
    seen = set()
    for run, rows in enumerate(given):
        fresh = spark.createDataFrame([(r[0], *r[2:]) for r in rows if r[4] is not None], f"venue_id string, {stream.ROW}")
        judged = gate.verdicts(fresh, prior)
        turns = spark.createDataFrame([(f"v{v}",) for v in range(14)], "venue_id string")
        quiet = turns.join(judged, "venue_id", "left_anti").select("venue_id", F.lit(0).cast("long").alias("had"), F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("matches"), F.lit(gate.OK).alias("verdict"))
        judged = judged.unionByName(quiet)
        published = spark.createDataFrame(gate.published(fresh, prior, judged).collect(), f"venue_id string, {stream.ROW}")
        health = spark.createDataFrame(gate.next_health(health, judged, F.lit(str(run))).collect(), health.schema)
        mine = [r for r in got if r.run == run]
        assert sorted((r.venue_id, r.pos, r.source_url, r.title, r.opens, r.closes) for r in mine if r.title) == sorted(map(tuple, published.collect()))
        assert {(r.venue_id, r.verdict) for r in mine} == {(r.venue_id, r.verdict) for r in judged.collect()}
        assert {(r.venue_id, r.consecutive_failures, r.status) for r in mine} == {(r.venue_id, r.consecutive_failures, r.status) for r in health.collect()}
        prior = published
        seen |= {r.verdict for r in mine}
    assert seen == {"ok", "emptied", "dates_shifted", "retitled"} and any(r.status == "stale" for r in got)


def test_venues_that_share_a_key(rocks, tmp_path):
    spark, given = rocks, [r for rows in runs(4, seed=2) for r in rows] + [("odd", 1, 0, 'a"],\\', "t\n\u20ac", None, "]")]
    rows, shown = spark.createDataFrame(given, stream.RUNS), []
    plain, packed = str(tmp_path / "rows"), str(tmp_path / "turns")
    every = stream.turns(rows, 4)
    assert every.count() == 15 * 4 and every.dtypes == spark.createDataFrame([], stream.TURNS).dtypes
    for step in ("run < 1", "run IN (1, 2)", "run = 3"):  # the state of a key with many venues is taken up anew
        rows.filter(step).unionByName(every.filter(step).select("venue_id", "run"), allowMissingColumns=True).coalesce(1).write.mode("append").parquet(plain)
        every.filter(step).coalesce(1).write.mode("append").parquet(packed)
        for name, frame in (("plain", stream.gated(spark.readStream.schema(stream.RUNS).parquet(plain))), ("packed", stream.gated_turns(spark.readStream.schema(stream.TURNS).parquet(packed), keys=3))):
            query = frame.writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "checkpoint"))
            query.trigger(availableNow=True).start().awaitTermination(240)
    for name in ("plain", "packed"):
        shown.append(sorted(map(repr, map(tuple, spark.read.schema(stream.GATED).parquet(str(tmp_path / name / "out")).collect()))))
    assert shown[0] == shown[1] and len(shown[0]) > 100 and any("odd" in r and "\u20ac" in r for r in shown[0])


def test_a_key_asks_for_its_state_once():
    calls = []

    class State:
        def get(self):
            calls.append("get")

        def update(self, value):
            calls.append(value)

    gate_ = stream.Gate()
    gate_.state = State()
    turns = [stream.Row(venue_id=f"v{i % 40}", run=i // 40, records='[{"pos":1,"title":"t"}]') for i in range(120)]
    out = list(gate_.handleInputRows((0,), iter(turns), None))
    assert len(out) == 120 and {r.verdict for r in out} == {"ok"} and len(calls) == 2 and len(calls[1][0]) == 40


def events(spark, keys):
    rows = [(f"evt-{t}-{v}-{ts}", ts, t, v, "e", None, None, i) for i, (t, v, ts) in enumerate(keys)]
    return spark.createDataFrame(rows, f"{EVENT}, seq int")


BATCHES = [
    [("OPENED", "a", "2026-01-01T00:00:00.000Z"), ("OPENED", "a", "2026-01-01T00:00:00.000Z"), ("CLOSED", "b", "2025-01-01T00:00:00.000Z")],
    [("OPENED", "a", "2026-01-01T00:00:00.000Z"), ("OPENED", "b", "2026-02-01T00:00:00.000Z")],
    [],
    [("OPENED", "c", "2026-04-03T00:00:00.000Z"), ("CLOSED", "b", "2025-01-01T00:00:00.000Z")],
    [("OPENED", "a", "2026-01-01T00:00:00.000Z"), ("OPENED", "d", "2026-04-04T00:00:00.000Z")],
]
KEY = ("type", "venue_id", "ts")


def test_the_log_has_each_event_once_whatever_is_repeated(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "log")
    append, whole = log.log_sink(root), events(spark, [])
    assert log.stored_log(spark, root).count() == 0
    now = ""
    for number, keys in enumerate(BATCHES):
        batch = events(spark, keys)
        if number in (1, 3):  # the batch fails after its rows are written, before they count, and is repeated
            monkeypatch.setattr(log, "new_file", lambda *_: 1 / 0)
            before = sorted(r.id for r in log.stored_log(spark, root).collect())
            with pytest.raises(ZeroDivisionError):
                append(batch, number)
            assert sorted(r.id for r in log.stored_log(spark, root).collect()) == before
            monkeypatch.undo()
        append(batch, number)
        append(batch, number)  # once more after it has counted
        now = max([now, *(ts for *_, ts in keys)])
        whole = spark.createDataFrame(changes.appended(whole, batch, now).collect(), whole.schema)
        got = log.stored_log(spark, root)
        assert sorted(tuple(r[c] for c in KEY) for r in got.collect()) == sorted(tuple(r[c] for c in KEY) for r in whole.collect())
    assert not list((tmp_path / "log/events").glob("batch=0/day=2025*"))  # what has left the log is removed


def test_the_log_behind_a_stream(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / x) for x in ("events", "log", "checkpoint"))
    whole, now = events(spark, []), ""
    for number, keys in enumerate(b for b in BATCHES if b):
        events(spark, keys).coalesce(1).write.mode("append").parquet(source)
        stream_ = spark.readStream.schema(f"{EVENT}, seq int").parquet(source)
        stream_.writeStream.foreachBatch(log.log_sink(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
        if number == 1:  # the stream forgets that this batch was done, and does it again
            shutil.rmtree(f"{checkpoint}/commits")
        now = max([now, *(ts for *_, ts in keys)])
        whole = spark.createDataFrame(changes.appended(whole, events(spark, keys), now).collect(), whole.schema)
    assert sorted(tuple(r[c] for c in KEY) for r in log.stored_log(spark, root).collect()) == sorted(tuple(r[c] for c in KEY) for r in whole.collect())
