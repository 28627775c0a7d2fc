"""Streams over a folder of part files: several micro-batches, late and
repeated rows, a restart, a retried batch."""
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF
from ledgerlens.plans.registry import load_all
from ledgerlens.session import ensure_checkpoint_dir
from ledgerlens.sources.adapters import txn
from ledgerlens.streaming import jobs as J

STREAMS = ["stream_training_samples", "stream_retrain_trigger", "stream_last_txn_features", "stream_velocity",
           "stream_tagging", "stream_label_votes"]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark):
    """events as four part files in time order; other tables as they are."""
    base = f"{ensure_checkpoint_dir(spark)}/folder-{uuid.uuid4().hex}"
    ev = spark.read.parquet(f"{SF}/events.parquet")
    cut = ev.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    part = sum((F.col("event_id") > c).cast("int") for c in cut)
    for i in range(4):
        ev.where(part == i).coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    spark.read.parquet(f"{SF}/supplier.parquet").write.parquet(f"{base}/supplier.parquet")
    return base


@pytest.mark.parametrize("key", STREAMS)
def test_folder_table_equals_file_table(spark, folder, key):
    fn = load_all()[0][key]
    assert _rows(fn(spark, folder)) == _rows(fn(spark, SF))


def test_several_batches_and_restart(spark, folder):
    """One file per batch; a second start on the same folder adds nothing,
    and new files go on from the stored state."""
    base = f"{ensure_checkpoint_dir(spark)}/grow-{uuid.uuid4().hex}"
    ev = spark.read.parquet(f"{folder}/events.parquet")
    old, new = ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1")
    old.coalesce(1).write.parquet(f"{base}/events.parquet")
    jobs = {
        "last": (lambda r: J.run_batches(J.last_txn_features(J.stream_txn(spark, base, 1)), "last", "update", root=r), ["user_id"]),
        "votes": (lambda r: J.run_batches(J.velocity(J.stream_txn(spark, base, 1), lateness="400 days"), "v", "update", root=r), ["user_id", "w"]),
        "samples": (lambda r: J.run_batches(J.training_samples(J.stream_txn(spark, base, 1), "400 days"), "s", root=r), None),
        "retrain": (lambda r: J.retrain_triggers(J.training_samples(J.stream_txn(spark, base, 1), "400 days"), 100, r), None),
    }
    roots = {}
    for name, (start, keys) in jobs.items():
        roots[name] = start(None).root
        first = _rows(J.read_sink(spark, J.Run(roots[name], roots[name] + "/data"), keys))
        assert _rows(J.read_sink(spark, start(roots[name]), keys)) == first
    new.repartition(2).write.mode("append").parquet(f"{base}/events.parquet")
    old.limit(50).coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")  # repeated rows
    got = {}
    for name, (start, keys) in jobs.items():
        run = start(roots[name])
        assert run.dropped == 0
        got[name] = J.read_sink(spark, run, keys)
    t = txn(spark, folder)
    n_samples = t.select("user_id", "timestamp").distinct().count()
    assert got["samples"].count() == n_samples == got["samples"].select("sample_id").distinct().count()
    want = [(i, 100 * i) for i in range(1, n_samples // 100 + 1)]
    assert sorted(tuple(r) for r in got["retrain"].where("trigger_no is not null").select("trigger_no", "threshold").collect()) == want
    last = {r["user_id"]: r["_l"]["timestamp"] for r in got["last"].collect()}
    assert last == {r["user_id"]: r["t"] for r in t.groupBy("user_id").agg(F.max("timestamp").alias("t")).collect()}
    seen = got["last"].agg(F.sum("n_seen")).first()[0]
    assert seen == t.count() + 50  # the last-transaction counter counts repeats


def test_late_rows_are_counted(spark, folder):
    base = f"{ensure_checkpoint_dir(spark)}/late-{uuid.uuid4().hex}"
    ev = spark.read.parquet(f"{folder}/events.parquet")
    newest = ev.agg(F.max("ts")).first()[0]
    ev.where(F.col("ts") >= F.lit(newest) - F.expr("interval 1 day")).coalesce(1).write.parquet(f"{base}/events.parquet")
    run = J.run_batches(J.velocity(J.stream_txn(spark, base, 1), lateness="1 hour"), "late", "update")
    old = ev.where(F.col("ts") < F.lit(newest) - F.expr("interval 10 days"))
    old.coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    again = J.run_batches(J.velocity(J.stream_txn(spark, base, 1), lateness="1 hour"), "late", "update", root=run.root)
    assert run.dropped == 0 and again.dropped > 0


def test_a_retried_batch_replaces_its_output(spark):
    base = f"{ensure_checkpoint_dir(spark)}/retry-{uuid.uuid4().hex}"
    spark.range(10).coalesce(1).write.parquet(f"{base}/in")
    calls = []

    def flaky(batch, epoch, path):
        calls.append(epoch)
        if len(calls) == 1:
            batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
            raise RuntimeError("lost")
        return batch

    def start(root):
        return J.run_batches(spark.readStream.schema("id long").parquet(f"{base}/in"), "retry", "append", flaky, root)

    with pytest.raises(Exception, match="lost"):
        start(f"{base}/job")
    assert J.read_sink(spark, start(f"{base}/job")).count() == 10 and calls == [0, 0]


@pytest.mark.parametrize("key", ["stream_velocity", "stream_training_samples", "stream_retrain_trigger"])
def test_queries_keep_old_rows_of_later_batches(spark, folder, key, monkeypatch):
    """Part files newest first, 200 days apart, one a micro-batch."""
    base = f"{ensure_checkpoint_dir(spark)}/back-{uuid.uuid4().hex}"
    ev = spark.read.parquet(f"{folder}/events.parquet").limit(400)
    for k in range(3):
        moved = (ev.withColumn("ts", (F.col("ts") - F.expr(f"interval {200 * k} days")).cast("timestamp_ntz"))
                 .withColumn("event_id", F.col("event_id") + 10_000_000 * k))
        moved.coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    stream = J.stream_txn
    monkeypatch.setattr(J, "stream_txn", lambda spark, sf: stream(spark, sf, 1))
    got = load_all()[0][key](spark, base)
    t = txn(spark, base)
    if key == "stream_velocity":
        want = t.groupBy("user_id", F.window(F.col("timestamp").cast("timestamp"), "1 day", "6 hours")).count().count()
        assert got.count() == want and got.agg(F.sum("transactions")).first()[0] == 4 * t.count()
    elif key == "stream_training_samples":
        assert got.count() == t.select("user_id", "timestamp").distinct().count()
    else:
        assert got.count() == t.select("user_id", "timestamp").distinct().count() // 100


def _days_apart(spark, base, order):
    """A part file per day, written in the given order of days."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    first = ev.agg(F.min("ts")).first()[0].replace(hour=0, minute=0, second=0, microsecond=0)
    for d in order:
        low = F.lit(str(first)).cast("timestamp_ntz") + F.expr(f"interval {d} days")
        ev.where((F.col("ts") >= low) & (F.col("ts") < low + F.expr("interval 1 day"))).coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    return ev


@pytest.mark.parametrize("order", [list(range(30)), list(range(29, -1, -1)), [7 * d % 30 for d in range(30)]])
def test_state_stays_bounded(spark, order, monkeypatch):
    """Six days a micro-batch, in any order: late rows go to the side table,
    the others leave the state, the merged result is whole."""
    base = f"{ensure_checkpoint_dir(spark)}/days-{uuid.uuid4().hex}"
    _days_apart(spark, base, order)
    stream = J.stream_txn(spark, base, 6)
    root = J.route(stream, lateness="3 days")
    seen = []
    finish = J._finish

    def watch(query, job):
        run = finish(query, job)
        seen.extend(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
        return run

    monkeypatch.setattr(J, "_finish", watch)
    ordered = J.on_time(spark, root, stream.schema)
    run = J.whole(J.run_batches(J.training_samples(ordered, "3 days"), "samples"))
    late = J.late(spark, root, stream.schema)
    got = J.with_late_samples(J.read_sink(spark, run), late)
    t = txn(spark, base)
    n = t.select("user_id", "timestamp").distinct().count()
    assert got.count() == n == got.select("sample_id").distinct().count()
    per_day = t.groupBy(F.to_date("timestamp")).count().agg(F.max("count")).first()[0]
    assert max(seen) <= 13 * per_day  # two slices and the delay, not the month
    if order[0] == 29:
        assert late.count() > 0
    counts = J.with_late_counts(J.read_sink(spark, J.whole(J.run_batches(J.velocity(ordered, lateness="3 days"), "v", "update")), ["user_id", "w"]), late)
    want = t.groupBy("user_id", F.window(F.col("timestamp").cast("timestamp"), "1 day", "6 hours").alias("w")).agg(F.count("*").alias("transactions"))
    assert _rows(counts) == _rows(want.select("user_id", "w", "transactions"))


def test_late_samples_trigger_once(spark):
    base = f"{ensure_checkpoint_dir(spark)}/late-{uuid.uuid4().hex}"
    ev = _days_apart(spark, base, [29, 28, 0, 1])
    stream = J.stream_txn(spark, base, 1)
    root = J.route(stream, lateness="3 days")
    late = J.late(spark, root, stream.schema)
    run = J.retrain_triggers(J.training_samples(J.on_time(spark, root, stream.schema), "3 days"), 10)
    for _ in range(2):  # a repeated merge replaces its own rows
        got = J.read_sink(spark, J.late_triggers(run, late.unionByName(late), 10)).where("trigger_no is not null")
    n = txn(spark, base).select("user_id", "timestamp").distinct().count()
    assert late.count() > 10
    assert sorted(tuple(r) for r in got.select("trigger_no", "threshold").collect()) == [(i, 10 * i) for i in range(1, n // 10 + 1)]


def test_a_routed_batch_that_is_retried(spark, monkeypatch):
    base = f"{ensure_checkpoint_dir(spark)}/again-{uuid.uuid4().hex}"
    _days_apart(spark, base, [0, 9, 5])
    stream = J.stream_txn(spark, base, 1)
    root, names = f"{base}/job", J.fs.names
    calls = []

    from pyspark.sql import DataFrameWriter
    write = DataFrameWriter.parquet

    def flaky(self, path, *a, **k):
        calls.append(path)
        if "/ontime/000000001-" in path and sum("/ontime/000000001-" in c for c in calls) == 1:
            write(self, path, *a, **k)
            raise RuntimeError("lost")
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", flaky)
    with pytest.raises(Exception, match="lost"):
        J.route(stream, root, "2 days")
    J.route(stream, root, "2 days")
    rows = spark.read.schema(stream.schema).parquet(f"{root}/ontime/*").unionByName(J.late(spark, root, stream.schema))
    assert _rows(rows.select("transaction_id")) == _rows(txn(spark, base).select("transaction_id"))
    assert J.late(spark, root, stream.schema).count() > 0


def test_streamed_features_equal_batch_features(spark, folder):
    from ledgerlens.operators import featurestore as FS
    path = f"{ensure_checkpoint_dir(spark)}/fs-{uuid.uuid4().hex}"
    run = J.stream_features(J.stream_txn(spark, folder, 1), path)
    J.stream_features(J.stream_txn(spark, folder, 1), path, run.root)  # nothing new
    cols = ["feature_set", "version", "entity_id", "stored_at", "ttl_seconds", "transaction_id"]
    assert _rows(FS.stored(spark, path).select(*cols)) == _rows(FS.feature_log(txn(spark, folder)).select(*cols))
    assert spark.read.parquet(path).select("epoch").distinct().count() == 4
