import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargolens.operators.sessions import CARRIED, carry
from cargolens.sources.stored import Stored
from cargolens.streaming import sessions
from cargolens.streaming.sessions import session_stream

SCHEMA = "conv_id long, turn long, text string, ts timestamp"
START = dt.datetime(2026, 3, 1)


def run(spark, folder, batches, **options):
    """Feeds the batches one after another; the values of all rows put out, by conversation and turn."""
    source, out = str(folder / "in"), str(folder / "out")
    for i, rows in enumerate(batches):
        rows = [(c, t, text, START + dt.timedelta(minutes=m)) for c, t, text, m in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/{i}")
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.streaming.stateStore.providerClass": sessions.ROCKSDB}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        turns = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        writer = session_stream(turns, **options).writeStream.format("parquet").option("path", out)
        query = writer.option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert query.exception() is None
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len({(r["conv_id"], r["turn"]) for r in rows})
    return {(r["conv_id"], r["turn"]): r for r in rows}


@pytest.fixture
def talk():
    """Turns of five conversations."""
    said = ["give me order MRP3301", "and what of tax", "list confirmed orders in Texas for customer code AB1", "the same again", "how are you"]
    return [(c, t, said[(c + t) % 5], t) for c in range(5) for t in range(8)]


def test_stream_equals_batch(spark, tmp_path, talk):
    got = run(spark, tmp_path, [[r for r in talk if r[1] < 4], [r for r in talk if r[1] >= 4]])
    batch = carry(spark.createDataFrame([r[:3] for r in talk], "conv_id long, turn long, text string"))
    want = {(r["conv_id"], r["turn"]): r for r in batch.collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert r["n_turns"] == key[1] + 1
        assert [r[f"{c}_in_force"] for c in CARRIED] == [want[key][f"{c}_in_force"] for c in CARRIED]
    assert any(r["state_in_force"] == "TX" for r in got.values())


def test_late_turns_are_dropped_and_idle_sessions_forgotten(spark, tmp_path):
    first = [(1, 0, "give me order MRP1", 0), (2, 0, "give me order MRP2", 0)]
    second = [(1, 1, "what of its freight", 5), (3, 0, "hello", 600)]
    third = [(3, 1, "hello", 601)]
    fourth = [(2, 1, "what of its freight", 660), (4, 0, "too late", 30), (3, 2, "hello", 661)]
    got = run(spark, tmp_path, [first, second, third, fourth], timeout="2 hours", delay="1 hour")
    assert got.keys() == {(1, 0), (2, 0), (1, 1), (3, 0), (3, 1), (2, 1), (3, 2)}
    assert got[1, 1]["order_token_in_force"] == "MRP1"
    assert got[2, 1]["order_token_in_force"] is None and got[2, 1]["n_turns"] == 1
    assert got[3, 2]["n_turns"] == 3


def test_any_cut_into_batches_gives_the_same_rows(spark, tmp_path):
    ask, lean = "give me order MRP{}", "what of its freight"
    turns = [(2, 0, ask.format(2), 0), (5, 0, ask.format(5), 1), (5, 1, lean, 100), (3, 0, "hello", 600), (2, 1, lean, 660), (5, 2, lean, 661), (2, 2, ask.format(7), 700), (2, 3, lean, 819), (2, 4, lean, 940)]
    cuts = {"one": [9], "two": [4, 5], "four": [2, 2, 1, 4], "unlucky": [4, 1, 4]}
    results = {}
    for name, sizes in cuts.items():
        batches, at = [], 0
        for n in sizes:
            batches.append(turns[at : at + n])
            at += n
        (tmp_path / name).mkdir()
        got = run(spark, tmp_path / name, batches, timeout="2 hours", delay="1 hour")
        results[name] = {k: (r["n_turns"], r["order_token_in_force"]) for k, r in got.items()}
    want = {(2, 0): (1, "MRP2"), (5, 0): (1, "MRP5"), (5, 1): (2, "MRP5"), (3, 0): (1, None), (2, 1): (1, None), (5, 2): (1, None), (2, 2): (2, "MRP7"), (2, 3): (3, "MRP7"), (2, 4): (1, None)}
    assert all(r == want for r in results.values()), results


def test_the_state_store_is_asked_for(spark):
    turns = spark.readStream.format("rate").load().selectExpr("value AS conv_id", "value AS turn", "'x' AS text", "timestamp AS ts")
    with pytest.raises(ValueError, match="RocksDB"):
        session_stream(turns)


def test_sessions_are_stored_once_a_batch(spark, tmp_path):
    store = sessions.session_store(spark, str(tmp_path / "s"))
    shape = "conv_id long, turn long, role string, text string"
    first = spark.createDataFrame([(c, t, "user", f"{c}.{t}") for c in range(3) for t in range(15)], shape)
    second = spark.createDataFrame([(c, t, None, f"{c}.{t}") for c in (1, 7) for t in range(15, 30)], shape)
    assert sessions.upsert(store, first, 0, "monday") and sessions.upsert(store, second, 1, "tuesday")
    rows = lambda: sorted((r["conv_id"], [t["turn"] for t in r["turns"]], r["created_at"], r["updated_at"]) for r in store.read().collect())
    want = [(0, [*range(15)], "monday", "monday"), (1, [*range(10, 30)], "monday", "tuesday"), (2, [*range(15)], "monday", "monday"), (7, [*range(15, 30)], "tuesday", "tuesday")]
    assert rows() == want
    # a batch that comes again changes nothing, a new one does
    version = store.manifest()["version"]
    assert not sessions.upsert(store, second, 1, "friday") and not sessions.upsert(store, first, 0, "friday")
    assert rows() == want and store.manifest()["version"] == version
    # through a stream, twice from its beginning
    source = str(tmp_path / "in")
    for i, df in enumerate((first, second)):
        df.coalesce(1).write.parquet(f"{source}/{i}")
    streamed = sessions.session_store(spark, str(tmp_path / "t"))
    for cp in ("a", "b"):
        turns = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        step = sessions.upsert_stream(streamed, lambda batch: ["monday", "tuesday"][batch])
        query = turns.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / cp)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    store = streamed
    assert rows() == want


def test_stored_tables(spark, tmp_path):
    t = Stored(spark, str(tmp_path / "t"), "x int, namespace string")
    rows = lambda: sorted(map(tuple, t.read().collect()), key=repr)
    assert rows() == []
    t.write(spark.createDataFrame([(1, "a b"), (2, "c/d"), (3, None)], "x int, namespace string"))
    assert rows() == [(1, "a b"), (2, "c/d"), (3, None)]
    before = t.read()
    t.write(spark.createDataFrame([(4, "c/d")], "x int, namespace string"), replace=False)
    t.write(spark.createDataFrame([(5, "e")], "x int, namespace string"), values=["a b", "e", "nothing"])
    assert rows() == [(2, "c/d"), (3, None), (4, "c/d"), (5, "e")]
    assert sorted(map(tuple, before.collect()), key=repr) == [(1, "a b"), (2, "c/d"), (3, None)]  # a reader keeps what it began with
    assert "PartitionFilters: [isnotnull(namespace" in t.read().filter(F.col("namespace") == "e")._jdf.queryExecution().toString()
    # a job that fails on the way leaves what was there
    bad = spark.createDataFrame([(6, "e")], "x int, namespace string").withColumn("x", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        t.write(bad)
    assert rows() == [(2, "c/d"), (3, None), (4, "c/d"), (5, "e")]
    assert t.vacuum() and rows() == [(2, "c/d"), (3, None), (4, "c/d"), (5, "e")]
    # of two writers from one manifest the second fails
    other, real = Stored(spark, t.path, t.schema), t.manifest()
    t.write(spark.createDataFrame([(7, "f")], "x int, namespace string"))
    other.manifest = lambda: real
    with pytest.raises(RuntimeError, match="another writer"):
        other.write(spark.createDataFrame([(8, "f")], "x int, namespace string"))
    assert (7, "f") in rows() and (8, "f") not in rows()
