"""Streams against their batch twins on the same arrivals."""

from storyrank.operators import feedback as fb
from storyrank.operators import tables as tb
from storyrank.session import scratch
from storyrank.streaming import jobs as st

ITEMS = "id string, source string, family string, published_at timestamp, fetched_at timestamp, no long, embedding array<float>"


def land(spark, parts, schema):
    path = scratch(spark, "arrivals")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def test_ingest_equals_upsert_of_the_same_arrivals(spark):
    import datetime as dt

    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    parts = [
        [("a", "old", "meta", day(1), day(1), 1, [1.0]), ("b", "x", "academia", day(1), day(4), 2, None), ("n", None, None, None, None, 3, None)],
        [("a", "new", "meta", day(3), day(3), 4, None), ("c", "c1", "meta", day(1), day(9), 5, [3.0]), ("c", "c2", "meta", day(2), day(2), 6, None)],
        [("a", "between", "meta", day(2), day(5), 7, [2.0]), ("b", "x2", "academia", day(2), day(9), 8, [5.0])],
    ]
    stream, landed = land(spark, parts, ITEMS)
    log, late = scratch(spark, "log"), scratch(spark, "late")
    st.stream_ingest(stream, log, scratch(spark, "ckpt"), ["published_at", "no"], late)
    want = tb.upsert_items(landed.limit(0), landed, ["published_at", "no"])
    names = ["id", "source", "family", "published_at", "no", "embedding"]
    key = lambda r: r[0]
    assert sorted(map(tuple, st.ingested(spark, log).select(*names).collect()), key=key) == sorted(map(tuple, want.select(*names).collect()), key=key)
    assert sorted(r["no"] for r in st.read_log(spark, late).collect()) == sorted(
        r["no"] for r in landed.filter(~st.on_time()).collect()) == [3, 5, 7, 8]


def test_compacted_log_reads_the_same(spark):
    log, target = scratch(spark, "log"), scratch(spark, "compact")
    for batch in range(3):
        spark.range(batch, 10).selectExpr("id", f"{batch} AS v").write.parquet(f"{log}/batch={batch}")
    st.compact_log(spark, log, target, ["id"], ["batch"])
    assert st.read_log(spark, target).count() == 10
    assert sorted(map(tuple, st.ingested(spark, target).collect())) == sorted(map(tuple, st.ingested(spark, log).collect()))


def test_boosts_need_no_date_and_forget(spark):
    import datetime as dt

    kind = "target_id string, signal string, value double, created_at timestamp"
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    parts = [[("s", "up", 1.0, at(0)), ("t", "down", 1.0, at(0)), ("u", "up", 1.0, None)], [("s", "up", 1.0, at(20)), ("s", "down", 1.0, at(10))],
             [("s", "click", 1.0, at(30))], [("v", "up", 1.0, at(3000))], [("v", "up", 1.0, at(3001))]]
    stream, landed = land(spark, parts, kind)
    log = scratch(spark, "log")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        st.stream_boosts(stream, log, scratch(spark, "ckpt"), delay="60 days")
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r["target_id"]: r["boost"] for r in st.boosts_at(spark, log, "2032-06-01 00:00:00").collect()}
    want = {r["target_id"]: r["boost"] for r in fb.feedback_boosts(landed.filter("created_at IS NOT NULL"), "2032-06-01 00:00:00").collect()}
    assert set(got) == {"v"} and abs(got["v"] - want["v"]) < 1e-9  # the others have decayed to nothing
    full = st.read_log(spark, log).filter("target_id = 's' AND NOT forgotten").orderBy("batch").collect()
    assert len(full) == 3
