from skein.plans import reports
from tests.conftest import rows


def test_chains(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 0), ("c", 0), ("d", None)], "r string, p int")
    assert rows(reports.chains_complete(df, "r", "p")) == [("a", 2, True), ("b", 2, False), ("c", 2, False), ("d", 1, False)]


def test_weakest_and_verdict(spark):
    df = spark.createDataFrame([("t", "full"), ("t", "partial"), ("u", "full"), ("v", None)], "k string, s string")
    assert rows(reports.weakest(df, "k", "s", ("none", "partial", "full"))) == [("t", "partial"), ("u", "full"), ("v", None)]
    rules = [({"STALE"}, "stale"), ({"SCOPE", "EXTRA"}, "exceeded")]
    df = spark.createDataFrame([("p", "SCOPE"), ("p", "STALE"), ("q", "EXTRA"), ("r", "fine"), ("s", None)], "k string, c string")
    assert rows(reports.first_verdict(df, "k", "c", rules, "ok")) == [("p", "stale"), ("q", "exceeded"), ("r", "ok"), ("s", "ok")]


def test_stateful_lifecycle(spark, tmp_path):
    from skein.streaming.sync import diagnostic_lifecycle

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "subject string, index_version string"
    got = []
    for i, data in enumerate([[("a", "v1"), ("a", "v2"), ("b", "v1")], [("a", "v3"), ("a", "v3"), ("c", None)]]):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        query = (
            diagnostic_lifecycle(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
            .foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).start()
        )
        query.awaitTermination()
    assert sorted(got) == [("a", "v1", "v2", 2), ("a", "v1", "v3", 3), ("b", "v1", "v1", 1)]
