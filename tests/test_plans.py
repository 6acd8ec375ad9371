import pytest

from tarnflow.plans.pipeline import Changelog, Pipeline, Plugin, logging_plugin, metrics_plugin, order_plugins, tap


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, "a", 30.0)], "id long, kind string, amount double")


def test_runs_all_sinks_from_one_input(spark, df):
    flow, seen = Pipeline("p", mode="batch"), {}
    clean = flow.source(df, name="rows").filter(condition="amount > 5")
    clean.branch("kind = 'a'").sink(lambda d: seen.update(a=d.count()))
    clean.branch().sink(lambda d: seen.update(all=d.count()))
    clean.aggregate(group_by=["kind"], select={"total": "SUM(amount)"}).sink(lambda d: seen.update(kinds=d.count()))
    flow.run(spark)
    assert seen == {"a": 2, "all": 3, "kinds": 2}
    assert flow.describe()["sources"] == ["rows"] and len(flow.describe()["sinks"]) == 3
    assert '"rows" -> "filter"' in flow.to_dot() and flow.to_text().splitlines()[0].startswith("files")


def test_steps_compile_once(df):
    calls = []
    flow = Pipeline("p", mode="batch")
    source = flow.source(lambda: calls.append(1) or df)
    source.union(source).dataframe()
    assert calls == [1]


def test_columns_are_checked(df):
    flow = Pipeline("p", mode="batch")
    flow.source(df).filter(condition="missing > 1").sink(lambda d: None)
    assert [f.level for f in flow.check()] == ["error"]
    with pytest.raises(ValueError):
        flow.run(df.sparkSession)


def test_orphans_and_sinks(df):
    flow = Pipeline("p", mode="batch")
    flow.source(df, name="lonely")
    flow.source(df, name="used").sink(lambda d: None, "keyed_table", engine="wrong")
    found = [(f.level, f.step) for f in flow.check()]
    assert ("warning", "lonely") in found and sum(level == "error" for level, _ in found) == 3


def test_changelogs(df):
    flow = Pipeline("p")
    source = flow.source(df, changelog=Changelog("retract", ("id",)))
    assert flow.changelog(source.filter(condition="true").id) == Changelog("retract", ("id",))
    assert flow.changelog(source.rename(columns={"id": "key"}).id).key == ("key",)
    assert flow.changelog(source.drop(columns=["id"]).id).key == ()
    plain = flow.source(df)
    assert flow.changelog(plain.aggregate(group_by=["kind"], select={"n": "COUNT(*)"}).id) == Changelog("retract", ("kind",))
    assert flow.changelog(plain.join(source, on="l.id = r.id").id) == Changelog("retract", ("id",))
    assert flow.changelog(source.deduplicate(key=["kind"], order="id").id).mode == "append-only"
    source.sink(lambda d: None, "files", format="parquet")
    assert any("cannot take back" in f.message for f in flow.check(columns=False))
    assert any("taken back" in f.message for f in flow.check(columns=False))


def test_options_cascade():
    flow = Pipeline("p", {"parallelism": 8, "conf": {"a": 1}}, {"parallelism": 4, "mode": "batch", "conf": {"a": 0, "b": 2}}, state_backend="rocksdb", checkpoint="10 s")
    assert flow.options["parallelism"] == 8 and flow.options["mode"] == "batch"
    conf = flow.spark_conf()
    assert conf["a"] == "1" and conf["b"] == "2" and "RocksDB" in conf["spark.sql.streaming.stateStore.providerClass"]
    assert flow.trigger() == {"processingTime": "10000 milliseconds"}
    for bad in ({"mode": "other"}, {"parallelism": 0}, {"state_backend": "x"}, {"checkpoint": "soon"}, {"unknown": 1}):
        with pytest.raises(ValueError):
            Pipeline("p", **bad)


def test_plugins(spark, df):
    lines, counts = [], {}
    double = Plugin("double", {"twice": lambda d: d.union(d)}, requires=("logging",))
    flow = Pipeline("p", mode="batch", plugins=[double, logging_plugin(lines.append), metrics_plugin(counts)])
    assert flow.source(df, name="rows").twice().dataframe().count() == 6
    assert len(lines) == 2 and counts["twice"].get == {"rows": 6}
    with pytest.raises(ValueError):
        order_plugins([Plugin("a", requires=("b",)), Plugin("b", requires=("a",))])
    with pytest.raises(ValueError):
        order_plugins([Plugin("a"), Plugin("a")])
    with pytest.raises(ValueError):
        order_plugins([Plugin("a", {"x": len}), Plugin("b", {"x": len})])
    assert tap(df, 2, ["id"], "amount > 5").count() == 2
