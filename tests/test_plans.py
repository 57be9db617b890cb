"""Graph, validation, manifest, runs, change data capture, command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from planweave import cli
from planweave.plans import InvalidPipeline, Pipeline, RunFailed, Runner, State, analyse, manifest, parse, render, schemas, seed, watch
from planweave.plans.analysis import topological
from planweave.plans.lineage import sql_reads
from planweave.streaming import cdc


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def numbers(spark, tmp_path, n=10, name="numbers"):
    path = f"{tmp_path}/{name}"
    spark.range(n).write.mode("append").parquet(path)
    return path


def kinds(spark, p):
    with pytest.raises(InvalidPipeline) as e:
        analyse(spark, p)
    assert str(e.value).startswith("pipeline graph is invalid:\n  - ")
    return [x.kind for x in e.value.problems]


def view(p, name, *reads, stream=False, flow=None):
    def body(spark):
        dfs = [spark.readStream.table(r) if stream else spark.table(r) for r in reads]
        return dfs[0]

    (p.append_flow(name, flow) if flow else p.streaming_table(name) if stream else p.materialized_view(name))(body)


def test_topological_order_is_sorted_and_finds_cycles():
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    for _ in range(5):
        random.shuffle(edges)
        assert topological(["d", "c", "b", "a"], edges) == (["a", "b", "c", "d"], None)
    assert topological(["a", "b"], [("a", "b"), ("b", "a")])[1] == ["a", "b", "a"]
    assert topological(["a"], [("a", "a")])[1] == ["a", "a"]


def test_problems_are_collected(spark):
    p = Pipeline()
    view(p, "a", "gone", "lost")
    view(p, "a2", "a")
    view(p, "nowhere_target", "a", flow="stray")
    view(p, "b", "c")
    view(p, "c", "b")
    p.external("x", "/nowhere")
    p.external("x", "/nowhere")
    p.materialized_view_sql("mv", "SELECT 1 AS one")
    p.create_auto_cdc_flow("mv", "missing", [], "seq")
    assert set(kinds(spark, p)) == {"UnknownFlowTarget", "DuplicateNode", "DanglingEdges", "CycleDetected", "AutoCdcTargetNotStreamingTable", "AutoCdcKeysEmpty"}


def test_duplicate_flow(spark, tmp_path):
    p = Pipeline()
    p.external("numbers", numbers(spark, tmp_path))
    p.create_streaming_table("t")
    view(p, "t", "numbers", stream=True, flow="f")
    view(p, "t", "numbers", stream=True, flow="f")
    assert kinds(spark, p) == ["DuplicateFlow"]


def test_column_problems_come_after_structure(spark, tmp_path):
    p = Pipeline()
    p.external("numbers", numbers(spark, tmp_path))
    p.materialized_view("typo")(lambda spark: spark.table("numbers").select("ide"))
    assert kinds(spark, p) == ["UnknownColumn"]
    p.materialized_view("again")(lambda spark: spark.table("nothing"))
    assert kinds(spark, p) == ["DanglingEdges"]


def test_streams_and_batches_must_fit(spark, tmp_path):
    p = Pipeline()
    p.external("numbers", numbers(spark, tmp_path))
    p.materialized_view("mv")(lambda spark: spark.readStream.table("numbers"))
    p.streaming_table("st")(lambda spark: spark.table("numbers"))
    p.materialized_view("fine")(lambda spark: spark.table("numbers"))
    p.streaming_table("rewritten")(lambda spark: spark.readStream.table("fine"))
    assert sorted(kinds(spark, p)) == ["BatchIntoStream", "StreamIntoBatch", "StreamOfRewritten"]


def test_inline_limit_is_a_problem(spark):
    from planweave import sources as src

    p = Pipeline()
    p.materialized_view("big")(lambda s: src.inline(spark, [(k,) for k in range(1001)]))
    assert kinds(spark, p) == ["InlineTableTooLarge"]


def test_sql_lineage(spark):
    sql = "WITH a AS (SELECT * FROM x) SELECT * FROM a JOIN db.y ON a.id = y.id WHERE a.id IN (SELECT id FROM STREAM(z))"
    assert sql_reads(spark, sql) == [("db.y", False), ("x", False), ("z", True)]


def sample(spark, path):
    p = Pipeline()
    p.external("numbers", path)
    p.materialized_view("even")(lambda spark: spark.table("numbers").where("id % 2 = 0"))
    p.streaming_table("all")(lambda spark: spark.readStream.table("numbers"))
    p.materialized_view_sql("n", "SELECT count(*) AS n, '| ü %\n' AS s FROM even")
    return p


def test_sql_reads_dotted_names(spark, tmp_path, root):
    p = Pipeline()
    p.external("bronze.e", numbers(spark, tmp_path))
    p.external("silver.e", numbers(spark, tmp_path, 5, "others"))
    p.external("e", numbers(spark, tmp_path, 3, "plain"))
    p.external("gold.Kinds", numbers(spark, tmp_path, 4, "kinds"))
    p.materialized_view_sql("a", "SELECT bronze.e.id, x.id AS other, 'bronze.e' AS name FROM bronze.e JOIN `silver` . `e` AS x ON bronze.e.id = x.id -- bronze.e")
    p.materialized_view_sql("b", "WITH kinds AS (SELECT id FROM gold.kinds) SELECT k.id FROM kinds k WHERE EXISTS (SELECT 1 FROM bronze.e y WHERE y.id = k.id) AND id IN (SELECT id FROM e)")
    p.materialized_view_sql("c", "SELECT Kinds.id, gold.Kinds.id + 1 AS next FROM gold.Kinds")
    p.streaming_table_sql("d", "SELECT q.id FROM STREAM(bronze.e) AS q WHERE q.id > 7")
    with pytest.raises(InvalidPipeline) as wrong:
        analyse(spark, p)  # names are as written
    assert [x.kind for x in wrong.value.problems] == ["DanglingEdges"]
    p.flows[1] = type(p.flows[1])("b", "b", sql=p.flows[1].sql.replace("gold.kinds", "gold.Kinds"))
    runner = Runner(spark, p, root)
    runner.run()
    rows = lambda n: sorted(tuple(r) for r in runner.resolve(n, False).collect())
    assert rows("a") == [(k, k, "bronze.e") for k in range(5)] and rows("b") == [(k,) for k in range(3)]
    assert rows("c") == [(k, k + 1) for k in range(4)] and rows("d") == [(8,), (9,)]
    p.materialized_view_sql("broken", "SELECT nothing FROM silver.e")
    assert kinds(spark, p) == ["UnknownColumn"]


def test_a_dry_run_finds_streams_that_can_not_append(spark, tmp_path, root):
    p = Pipeline()
    p.external("numbers", numbers(spark, tmp_path))

    @p.streaming_table()
    def counted(spark):
        return spark.readStream.table("numbers").groupBy("id").count()

    p.streaming_table_sql("ordered", "SELECT id FROM STREAM(numbers) ORDER BY id")
    view(p, "fine", "numbers", stream=True)
    runner = Runner(spark, p, root)
    assert len(runner.validate().order) == 4  # the graph is valid
    with pytest.raises(InvalidPipeline) as e:
        runner.dry_run()
    assert [(x.kind, x.about) for x in e.value.problems] == [("UnsupportedStream", "counted"), ("UnsupportedStream", "ordered")]
    assert all("append" in x.message or "Sorting" in x.message for x in e.value.problems)
    with pytest.raises(RunFailed):
        runner.run()


def test_manifest_is_stable_and_round_trips(spark, tmp_path):
    p = sample(spark, numbers(spark, tmp_path))
    text = manifest(analyse(spark, p))
    back = Pipeline(list(reversed(p.datasets)), list(reversed(p.flows)))
    assert manifest(analyse(spark, back)) == text == render(parse(text))
    body = json.loads(text)
    assert ["even", "n"] in body["edges"] and ["numbers", "even"] in body["edges"] and str(tmp_path) not in text
    with pytest.raises(ValueError):
        parse('{"version": 9}')


def test_merge_is_commutative(spark, tmp_path):
    a, b = sample(spark, numbers(spark, tmp_path)), Pipeline()
    b.materialized_view("odd")(lambda spark: spark.table("numbers").where("id % 2 = 1"))
    assert manifest(analyse(spark, a + b)) == manifest(analyse(spark, b + a))


def test_runs_are_incremental_and_views_fresh(spark, tmp_path, root):
    path = numbers(spark, tmp_path)
    runner = Runner(spark, sample(spark, path), root, timeout=None)
    events = runner.run()
    assert [e.state for e in events if e.flow == "n"] == [State.QUEUED, State.STARTING, State.COMPLETED]
    numbers(spark, tmp_path)
    runner.run()
    assert runner.resolve("all", False).count() == 20 and runner.resolve("n", False).first()["n"] == 10
    numbers(spark, tmp_path)
    events = runner.run(only=["all"])
    assert {e.flow for e in events if e.state is State.EXCLUDED} == {"even", "n"}
    assert runner.resolve("all", False).count() == 30 and runner.resolve("n", False).first()["n"] == 10
    runner.run(full_refresh=True)
    assert runner.resolve("all", False).count() == 30 and runner.resolve("n", False).first()["n"] == 15
    # a new process: nothing but the root is known
    assert Runner(spark, sample(spark, path), root, timeout=None).run()
    with pytest.raises(ValueError):
        runner.run(only=["none"])


def test_once_runs_once_until_refreshed(spark, tmp_path, root):
    path, p = numbers(spark, tmp_path), Pipeline()
    p.external("numbers", path)
    p.table("copy", once=True)(lambda spark: spark.table("numbers"))
    p.streaming_table("log", once=True)(lambda spark: spark.table("numbers"))
    runner = Runner(spark, p, root)
    runner.run()
    numbers(spark, tmp_path)
    runner.run()
    assert [runner.resolve(n, False).count() for n in ("copy", "log")] == [10, 10]
    runner.run(full_refresh=["copy"])
    assert [runner.resolve(n, False).count() for n in ("copy", "log")] == [20, 10]


def test_interrupted_swap_is_restored(spark, tmp_path, root):
    runner = Runner(spark, sample(spark, numbers(spark, tmp_path)), root)
    runner.run()
    runner.storage._move(runner.storage.data("even"), runner.storage.data("even") + ".old")
    assert runner.resolve("even", False).count() == 5
    runner.run()
    assert runner.resolve("even", False).count() == 5


def test_failures_carry_events(spark, tmp_path, root):
    p = Pipeline()
    p.external("numbers", numbers(spark, tmp_path))
    p.materialized_view("bad")(lambda spark: spark.table("numbers").select(F.assert_true(F.col("id") < 5).alias("x")))
    runner = Runner(spark, p, root)
    with pytest.raises(RunFailed) as e:
        watch(runner, every=0, times=3)
    assert e.value.events[-1].state is State.FAILED and State.FAILED.terminal and not State.RUNNING.terminal


def test_registered_tables(spark, tmp_path, root):
    Runner(spark, sample(spark, numbers(spark, tmp_path)), root, register=True).run()
    assert spark.table("n").first()["n"] == 5
    for name in ("n", "even", "all"):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")


COLUMNS = ["k", "a", "b"]


def cdc_flow(**more):
    p = Pipeline()
    p.create_auto_cdc_flow("t", "s", ["k"], "seq", apply_as_deletes="op = 'D'", apply_as_truncates="op = 'T'", column_list=COLUMNS, **more)
    return p.flows[0]


def expected(rows, ignore):
    """The changes applied one after another."""
    state = {}
    for seq, op, k, a, b in sorted(rows):
        if op == "T":
            state = {}
        elif op == "D":
            state.pop(k, None)
        else:
            old = state.get(k, (None, None))
            state[k] = tuple(o if n is None and ignore else n for n, o in zip((a, b), old))
    return sorted((k, *v) for k, v in state.items())


@pytest.mark.parametrize("ignore", [False, True])
def test_cdc_does_not_depend_on_order_or_batches(spark, tmp_path, root, ignore):
    rng = random.Random(11)
    rows = [(seq, rng.choice("UUUUUDDT" if seq % 9 == 0 else "UUUUD"), rng.randint(1, 4), rng.choice([None, seq]), rng.choice([None, -seq])) for seq in range(36)]
    want = expected(rows, ignore)
    for attempt in range(2):
        order = rows[:]
        rng.shuffle(order)
        source, p = f"{tmp_path}/s{attempt}", Pipeline()
        p.create_streaming_table("t")
        p.external("s", source)
        p.create_auto_cdc_flow("t", "s", ["k"], "seq", apply_as_deletes="op = 'D'", apply_as_truncates="op = 'T'", column_list=COLUMNS, ignore_null_updates=ignore)
        runner = Runner(spark, p, f"{root}{attempt}", timeout=None)
        for part in (order[:15], order[15:]):
            spark.createDataFrame(part, "seq int, op string, k int, a int, b int").coalesce(1).write.mode("append").parquet(source)
            runner.run()
        assert sorted((tuple(r) for r in runner.resolve("t", False).select(COLUMNS).collect()), key=repr) == sorted(want, key=repr)


def test_a_once_cdc_flow_runs_until_a_full_refresh_only(spark, tmp_path, root):
    source, p = f"{tmp_path}/s", Pipeline()
    p.create_streaming_table("t")
    p.external("s", source)
    p.create_auto_cdc_flow("t", "s", ["k"], "seq", column_list=["k", "a"], once=True)
    runner, keys = Runner(spark, p, root, timeout=None), []
    for k, refresh in ((1, False), (2, False), (3, True)):
        spark.createDataFrame([(k, k, k)], "seq int, k int, a int").coalesce(1).write.mode("append").parquet(source)
        runner.run(full_refresh=refresh)
        keys.append(sorted(r["k"] for r in runner.resolve("t", False).collect()))
    assert keys == [[1], [1], [1, 2, 3]]


def test_cdc_rewrites_only_the_buckets_that_a_batch_touches(spark, tmp_path, root):
    path = f"{tmp_path}/log"
    log = lambda rows: spark.createDataFrame(rows, "k long, seq long, v string").coalesce(1).write.mode("append").parquet(path)
    log([(k, 1, f"v{k}") for k in range(400)])
    p = Pipeline()
    p.external("log", path)
    p.create_streaming_table("now")
    p.create_auto_cdc_flow("now", "log", ["k"], "seq")
    runner = Runner(spark, p, root)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "128")
    runner.run()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)  # the state keeps its number of buckets
    flow = next(f.name for f in p.flows)
    state = tmp_path / "store" / "state" / flow / "rows"
    before = {f: f.stat().st_mtime_ns for f in state.rglob("*.parquet")}
    log([(7, 2, "new")])
    runner.run()
    after = {f: f.stat().st_mtime_ns for f in state.rglob("*.parquet")}
    assert len(before) > 100 and len(before.keys() & after.keys()) == len(before) - 1 == len(after) - 1
    rows = {r["k"]: r["v"] for r in runner.resolve("now", False).collect()}
    assert rows == {k: f"v{k}" for k in range(400)} | {7: "new"}
    data = {f for f in (tmp_path / "store" / "data").rglob("*.parquet")}
    runner.run()  # nothing new: the target stays as it is
    assert data == {f for f in (tmp_path / "store" / "data").rglob("*.parquet")}


def test_a_stream_that_takes_longer_is_left_running(spark, tmp_path, root):
    def slowly(batches):
        import time

        for b in batches:
            time.sleep(4)
            yield b

    p = Pipeline()
    p.external("numbers", numbers(spark, tmp_path))

    @p.streaming_table()
    def slow(spark):
        return spark.readStream.table("numbers").mapInArrow(slowly, "id long")

    events = Runner(spark, p, root, timeout=0).run()
    try:
        assert (events[-1].flow, events[-1].state) == ("slow", State.RUNNING)
    finally:
        for q in spark.streams.active:
            q.processAllAvailable()
            q.stop()


def test_watch_runs_until_it_is_told_or_fails(spark, tmp_path, root):
    p, waits = Pipeline(), []
    p.external("numbers", numbers(spark, tmp_path))
    view(p, "copied", "numbers", stream=True)
    runner = Runner(spark, p, root)

    def wait(seconds):
        waits.append(seconds)
        numbers(spark, tmp_path)  # ten more rows before each further run

    assert watch(runner, every=5, times=3, sleep=wait) == 3 and waits == [5, 5]
    assert runner.resolve("copied", False).count() == 30


def test_cdc_columns():
    flow = cdc_flow()
    assert cdc.payload(["k", "a", "b", "op"], flow) == COLUMNS
    with pytest.raises(ValueError):
        cdc_flow(stored_as_scd_type=2)


def test_schema_source(spark, tmp_path):
    plan = analyse(spark, sample(spark, numbers(spark, tmp_path)))
    source = schemas.render(plan.schemas)
    assert source == schemas.render(dict(reversed(plan.schemas.items())))
    made = schemas.namespace(source)
    assert made["Even"].id == "id" and made["N"].DATASET == "n"
    with pytest.raises(AttributeError):
        schemas.Columns(plan.schemas["n"]).typo  # noqa: B018


def test_seed_names_the_failing_statement(spark):
    assert seed(spark, ["SELECT 1", "SELECT 2"]) == 2
    with pytest.raises(RuntimeError, match="statement 2 failed: SELECT nope"):
        seed(spark, ["SELECT 1", "SELECT nope"])


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import tests.test_plans as module

    monkeypatch.setattr(module, "made", lambda: sample(spark, numbers(spark, tmp_path)), raising=False)
    monkeypatch.setenv("PLANWEAVE_STORAGE", f"file://{tmp_path}/cli")
    go = lambda *a: cli.main(["tests.test_plans:made", *a], spark)
    assert go("validate") == 0 and "valid: 4 datasets" in capsys.readouterr().out
    assert go("manifest", "--out", f"{tmp_path}/deep/m.json") == 0 and parse((tmp_path / "deep/m.json").read_text())
    assert go("run", "--dry") == 0 and go("run") == 0 and "n: completed" in capsys.readouterr().out
    assert go("import-schemas") == 0 and "class Even" in capsys.readouterr().out
    assert cli.main([], spark) == 0 and cli.main(["x", "nonsense"], spark) == 1
    assert cli.main(["x", "coverage"], spark) == 0 and "drift" not in capsys.readouterr().out
    monkeypatch.setenv("PLANWEAVE_CATALOG", "no_such_catalog")
    assert go("validate") == 1 and "no_such_catalog" in capsys.readouterr().err
    monkeypatch.setenv("PLANWEAVE_CATALOG", "spark_catalog")
    monkeypatch.setenv("PLANWEAVE_DATABASE", "default")
    assert go("validate") == 0
    monkeypatch.setattr(module, "made", Pipeline, raising=False)
    p = Pipeline()
    p.materialized_view("a")(lambda s: s.table("b"))
    monkeypatch.setattr(module, "made", lambda: p, raising=False)
    assert go("validate") == 1 and "not declared: b" in capsys.readouterr().err
