import re

import pytest
from pyspark.sql.types import DoubleType, StringType

from tidemark.plans import catalog
from tidemark.plans.datasets import LINE_NUMERIC, line_rows
from tidemark.plans.ranking import scored
from tidemark.plans.streams import _enumerating_miner
from tidemark.session import few_listing_tasks, scratch_path
from tidemark.sources import arff, reports, streams
from tidemark.streaming import prequential as pq
from tidemark.streaming.test_then_train import TestThenTrain

MINI = """@relation mini
@attribute size real [0, 10]
@attribute colour {red, green, blue}
@attribute class {pos, neg}
@data
0,red,pos
2.5,green,pos
5,red,neg
7.6,?,neg
10,blue,neg
?,red,pos
"""


@pytest.fixture()
def mini_file(tmp_path):
    path = tmp_path / "mini.arff"
    path.write_text(MINI)
    return str(path)


def test_arff(spark, mini_file):
    schema = arff.arff_schema(spark, mini_file)
    assert [(f.name, type(f.dataType)) for f in schema] == [("size", DoubleType), ("colour", StringType), ("class", StringType)]
    assert arff.class_column(schema) == "class"
    assert arff.arff_header(spark, mini_file)[1][2] == ["red", "green", "blue"]
    rows = arff.read_arff(spark, mini_file).collect()
    assert len(rows) == 6 and rows[3].colour is None and rows[5].size is None and rows[1].size == 2.5


def test_malformed_lines_fail(spark, tmp_path):
    path = tmp_path / "bad.arff"
    path.write_text(MINI + "x,red,pos\n")
    with pytest.raises(Exception):
        arff.read_arff(spark, str(path)).collect()


def test_stream_lines(spark, mini_file):
    schema = arff.arff_schema(spark, mini_file)
    lines = spark.createDataFrame([("7.5,red,pos",), ("?,blue,neg",)], "value string")
    rows = arff.parse_stream_lines(lines, schema).collect()
    assert [(r.size, r.colour) for r in rows] == [(7.5, "red"), (None, "blue")]


def test_state_is_versioned_and_replays_give_the_same(spark, sf):
    rows = line_rows(spark, sf).select("l_orderkey", *LINE_NUMERIC, "cls").orderBy("l_orderkey")
    first, second = rows.filter("l_orderkey % 2 = 0"), rows.filter("l_orderkey % 2 = 1")

    def loop():
        return TestThenTrain(scratch_path(spark, "t"), LINE_NUMERIC, {}, "cls", confidence=0.99, history_batches=1, miner=_enumerating_miner)

    once = loop()
    once.process(first, 0)
    once.process(second, 1)
    again = loop()
    again.process(first, 0)
    again.process(second, 1)
    again.process(second, 1)  # replay of a batch
    for table in ("bounds", "model", "scores", "history"):
        a = sorted(map(str, once.table(spark, table).collect()))
        b = sorted(map(str, again.table(spark, table).collect()))
        assert a == b and a
    assert {r["class"] for r in once.table(spark, "model").collect()} == {"high", "low"}


def test_search_is_the_default_miner(spark, sf):
    """Second batch: the old patterns open the population and the history rewards them."""
    rows = line_rows(spark, sf).select("l_orderkey", *LINE_NUMERIC, "cls")
    options = {"size": 9, "evaluations": 18}
    loop = TestThenTrain(scratch_path(spark, "t"), LINE_NUMERIC, {}, "cls", confidence=1.01, history_batches=2, search_options=options)
    loop.process(rows.filter("l_orderkey % 2 = 0"), 0)
    loop.process(rows.filter("l_orderkey % 2 = 1"), 1)
    assert {r["class"] for r in loop.table(spark, "model").filter("batch_id = 1").collect()} == {"high", "low"}
    assert loop.table(spark, "history").count() == loop.table(spark, "scores").count() > 0


def test_streaming_loop_stops(spark, sf):
    rows = line_rows(spark, sf).select("l_orderkey", "l_linenumber", *LINE_NUMERIC, "cls")
    target = scratch_path(spark, "loop")
    stored = streams.replay(rows, target, ["l_orderkey", "l_linenumber"], 1500)
    assert stored.select("batch_id").distinct().count() == 4
    stream = streams.read_stream(spark, "parquet", target, stored.schema, files_per_batch=1)
    loop = TestThenTrain(scratch_path(spark, "state"), LINE_NUMERIC, {}, "cls", miner=_enumerating_miner)
    loop.run(stream, scratch_path(spark, "cp"))
    assert loop.seen == 6000
    assert loop.table(spark, "summary").count() == 3
    assert loop.table(spark, "summary").filter("n_rules = 10").count() == 3


def test_a_class_whose_mining_failed_keeps_its_patterns(spark, sf):
    model = scored(spark, sf, ["confidence"]).select("pattern_id", "class", "masks")
    wanted = spark.createDataFrame([("high",), ("low",)], "class string")
    only_low = model.filter("class = 'low'").limit(1)
    out = pq.replace_class_patterns(model, only_low, wanted)
    assert out.filter("class = 'low'").count() == 1
    assert out.filter("class = 'high'").count() == model.filter("class = 'high'").count()


def test_reports_are_written(spark, sf, tmp_path):
    patterns = scored(spark, sf, ["confidence"])
    reports.write_table(reports.training_report(patterns, ["confidence"]), str(tmp_path / "train"))
    back = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "train"))
    assert back.count() == patterns.count() and back.columns == ["rule_no", "id", "class", "confidence"]
    from tidemark.plans.datasets import line_cube

    reports.write_rules(reports.render_rules(patterns, line_cube(spark, sf)[1]), str(tmp_path / "rules"))
    assert spark.read.text(str(tmp_path / "rules")).filter("value LIKE 'IF %'").count() == patterns.count()


def test_flagship_and_names(spark, sf):
    df = catalog.QUERIES["flagship"](spark, sf)
    assert df.count() > 0 and "pattern_id" in df.columns
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_stream_cube_takes_many_pieces_per_trigger(spark, sf, monkeypatch):
    from tidemark.plans import streams as plans
    from tidemark.plans.datasets import line_cube

    made = {}
    monkeypatch.setattr(plans, "REPLAY", 500)
    monkeypatch.setattr(plans, "scratch_path", lambda s, n: made.setdefault(n, scratch_path(s, n)))
    got = sorted(map(str, plans.stream_cube(spark, sf).collect()))
    cube, layout = line_cube(spark, sf)
    assert got == sorted(map(str, cube.select(*layout.words, "class", "n").collect()))
    stored = spark.read.parquet(made["stream"]).select("batch_id").distinct().count()
    triggers = spark.read.parquet(made["cubes"]).select("batch_id").distinct().count()
    assert stored == 12 and triggers == 1
    monkeypatch.setattr(plans, "TOGETHER", 5)
    made.clear()
    assert got == sorted(map(str, plans.stream_cube(spark, sf).collect()))  # summed over several triggers
    assert spark.read.parquet(made["cubes"]).select("batch_id").distinct().count() == 3


@pytest.mark.parametrize("confidence", [0.75, 0.95])
def test_pieces_of_a_trigger_are_tested_one_after_the_other(spark, sf, confidence):
    """Many pieces in a few jobs: the same state as one trigger per piece, also when a trigger runs twice."""
    rows = line_rows(spark, sf).select("l_orderkey", "l_linenumber", *LINE_NUMERIC, "cls")
    stored = streams.chunked(rows, 700, ["l_orderkey", "l_linenumber"]).cache()

    def loop(**more):
        return TestThenTrain(scratch_path(spark, "t"), LINE_NUMERIC, {}, "cls", confidence=confidence, history_batches=2, miner=_enumerating_miner, **more)

    single, together = loop(), loop(pieces="batch_id")
    for b in range(9):
        single.process(stored.filter(f"batch_id = {b}").drop("batch_id"), b)
    for trigger, some in enumerate(("batch_id < 4", "batch_id >= 4", "batch_id >= 4")):
        together.process_pieces(stored.filter(some), min(trigger, 1))
    assert together.seen == single.seen == 6000
    for table in ("bounds", "model", "scores", "summary"):
        a, b = single.table(spark, table).drop("exec_ms"), together.table(spark, table).drop("exec_ms")
        shown = [[tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in t.select(*sorted(a.columns)).collect()] for t in (a, b)]
        assert sorted(shown[0], key=str) == sorted(shown[1], key=str) and shown[0], table
    last = [sorted(map(str, l.table(spark, "history").filter("batch_id = 8").select("pattern_id", "confidence").collect())) for l in (single, together)]
    assert last[0] == last[1] and last[0]


def test_state_of_a_trigger_is_one_file_a_table(spark, sf):
    """Neither the files nor the reads of a trigger grow with its pieces or with the batches before; a new loop goes on where one stopped."""
    rows = line_rows(spark, sf).select("l_orderkey", "l_linenumber", *LINE_NUMERIC, "cls")
    stored = streams.chunked(rows, 700, ["l_orderkey", "l_linenumber"]).cache()
    where = scratch_path(spark, "t")

    def loop():
        return TestThenTrain(where, LINE_NUMERIC, {}, "cls", confidence=0.95, history_batches=2, miner=_enumerating_miner, pieces="batch_id")

    first = loop()
    first.process_pieces(stored.filter("batch_id < 4"), 0)
    assert first.seen == 2800
    last = loop()
    for _ in range(2):  # the second time as a replay
        last.process_pieces(stored.filter("batch_id >= 4"), 1)
    assert last.seen == last._seen(spark) == 6000
    for table, batches in {"bounds": 9, "seen": 9, "model": 9, "scores": 8, "summary": 8}.items():
        found = last.table(spark, table)
        assert found.select("batch_id").distinct().count() == batches, table
        assert len(found.inputFiles()) == 2, table


def test_replay_deals_neighbouring_pieces_to_a_task(spark, sf, monkeypatch):
    """Tasks start in order, so pieces arrive about in order, and none sorts more than a few; a piece is one file with its rows in order."""
    monkeypatch.setattr(streams, "PIECES_A_TASK", 3)
    keys = ["l_orderkey", "l_linenumber"]
    target = scratch_path(spark, "dealt")
    stored = streams.replay(line_rows(spark, sf).select(*keys), target, keys, 500)
    files = [re.search(r"batch_id=(\d+)/part-(\d+)-", f).groups() for f in stored.inputFiles()]
    assert sorted((int(b), int(t)) for b, t in files) == [(b, b // 3) for b in range(12)]
    got = [tuple(r) for b in range(12) for r in spark.read.parquet(f"{target}/batch_id={b}").collect()]
    assert got == sorted(tuple(r) for r in line_rows(spark, sf).select(*keys).collect())
    assert [r["count"] for r in stored.groupBy("batch_id").count().collect()] == [500] * 12


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Each folder had a task of its own, more than the loop's own work at some 10 000 pieces; the setting is put back."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.range(100).selectExpr("id", "id AS part").repartition(1).write.partitionBy("part").parquet(str(tmp_path / "t"))
    spark.sparkContext.setJobGroup("listed", "listed")
    with few_listing_tasks(spark):
        assert spark.read.parquet(str(tmp_path / "t")).schema.names == ["id", "part"]
    spark.sparkContext.setJobGroup("rest", "rest")
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listed") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism < 100
    assert spark.conf.get(name) == before
