"""Queries: sources, batches, test-then-train bookkeeping and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.measures import REPORTED, top_patterns, with_measures
from tidemark.operators import fuzzify as fz
from tidemark.operators.contingency import enumerate_patterns, evaluate_test
from tidemark.operators.fuzzify import compressed_cube

from tidemark.operators.rowindex import chunked, with_row_index, with_unique_row_id
from tidemark.plans.datasets import (
    LINE_NUMERIC, ROW_KEYS, lift_patterns, line_cube, line_masks, line_patterns, line_rows, sql_covers, sql_enumerated,
    sql_feet, sql_labels, sql_lift, sql_line, sql_lines, sql_patterns,
)
from tidemark.plans.ranking import MEASURE_SQL
from tidemark.plans.registry import load, query, r6, rounded
from tidemark.session import cut, few_listing_tasks, scratch_path
from tidemark.sources import arff, reports, streams
from tidemark.streaming import prequential as pq
from tidemark.streaming.test_then_train import TestThenTrain

FOUR = range(4)
ORDER = ", ".join(ROW_KEYS)
CHUNK = 5000

# ---- sources ------------------------------------------------------------------------------------


@query("row_index", f"SELECT {ORDER}, row_number() OVER (ORDER BY {ORDER}) - 1 AS row_index FROM lineitem")
def row_index(spark, sf_dir):
    return with_row_index(load(spark, sf_dir, "lineitem").select(*ROW_KEYS), ROW_KEYS)


@query("unique_row_id", "SELECT count(*) AS n, count(*) AS n_distinct FROM lineitem")
def unique_row_id(spark, sf_dir):
    made = with_unique_row_id(load(spark, sf_dir, "lineitem"))
    return made.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_distinct"))


CHUNKED = f"(SELECT *, (row_number() OVER (ORDER BY {ORDER}) - 1) // {CHUNK} AS batch_id FROM lineitem)"


@query("chunks", f"SELECT batch_id, count(*) AS n, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order FROM {CHUNKED} GROUP BY 1")
def chunks(spark, sf_dir):
    made = chunked(load(spark, sf_dir, "lineitem").select(*ROW_KEYS), CHUNK, ROW_KEYS)
    return made.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order")
    )


LINE_HEADER = "key double, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string"


@query(
    "parse_lines",
    "SELECT l_orderkey::DOUBLE AS key, CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem",
)
def parse_lines(spark, sf_dir):
    """The table as stream lines (missing as ?), parsed back."""
    from pyspark.sql.types import StructType

    rows = line_rows(spark, sf_dir, missing=True)
    cells = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
    lines = rows.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in cells]).alias("value"))
    return arff.parse_stream_lines(lines, StructType.fromDDL(LINE_HEADER))


@query(
    "arff_round_trip",
    "SELECT p_size::DOUBLE AS p_size, p_retailprice, p_brand, p_type, count(*) AS n FROM part GROUP BY ALL",
)
def arff_round_trip(spark, sf_dir):
    """part written as ARFF text (header and data apart), read back through the header."""
    rows = load(spark, sf_dir, "part")
    where = scratch_path(spark, "arff")
    types = {"p_size": "integer", "p_retailprice": "real", "p_brand": "{any}", "p_type": "{any}"}
    header = ["@relation part", *[f"@attribute {c} {t}" for c, t in types.items()], "@data"]
    spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.text(f"{where}/header")
    rows.select(F.concat_ws(",", *types).alias("value")).write.text(f"{where}/data")
    back = arff.read_arff(spark, f"{where}/data", header=f"{where}/header")
    return back.groupBy(*back.columns).agg(F.count(F.lit(1)).alias("n"))


REPLAY = 20_000
#: Pieces that one trigger takes at most, a task each: a trigger costs the same for one piece as for many.
TOGETHER = 256


@query("replay", f"SELECT (row_number() OVER (ORDER BY {ORDER}) - 1) // {REPLAY} AS batch_id, {ORDER} FROM lineitem")
def replay(spark, sf_dir):
    stored = streams.replay(load(spark, sf_dir, "lineitem").select(*ROW_KEYS), scratch_path(spark, "replay"), ROW_KEYS, REPLAY)
    return stored.withColumn("batch_id", F.col("batch_id").cast("bigint"))


def _streamed(spark, rows, pieces=1):
    """Replay a table as pieces and open them as a stream, up to ``pieces`` of them per trigger; ``batch_id`` is the piece."""
    target = scratch_path(spark, "stream")
    with few_listing_tasks(spark):
        stored = streams.replay(rows, target, ROW_KEYS, REPLAY)
        return streams.read_stream(spark, "parquet", target, stored.schema, files_per_batch=pieces)


@query("stream_cube", sql_lines(keep="") + " SELECT w0, w1, w2, w3, class, n FROM cells")
def stream_cube(spark, sf_dir):
    """Selectors built on the streaming table itself, summed over all batches: equal to the batch cube."""
    rows = line_rows(spark, sf_dir)
    layout = fz.fit(rows, LINE_NUMERIC)
    out, done = scratch_path(spark, "cubes"), scratch_path(spark, "cubes-checkpoint")
    masks = fz.selectors(_streamed(spark, rows, TOGETHER), layout, "cls")

    def store(batch, batch_id):
        compressed_cube(batch, layout).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    masks.writeStream.foreachBatch(store).option("checkpointLocation", done).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(*layout.words, "class").agg(F.sum("n").alias("n"))


# ---- test-then-train bookkeeping ----------------------------------------------------------------

BATCHED = (
    f"WITH {sql_line(True)}, {sql_feet(LINE_NUMERIC)}, {sql_labels(LINE_NUMERIC, ORDER)}, {sql_lift()}, "
    f"num AS (SELECT *, (row_number() OVER (ORDER BY {ORDER}) - 1) // {CHUNK} AS batch_id FROM rows_), "
    "bc AS (SELECT batch_id, w0, w1, w2, w3, class, count(*) AS n FROM num GROUP BY ALL), "
    "bp AS (SELECT batch_id, class, sum(n)::BIGINT AS positives, sum(sum(n)) OVER (PARTITION BY batch_id)::BIGINT AS total FROM bc GROUP BY batch_id, class), "
    "bh AS (SELECT r.batch_id, q.pattern_id, sum(r.n)::BIGINT AS covered, sum(CASE WHEN r.class = q.class THEN r.n ELSE 0 END)::BIGINT AS hits "
    f"FROM bc r JOIN lift q ON {sql_covers()} GROUP BY 1, 2), "
    "pq0 AS (SELECT bp.batch_id, q.pattern_id, q.class, q.m0, q.m1, q.m2, q.m3, coalesce(hits, 0) AS tp, coalesce(covered, 0) - coalesce(hits, 0) AS fp, "
    "total - positives - (coalesce(covered, 0) - coalesce(hits, 0)) AS tn, positives - coalesce(hits, 0) AS fn "
    "FROM lift q JOIN bp ON bp.class = q.class LEFT JOIN bh ON bh.batch_id = bp.batch_id AND bh.pattern_id = q.pattern_id), "
    "pq AS (SELECT *, " + ", ".join(f"({MEASURE_SQL[m]})::DOUBLE AS {m}" for m in REPORTED) + " FROM pq0)"
)


def _scores(spark, sf_dir):
    masks, layout = line_masks(spark, sf_dir, missing=True, keep=ROW_KEYS)
    masks = cut(masks)
    patterns = cut(lift_patterns(compressed_cube(masks, layout), layout))
    batches = chunked(masks, CHUNK, ROW_KEYS)
    return pq.prequential_scores(batches, patterns, layout), layout, batches, patterns


@query("prequential", BATCHED + " SELECT batch_id, pattern_id, class, tp, fp, tn, fn, " + ", ".join(f"round({m}, 6) AS {m}" for m in REPORTED) + " FROM pq")
def prequential(spark, sf_dir):
    return rounded(_scores(spark, sf_dir)[0].drop("masks"), REPORTED)


EVENT_NUMERIC = ["value", "user_id"]
EVENT_SQL = (
    "WITH src AS (SELECT event_id, value, user_id::DOUBLE AS user_id, event_type, epoch(date_trunc('day', ts))::BIGINT AS batch_id FROM events), "
    f"{sql_feet(EVENT_NUMERIC)}, {sql_labels(EVENT_NUMERIC, 'batch_id', 'event_type')}, {sql_enumerated(2, 2)}, "
    "bc AS (SELECT batch_id, w0, w1, class, count(*) AS n FROM rows_ GROUP BY ALL), "
    "bp AS (SELECT batch_id, class, sum(n)::BIGINT AS positives, sum(sum(n)) OVER (PARTITION BY batch_id)::BIGINT AS total FROM bc GROUP BY batch_id, class), "
    "bh AS (SELECT r.batch_id, q.pattern_id, sum(r.n)::BIGINT AS covered, sum(CASE WHEN r.class = q.class THEN r.n ELSE 0 END)::BIGINT AS hits "
    f"FROM bc r JOIN pat q ON {sql_covers(n=2)} GROUP BY 1, 2), "
    "ev AS (SELECT bp.batch_id, q.pattern_id, q.class, coalesce(hits, 0) AS tp, coalesce(covered, 0) - coalesce(hits, 0) AS fp, "
    "total - positives - (coalesce(covered, 0) - coalesce(hits, 0)) AS tn, positives - coalesce(hits, 0) AS fn "
    "FROM pat q JOIN bp ON bp.class = q.class LEFT JOIN bh ON bh.batch_id = bp.batch_id AND bh.pattern_id = q.pattern_id)"
)


@query("prequential_windows", EVENT_SQL + " SELECT batch_id, pattern_id, class, tp, fp, tn, fn, round(" + MEASURE_SQL["confidence"] + ", 6) AS confidence FROM ev")
def prequential_windows(spark, sf_dir):
    """Daily event-time windows over events, patterns about value and user for each event type."""
    rows = load(spark, sf_dir, "events")
    layout = fz.fit(rows, EVENT_NUMERIC)
    masks = fz.selectors(pq.event_windows(rows, "ts", "1 day"), layout, "event_type", keep=["batch_id"])
    cells = cut(compressed_cube(masks, layout, ["batch_id"]))
    whole = cells.groupBy(*layout.words, "class").agg(F.sum("n").alias("n"))
    patterns = cut(enumerate_patterns(whole, layout, 2).select("pattern_id", "class", "masks"))
    made = evaluate_test(cells, patterns, layout, by=["batch_id"])
    return made.select("batch_id", "pattern_id", "class", "tp", "fp", "tn", "fn", r6("confidence").alias("confidence"))


@query("drift_real", BATCHED + " SELECT batch_id, class, round(avg(confidence), 6) AS mean_value FROM pq GROUP BY 1, 2 HAVING avg(confidence) < 0.68::DOUBLE")
def drift_real(spark, sf_dir):
    return rounded(pq.drift(_scores(spark, sf_dir)[0], "confidence", 0.68), ["mean_value"])


@query("drift_virtual", BATCHED + " SELECT batch_id, class, round(avg(support), 6) AS mean_value FROM pq GROUP BY 1, 2 HAVING avg(support) < 0.25::DOUBLE")
def drift_virtual(spark, sf_dir):
    return rounded(pq.drift(_scores(spark, sf_dir)[0], "support", 0.25), ["mean_value"])


@query(
    "classes_to_retrain",
    BATCHED + ", mn AS (SELECT batch_id, class, avg(confidence) AS c, avg(support) AS s FROM pq WHERE class = 'high' GROUP BY 1, 2) "
    "SELECT batch_id, class FROM mn WHERE c < 0.68::DOUBLE OR s < 0.25::DOUBLE UNION SELECT batch_id, class FROM bp WHERE (batch_id, class) NOT IN (SELECT batch_id, class FROM mn)",
)
def classes_to_retrain(spark, sf_dir):
    """A model that only knows one class: its drift, plus the class it says nothing about."""
    scores, _, batches, _ = _scores(spark, sf_dir)
    active = batches.groupBy("batch_id", "class").agg(F.count(F.lit(1)).alias("n"))
    return pq.classes_to_retrain(scores.filter("class = 'high'"), active, 0.68, 0.25)


@query(
    "replace_class_patterns",
    sql_patterns(2) + " SELECT pattern_id, class, n_vars FROM pat WHERE (class = 'low' AND n_vars = 1) OR (class = 'high' AND n_vars = 2)",
)
def replace_class_patterns(spark, sf_dir):
    patterns = cut(line_patterns(spark, sf_dir))
    wanted = spark.createDataFrame([("high",)], "class string")
    out = pq.replace_class_patterns(patterns.filter("n_vars = 1"), patterns.filter("n_vars = 2"), wanted)
    return out.select("pattern_id", "class", "n_vars")


@query("append_patterns", sql_patterns(2) + " SELECT pattern_id, class, n_vars FROM pat")
def append_patterns(spark, sf_dir):
    patterns = cut(line_patterns(spark, sf_dir))
    return pq.append_patterns(patterns.filter("n_vars = 1"), patterns.filter("n_vars = 2")).select("pattern_id", "class", "n_vars")


LAST3 = BATCHED + ", hist AS (SELECT * FROM pq WHERE batch_id > (SELECT max(batch_id) FROM pq) - 3)"


def _history(spark, sf_dir):
    scores = cut(_scores(spark, sf_dir)[0])
    early = pq.enqueue_history(None, scores.filter("batch_id % 2 = 0"), 1000)
    return pq.enqueue_history(early, scores, 3)


@query("history", LAST3 + " SELECT batch_id, pattern_id, class, round(confidence, 6) AS confidence FROM hist")
def history(spark, sf_dir):
    """Scores enqueued twice for half of the batches: one entry each, last three batches kept."""
    return _history(spark, sf_dir).select("batch_id", "pattern_id", "class", r6("confidence").alias("confidence"))


@query(
    "history_reward",
    LAST3 + ", ag AS (SELECT batch_id, row_number() OVER (ORDER BY batch_id DESC) AS age FROM (SELECT DISTINCT batch_id FROM hist)) "
    "SELECT pattern_id, round(sum(confidence * pow(2.0::DOUBLE, -age)), 6) AS reward_confidence, "
    "round(sum(wracc_norm * pow(2.0::DOUBLE, -age)), 6) AS reward_wracc_norm FROM hist JOIN ag USING (batch_id) GROUP BY 1",
)
def history_reward(spark, sf_dir):
    made = pq.history_reward(cut(_history(spark, sf_dir)), ["confidence", "wracc_norm"])
    return rounded(made, ["reward_confidence", "reward_wracc_norm"])


@query(
    "rewarded_objectives",
    LAST3 + ", ag AS (SELECT batch_id, row_number() OVER (ORDER BY batch_id DESC) AS age FROM (SELECT DISTINCT batch_id FROM hist)), "
    "rw AS (SELECT pattern_id, sum(confidence * pow(2.0::DOUBLE, -age)) AS r FROM hist JOIN ag USING (batch_id) GROUP BY 1) "
    "SELECT pq.pattern_id, round(confidence + coalesce(r, 0), 6) AS o1 FROM pq LEFT JOIN rw USING (pattern_id) WHERE batch_id = (SELECT max(batch_id) FROM pq)",
)
def rewarded_objectives(spark, sf_dir):
    scores = cut(_scores(spark, sf_dir)[0])
    kept = cut(pq.enqueue_history(None, scores, 3))
    last = scores.agg(F.max("batch_id")).scalar()
    now = scores.filter(F.col("batch_id") == last).select("pattern_id", F.col("confidence").alias("o1"))
    return rounded(pq.with_reward(now, kept, {"o1": "confidence"}), ["o1"])


def _enumerating_miner(cells, layout, classes, by=()):
    """Deterministic miner: the five best one- and two-column patterns of each wanted class (and batch)."""
    made = with_measures(enumerate_patterns(cells, layout, 2, by), ["wracc_norm"]).filter(F.col("class").isin(classes))
    return top_patterns(made, "wracc_norm", 5, [*by, "class"]).select(*by, "pattern_id", "class", "masks")


def _test_then_train(spark, sf_dir):
    rows = line_rows(spark, sf_dir).select(*ROW_KEYS, *LINE_NUMERIC, "cls")
    loop = TestThenTrain(
        scratch_path(spark, "state"), LINE_NUMERIC, {}, "cls", confidence=0.75, history_batches=2, miner=_enumerating_miner, pieces="batch_id"
    )
    loop.run(_streamed(spark, rows, TOGETHER), scratch_path(spark, "state-checkpoint"))
    return loop


@query("test_then_train")
def test_then_train(spark, sf_dir):
    """The whole loop over the replayed table: summary of every tested batch."""
    summary = _test_then_train(spark, sf_dir).table(spark, "summary").drop("exec_ms")
    return summary.select("batch_id", *[c for c in summary.columns if c != "batch_id"])


# ---- reports ------------------------------------------------------------------------------------


def _clause(i, c):
    labels = "; ".join(
        f"' || printf('Label {j} (%.6f, %.6f, %.6f)', c{i}_a{j}, c{i}_b{j}, c{i}_c{j}) || '" for j in range(3)
    ).split("; ")
    return f"CASE m{i} WHEN 0 THEN NULL " + " ".join(f"WHEN {1 << j} THEN '{c} IN {{{labels[j]}}}'" for j in range(3)) + " END"


@query(
    "rules_text",
    sql_patterns(2)
    + " SELECT pattern_id, class, 'IF ' || concat_ws(' AND ', " + ", ".join(_clause(i, c) for i, c in enumerate(LINE_NUMERIC)) + ") || ' THEN ' || class AS rule FROM pat, p",
)
def rules_text(spark, sf_dir):
    layout = line_cube(spark, sf_dir)[1]
    return reports.render_rules(line_patterns(spark, sf_dir), layout).select("pattern_id", "class", "rule")


@query(
    "training_report",
    sql_patterns(2) + " SELECT row_number() OVER (PARTITION BY class ORDER BY pattern_id) - 1 AS rule_no, pattern_id AS id, class, "
    f"printf('%.6f', ({MEASURE_SQL['confidence']})::DOUBLE) AS confidence, printf('%.6f', ({MEASURE_SQL['wracc_norm']})::DOUBLE) AS wracc_norm FROM pat",
)
def training_report(spark, sf_dir):
    scored = with_measures(line_patterns(spark, sf_dir), ["confidence", "wracc_norm"])
    return reports.training_report(scored, ["confidence"], "wracc_norm")


VARS = " + ".join(f"(m{i} <> 0)::INT" for i in FOUR)


@query(
    "test_report",
    BATCHED + f" SELECT batch_id, class, pattern_id, count(*) AS n_rules, round(avg({VARS}), 6) AS n_vars, "
    + ", ".join(f"CASE WHEN grouping(pattern_id) = 0 THEN max({c}) END AS {c}" for c in ("tp", "fp", "tn", "fn"))
    + ", " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in REPORTED)
    + " FROM pq GROUP BY GROUPING SETS ((batch_id, class, pattern_id), (batch_id))",
)
def test_report(spark, sf_dir):
    scores, layout, _, _ = _scores(spark, sf_dir)
    return rounded(reports.test_report(scores, layout), ["n_vars", *REPORTED])


@query(
    "summary_report",
    BATCHED + f" SELECT batch_id, count(*) AS n_rules, round(avg({VARS}), 6) AS n_vars, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in REPORTED) + " FROM pq GROUP BY batch_id",
)
def summary_report(spark, sf_dir):
    scores, layout, _, _ = _scores(spark, sf_dir)
    return rounded(reports.summary_report(scores, layout), ["n_vars", *REPORTED])
