"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from tidemark.operators import contingency as ct
from tidemark.operators import fuzzify as fz
from tidemark.operators import generate as gn
from tidemark.operators import search as se
from tidemark.plans import catalog
from tidemark.plans.datasets import LINE_NUMERIC, line_rows
from tidemark.session import cut, get_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    wanted = sys.argv[1:]
    spark = get_session("bench", f"local[{CPUS}]", int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, fn):
        if wanted and name not in wanted:
            return
        started = time.time()
        fn()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    rows = line_rows(spark, SF_DIR)
    run(rows.select(F.hash(*LINE_NUMERIC)))  # start the JVM's scan path before anything is timed
    layout = fz.fit(rows, LINE_NUMERIC)
    masks = fz.selectors(rows, layout, "cls")
    cells = cut(fz.compressed_cube(masks, layout))
    few = cut(gn.random_patterns(layout, gn.slots_for(spark, ["high", "low"], 49, fixed=False), 1).drop("slot"))
    many = cut(
        gn.random_patterns(layout, gn.slots_for(spark, ["high", "low"], 4900, fixed=False), 2)
        .drop("slot")
        .dropDuplicates(["pattern_id"])
    )
    timed("selectors_cube", lambda: run(fz.compressed_cube(fz.selectors(rows, fz.fit(rows, LINE_NUMERIC), "cls"), layout)))
    timed("measures_49_cube", lambda: run(ct.evaluate_test(cells, few, layout)))
    timed("measures_4900_cube", lambda: run(ct.evaluate_test(cells, many, layout)))
    # From raw masks: the cube is the first step of the same job.
    timed("measures_49_rows", lambda: run(ct.evaluate_test(fz.compressed_cube(masks, layout), few, layout)))
    timed("measures_4900_rows", lambda: run(ct.evaluate_test(fz.compressed_cube(masks, layout), many, layout)))
    # As if the cube did not compress: every row meets the patterns filed under its values.
    timed("measures_49_uncompressed", lambda: run(ct.evaluate_test(fz.as_cells(masks), few, layout)))
    timed("measures_4900_uncompressed", lambda: run(ct.evaluate_test(fz.as_cells(masks), many, layout)))
    for name in ("enumerate2", "prequential_windows", "fuzzy_score", "flagship", "token_competition", "fuzzy_histogram"):
        timed(name, lambda name=name: run(catalog.QUERIES[name](spark, SF_DIR)))
    timed("mine_10_generations", lambda: run(se.mine(cells, layout, evaluations=49 * 11)))
    if os.environ.get("BENCH_FULL_SEARCH"):
        timed("mine_default", lambda: run(se.mine(cells, layout)))
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
