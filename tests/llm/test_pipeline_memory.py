"""What the pipeline's stages leave to the Python workers, which Spark keeps from one stage to the next."""

import ctypes
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from evidara.llm import common, simhash


def test_no_task_of_near_dedup_takes_two_python_workers(spark):
    rows = [(bytearray(np.random.default_rng(i).bytes(96)), i, i) for i in range(20)]
    links = simhash.similar_links(spark.createDataFrame(rows, "fp binary, node long, colour long"), 0.8)
    stages = links._jdf.queryExecution().executedPlan().toString().split("Exchange ")
    assert max(stage.count("MapInPandas") for stage in stages) == 1


def test_prefix_sums_run_no_python_workers_of_another_kind(spark, monkeypatch):
    """Rows that are given as a Python list go through workers of the RDD interface."""

    def refuse(*_, **__):
        raise AssertionError("rows of a Python list")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("size"))
    placed, n, total = common.global_prefix(rows, [F.col("id").desc()], "size")
    sizes = [i % 7 for i in range(999, -1, -1)]
    got = sorted((r["position"], r["id"], r["before"]) for r in placed.collect())
    assert (n, total) == (1000, sum(sizes))
    assert got == [(at, 999 - at, sum(sizes[:at])) for at in range(1000)]
    placed, n, total = common.global_prefix(rows.limit(0), [F.col("id").desc()], "size")
    assert (placed.count(), n, total) == (0, 0, 0)


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="only glibc keeps and trims so")
def test_a_worker_gives_back_what_it_has_freed():
    anonymous = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    def work():
        parts = [np.ones(8000) for _ in range(2000)]  # 128 MB, each too small for a mapping of its own
        last.append(parts.pop())
        yield len(parts)

    last, before = [], anonymous()
    assert list(common.giving_back(work())) == [1999]
    assert anonymous() < before + 40  # all 128 MB stay without giving back, as the last part lies above the others
