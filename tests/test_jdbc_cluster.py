"""Ranges of another database where driver and executors are processes of their own."""

from __future__ import annotations

import subprocess
import sys
import textwrap

from tests.conftest import ROOT, SF
from tidemark.sources import jdbc


def test_executors_read_the_database(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        from tidemark.plans.flow_queries import jdbc_ranges
        spark = (
            SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1g")
            .config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.sql.warehouse.dir", "{tmp_path}/warehouse").getOrCreate()
        )
        got = jdbc_ranges(spark, {SF!r}).collect()
        want = spark.read.parquet({SF!r} + "/customer.parquet").count()
        assert len({{r.c_custkey for r in got}}) == len(got) == want + 1, (len(got), want)
        print("whole")
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert "whole" in done.stdout, done.stderr[-3000:]


def test_odd_values_of_an_embedded_database(spark):
    rows = [(1, None), (2, ""), (3, 'a,"b'), (4, "x\ny"), (5, "  pad "), (None, "ü"), (7, '"q"'), (8, "it's"), (9, "a\\b"), (10, '\\"')]
    for some in (rows, []):
        df = spark.createDataFrame(some, "k int, v string").repartition(3)
        at = jdbc.embedded(spark, df, "customer", {"v": "varchar(40)"})
        got = jdbc.jdbc_read(spark, "derby", table="customer", key=("v", "k"), partitions=3, **at)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, some))
