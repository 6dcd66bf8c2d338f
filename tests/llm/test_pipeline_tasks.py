"""The driver keeps a record of every task: stages must not run steps twice or on nothing."""

from __future__ import annotations

import pytest

from tidemark.llm import lines, similar

PARTS = 23


@pytest.fixture
def tasks(spark):
    """Runs a function and returns its result and the number of tasks, with ``PARTS`` a shuffle."""
    conf = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    sc = spark.sparkContext

    def run(group, f):
        sc.setJobGroup(group, group)
        out, track = f(), sc.statusTracker()
        stages = {s for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds}
        return out, sum(i.numCompletedTasks for s in stages if (i := track.getStageInfo(s)))

    yield run
    sc._jsc.clearJobGroup()
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_round_of_doubling_runs_each_step_once(spark, tasks):
    docs = spark.createDataFrame([(i, "\n".join(f"line {k} of many" for k in range(i % 3, 9))) for i in range(6)], "doc_id long, text string")
    levels, n = tasks("doubling", lambda: lines.suffix_array(docs))
    assert [d for d, _ in levels] == [1, 2, 3, 6]
    assert n <= 3 * PARTS * (len(levels) + 1)


def test_nothing_is_compared_where_hubs_connect_all(spark, tasks):
    words = [f"word{k}" for k in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words, *([f"own{i}"] if i else [])])) for i in range(8)] + [(90, "quite another text of a few words")], "doc_id long, text string")
    kept, n = tasks("hubs", lambda: similar.one_of_each(docs).collect())
    assert sorted(r.doc_id for r in kept) == [0, 90]
    assert n <= 32 * PARTS
