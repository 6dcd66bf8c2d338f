"""Net changes of a log kept as runs, so that a window of versions reads runs and not the log.

The log is taken in segment by segment, each read once and reduced to one row per key.  Two runs of the
same length that lie side by side, the first at an even place, are combined into one of twice the length,
and so on; so the net change from any segment's start up to the end is made of at most about two runs for
each doubling of the number of segments.  Rows are reduced the same way at every level (see
``combine_net``), which makes the order of combining irrelevant.

A run comes into force by a small file that is written once; an attempt that fails leaves nothing that is
read.  Runs are written sorted by key, so their files can be pruned by it.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.apply import union_all
from tidemark.operators.changes import combine_net, net_of_run, net_run
from tidemark.sources.paths import children, delete, read_text, write_new


def _home(root: str, table: str) -> str:
    return f"{root}/runs/table={table.lower()}"


def _segments(spark: SparkSession, root: str, table: str) -> list[dict]:
    """Segments in order: versions after ``low`` up to ``high``, and the folders of runs that end there."""
    names = [n for n in children(spark, _home(root, table)) if re.fullmatch(r"\d+\.json", n)]
    return [json.loads(read_text(spark, f"{_home(root, table)}/{n}")) for n in names]


def _write(run: DataFrame, root: str, table: str, pk: tuple[str, ...]) -> str:
    name = f"run={uuid.uuid4().hex}"
    run.sortWithinPartitions(*pk).write.parquet(f"{_home(root, table)}/{name}")
    return name


def add_segment(log: DataFrame, root: str, table: str, pk: tuple[str, ...], high: int) -> int:
    """Take in the log's versions after the last segment's end up to ``high``; the number of segments.
    Nothing is done where that end is ``high`` already."""
    spark = log.sparkSession
    have = _segments(spark, root, table)
    low = have[-1]["high"] if have else None
    if low is not None and high <= low:
        return len(have)
    piece = log.where(F.col("version") <= high)
    runs = [_write(net_run(piece if low is None else piece.where(F.col("version") > low), pk), root, table, pk)]
    place, home = len(have), _home(root, table)
    while (place + 1) % (1 << len(runs)) == 0:  # two runs of this length end here side by side
        before = have[place - (1 << (len(runs) - 1))]["runs"][len(runs) - 1]
        both = spark.read.parquet(f"{home}/{before}", f"{home}/{runs[-1]}")
        runs.append(_write(combine_net(both, pk), root, table, pk))
    if not write_new(spark, f"{home}/{place:09d}.json", json.dumps({"low": low, "high": high, "runs": runs})):
        for r in runs:
            delete(spark, f"{home}/{r}")
        raise RuntimeError(f"{table}: another writer has taken in segment {place}")
    return place + 1


def runs_of_window(segments: list[dict], first: int) -> list[str]:
    """The folders of the fewest runs that cover all segments from ``first`` on."""
    out, at = [], first
    while at < len(segments):
        k = 0
        while at % (1 << (k + 1)) == 0 and at + (1 << (k + 1)) <= len(segments):
            k += 1
        end = at + (1 << k)
        out.append(segments[end - 1]["runs"][k])
        at = end
    return out


def net_from_runs(spark: SparkSession, root: str, table: str, pk: tuple[str, ...], start: int | None = None, log: DataFrame | None = None) -> DataFrame:
    """The net changes of versions after ``start`` (all if None) up to the end of the last segment, as
    ``net_changes`` of the log.  A start inside a segment takes the rest of that one from ``log``."""
    segments = _segments(spark, root, table)
    if not segments:
        raise ValueError(f"{table}: no segment has been taken in")
    first = 0 if start is None else next((k for k, s in enumerate(segments) if s["low"] is not None and s["low"] >= start), len(segments))
    parts = []
    if start is not None and first and segments[first - 1]["high"] > start:
        if log is None:
            raise ValueError(f"{table}: version {start} lies inside a segment, whose log is needed")
        parts.append(net_run(log.where((F.col("version") > start) & (F.col("version") <= segments[first - 1]["high"])), pk))
    runs = runs_of_window(segments, first)
    if runs:
        parts.append(spark.read.parquet(*[f"{_home(root, table)}/{r}" for r in runs]))
    if not parts:
        parts.append(spark.read.parquet(f"{_home(root, table)}/{segments[-1]['runs'][0]}").limit(0))
    return net_of_run(combine_net(union_all(parts), pk), pk)
