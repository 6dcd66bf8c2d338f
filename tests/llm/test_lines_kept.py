"""Line deduplication in the pipeline loses later copies only."""

from __future__ import annotations

from tidemark.llm import lines


def test_every_line_stays_somewhere(spark):
    shared = [f"shared line {k} with some words" for k in range(6)]
    rows = [
        (1, "\n".join(["a", "b", "c"])),
        (2, "\n".join(["a", "b", "c", "x", *shared[:3], "a", "b", "c"] + ["a", "b", "c"] * 9)),  # mostly copies, but the first with these shared lines
        (3, "\n".join(["own words of three", *shared[:3]])),
        (4, "\n".join([*shared[:3], "a", "b", "c"])),
        (5, "\n".join(["q", *shared])),
        (6, " \n"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.text for r in lines.clean(df).collect()}
    words = lambda texts: {x for t in texts for x in t.split("\n") if x.strip()}
    assert words(got.values()) == words(dict(rows).values())
    assert got[2] == "\n".join(["x", *shared[:3]]) and 4 not in got and set(got) == {1, 2, 3, 5, 6}
