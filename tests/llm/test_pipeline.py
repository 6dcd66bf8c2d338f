"""The pipeline on small tables: each stage against a plain version of itself."""

from __future__ import annotations

import corpus_pipeline
from tests.conftest import SF
from tests.llm.conftest import ROWS
from tests.llm.test_similar import first_of_similar
from tests.llm.test_text_operators import later_copies, leaks
from tidemark.llm import lines, toxicity


def test_pipeline(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    calm = stages["toxicity"](spark, docs, SF)
    bad = {r.doc_id for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in calm.collect())
    assert calm.columns == docs.columns and {i for i, _ in rows} == {r.doc_id for r in docs.collect()} - bad

    calm = spark.createDataFrame(rows, "doc_id long, text string").join(docs.drop("text"), "doc_id").select(*docs.columns)
    fresh = sorted((r.doc_id, r.text) for r in stages["line_dedup"](spark, calm, SF).collect())
    want = [(i, new) for (i, old), new in sorted(later_copies(rows, lines.MIN_LINES).items()) if not old.split() or len(new.split()) / len(old.split()) >= lines.MIN_LEFT]
    assert fresh == want

    fresh_df = spark.createDataFrame(fresh, "doc_id long, text string").join(docs.drop("text"), "doc_id").select(*docs.columns)
    single = sorted((r.doc_id, r.text) for r in stages["near_dedup"](spark, fresh_df, SF).collect())
    assert single == [fresh[k] for k in first_of_similar([t for _, t in fresh])]

    single_df = spark.createDataFrame(single, "doc_id long, text string")
    clean = sorted(r.doc_id for r in stages["decontamination"](spark, single_df, SF).collect())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for d, _ in leaks([r for r in single if len(r[1]) < 3000], items)}
    assert [i for i in clean if len(dict(single)[i]) < 3000] == [i for i, t in single if len(t) < 3000 and i not in hit]

    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(clean)


def test_stages_on_odd_rows(spark, edge, empty):
    """Nulls, empty and very long texts, ties and repeated rows, clashing columns, the empty table."""
    stages = corpus_pipeline.STAGES
    want = {"toxicity": len(ROWS), "line_dedup": len(ROWS), "near_dedup": 6, "decontamination": 6}
    kept = edge
    for name, stage in stages[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), edge.schema).repartition(2)
        assert kept.count() == want[name], name
    # near_dedup keeps one of the wordless texts, and one of the two rows with id 1
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 5, 6, 7, None]
    packed = stages[-1][1](spark, edge, SF).collect()
    assert sum(r.start == 0 for r in packed) == len(ROWS) and {r.doc_tokens for r in packed if r.doc_id in (2, 3)} == {1}
    for _, stage in stages:
        assert stage(spark, empty, SF).count() == 0
