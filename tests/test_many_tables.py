"""Schema changes of more subscribed tables than fit a short list."""

from __future__ import annotations

from tidemark.plans import queries


def test_no_subscribed_table_is_left_out(spark, tmp_path):
    rows = [(k, f"Type {k}", "Brand#1", 2) for k in range(1500)]  # one Drop each
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = queries.attach_types(spark, str(tmp_path)).collect()
    assert sorted((r.event_id, r.table_name, r.event_type) for r in got) == [(k, f"Type {k}", "Drop") for k in range(1500)]
