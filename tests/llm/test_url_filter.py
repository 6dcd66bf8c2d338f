from __future__ import annotations

from tidemark.llm import url_filter as U


def test_as_of(spark):
    entries = [
        ("example.com", "block", 10), ("example.com", "allow", 20), ("www.example.com", "allow", 15), ("www.example.com/bad", "block", 5),
        ("www.example.com/bad", "allow", 40), (None, "block", 1), ("x.org", "block", None), ("tie.org", "block", 3), ("tie.org", "allow", 3),
    ]
    captures = [
        (1, "http://a.example.com/", 9, True, None), (2, "http://a.example.com/", 10, False, "example.com"), (3, "HTTPS://A.Example.com:80/x?y#z", 19, False, "example.com"),
        (4, "http://a.example.com/", 20, True, "example.com"), (5, "http://www.example.com/q", 12, False, "example.com"), (6, "http://www.example.com/q", 16, True, "www.example.com"),
        (7, "http://www.example.com/bad/p.html", 16, False, "www.example.com/bad"), (8, "http://www.example.com/bad", 400, True, "www.example.com/bad"), (9, None, 5, True, None),
        (10, "not a url", 50, True, None), (11, "http://x.org/", 50, True, None), (12, "http://tie.org/", 50, True, "tie.org"), (None, "http://a.example.com/", 15, False, "example.com"),
        (13, "http://a.example.com/", None, True, None), (14, "http://user:pw@www.example.com/bad/", 6, False, "www.example.com/bad"),
    ]
    deep, labels = "www.example.com/a/b/c/d", ".".join("x" * 130) + ".net"
    entries += [(deep, "block", 1), (labels, "allow", 1), (labels + "/p", "block", 1)]
    captures += [(15, f"http://{deep}/e?f", 30, False, deep), (16, "http://www.example.com/a/b/c", 30, True, "www.example.com"), (17, f"http://{labels}/p/q", 30, False, labels + "/p")]
    captures += [captures[1], captures[1]]  # repeated rows
    e = spark.createDataFrame(entries, "pattern string, action string, listed int").selectExpr("*", "'x' as since", "'y' as rank")
    c = spark.createDataFrame([r[:3] for r in captures], "page_id long, url string, fetched int").selectExpr("*", "'x' as pattern", "'z' as period")
    want = sorted(((r[0], r[3], r[4]) for r in captures), key=repr)
    assert sorted(((r.page_id, r.kept, r.pattern) for r in U.judge(c, e).collect()), key=repr) == want
    small, U.SMALL = U.SMALL, 0  # the same through the shuffled join
    try:
        assert sorted(((r.page_id, r.kept, r.pattern) for r in U.judge(c, e).collect()), key=repr) == want
    finally:
        U.SMALL = small
    assert U.judge(c.limit(0), e).count() == 0 and U.judge(c, e.limit(0)).where("kept").count() == len(captures)


def test_oracle(spark):
    import duckdb

    from tests.conftest import SF
    from tidemark.llm.queries import OP3_SQL, op3_url_filter

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(OP3_SQL)
    got = op3_url_filter(spark, SF).select(*want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
