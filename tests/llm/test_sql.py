"""Queries of the operators against their SQL on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from quillrank.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


EDGES = [
    (0, None, "de", "a"), (1, "", "de", None), (2, "  \n\t\n", None, None), (3, "one two", "en", "a"), (4, "One  TWO", "en", "a"),
    (5, "api_KEY = 'abcdefgh12' token=x token: secret=abcdefgh ä " + "0f" * 40 + " AKIA" + "Z" * 13, "en", "a"),
    (6, "x üß ghp_" + "a" * 36 + "\neyJab.eyJ" + "c" * 40 + ".d\n-----BEGIN RSA PRIVATE KEY----- xoxb-" + "1" * 20, "en", None),
    (7, "\n".join(["same line * here"] * 40), "en", "a"), (8, " ".join(f"w{i}" for i in range(3000)), "en", "a"),
    (9, " ".join(f"w{i}" for i in range(2999)) + " end", "en", "a"), (10, " ".join(f"w{i}" for i in range(3000)), "de", "b"),
]


@pytest.mark.parametrize("name", ["op3_near_duplicates", "op4_secret_scan", "op7_quality_rules", "op11_exact_dedup"])
def test_query_on_odd_texts(spark, tmp_path, name):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) AS long) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
