"""Each query of the subpackage that SQL can express against DuckDB, and that SQL on rows made to be awkward."""

import os

import duckdb
import pytest

from signfold.llm import oracles, queries

SF = "/root/testdata/sf0.001"
AWKWARD = [(1, "a\nb\nc"), (2, "z\na\nb\nc\n"), (3, None), (4, ""), (5, "\n\n\n\n"), (6, "token=abcdefgh é AKIA" + "Z" * 20), (7, "token=abcdefgh é AKIA" + "Z" * 20), (8, "𝄞 " + "0af" * 9 + " passwd: 'longenough1'"), (None, "p\nb\nr"), (None, "a\nq\nc"), (9, "a\nb\nc"), (9, "w " * 60), (10, "x\n" + "w " * 60), (10, "v " * 30 + "\n" + "v " * 25 + "\nend"), (11, "v " * 30 + "\n" + "v " * 25)]
PAGES = [(1, "u", "x" * 100), (2, "u", "x" * 100), (3, None, None), (4, "u", ""), (5, "u", "é" * 50), (6, "u", "é" * 50), (7, "u", "é" * 49), (None, "u", "x" * 100), (None, "u", "n" * 200), (None, "u", "n" * 200), (8, "u", "x" * 100), (8, "u", "y" * 300), (9, "u", "y" * 300), (1, "u", "z" * 150), (10, "u", "z" * 150)]


def compare(spark, path, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        where = f"{path}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}{'/*.parquet' if os.path.isdir(where) else ''}'")
    df = queries.queries()[name](spark, path)
    found = con.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_on_test_tables(spark, name):
    compare(spark, SF, name)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_on_awkward_rows(spark, tmp_path, name):
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in AWKWARD], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    compare(spark, str(tmp_path), name)
