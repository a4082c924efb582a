"""The driver queries against their SQL, over the small table of the operators' tests."""

import duckdb
import pytest

from kairolog.llm import queries
from tests.llm.test_operators import corpus

URLS = ["http://a.example.com/en/7/x", "https://EXAMPLE.net/de/8?q", "x://h.org/es/#f", "no scheme", None, "http://ads.shop.de/de/", "http://a.net/de/9"]


def tables(spark, at, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    items = [("i1", rows[3][1]), ("i2", "two"), ("i3", None), ("i4", "Changed words that no text holds at all here or there")]
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Every row; and the rows with ids, each once, since line dedup's SQL takes no account of repeated rows."""
    rows = corpus()
    every, plain = (str(tmp_path_factory.mktemp(n)) for n in ("every", "plain"))
    return tables(spark, every, rows), tables(spark, plain, [r for i, r in enumerate(rows) if r[0] is not None and r not in rows[:i]])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, folders, name):
    folder = folders[name == "op2_line_dedup"]
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns, rows = [d[0] for d in want.description], want.fetchall()
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns) and rows
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(rows, key=repr)
