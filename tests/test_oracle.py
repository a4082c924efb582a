import glob
import os

import duckdb
import pytest

from kairolog import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["flagship_segments", "scan_wildcard", "expr_div_int", "expr_wrap", "join_4_chain", "not_join_exist", "or_with_not", "agg_min_max", "win_rank", "mixed_agg_window", "pseudo_attrs", "rule_recursive_tc", "rule_bound_second"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    show = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(show, want.fetchall()), key=repr) == sorted((show(tuple(r[c] for c in columns)) for r in df.collect()), key=repr)
