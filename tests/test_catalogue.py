"""Every query with SQL gives that SQL's rows; the others run."""

import pytest

from graphloom import catalogue

from .compare import oracle, spark_rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, name):
    columns, rows = spark_rows(catalogue.QUERIES[name](spark, small))
    if name in catalogue.SQL:
        want_columns, want = oracle(catalogue.SQL[name], small)
        assert columns == want_columns
        assert rows == want, (list((rows - want).items())[:3], list((want - rows).items())[:3])
    else:
        assert rows


def test_no_part_in_use_is_dead(spark, small):
    used = {f"part:{r[0]}" for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_partkey").distinct().collect()}
    assert used and not used & {r.urn for r in catalogue.QUERIES["dead_symbols"](spark, small).select("urn").collect()}
