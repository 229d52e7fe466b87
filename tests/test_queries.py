import pytest
from conftest import SF, same

from lattica.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        same(df, duck.execute(SQL[name]))
    else:
        assert df.count() > 0


def test_entry_imports_without_the_training_operators(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_effect_summaries_of_a_part_with_an_edge_to_itself_and_of_missing_parts(spark, tmp_path):
    import duckdb

    # only part 9 itself leads to 9; 10 leads to 2, which is no part; 20 has no edge
    at = f"{tmp_path}/part.parquet"
    sql = "SELECT * FROM (VALUES (0::BIGINT, 1::INTEGER), (10, 12), (20, NULL), (30, 5), (9, 20), (40, 7), (50, 40), (60, 2), (70, 3), (NULL, 9)) p(p_partkey, p_size)"
    con = duckdb.connect()
    con.execute(f"COPY ({sql}) TO '{at}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{at}'")
    same(QUERIES["effect_summaries"](spark, str(tmp_path)), con.execute(SQL["effect_summaries"]))
