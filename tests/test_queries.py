"""The registered queries: structure, and the flagship against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_sql import TABLES, canonical

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

CHECKED = [
    "season_top3", "conf_standings", "topn_probability", "stat_tables_outer_concat", "schedule_split",
    "target_corr_kendall", "loso_winners", "votes_table", "latest_record", "local_top_impacts",
    "corr_pruned_columns", "target_corr_spearman", "kfold_linear", "fixed_weights_scored", "mlp_three_steps",
    "sampled_customers", "stage_built_once", "history_append",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["player_season_team", "PLAYER", "TEAM", "SEASON", "score", "score_rank", "place"]
    assert 0 < df.count() <= 21


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, result.fetchall())
