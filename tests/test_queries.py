"""Every registered query with SQL gives the SQL's rows on the smallest tables; plans stay as intended."""

import inspect

import duckdb
import pytest

import __spark_entry__ as entry
from catalog import fixtures as fx, matrix
from check import TABLES, rows_of
from cytolake.operators import normalize

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    duck.execute(ORACLES[name])
    expected = rows_of([c[0] for c in duck.description], duck.fetchall())
    assert got[0] == expected[0]
    assert got[1] == expected[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 125


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(fx.table(spark, SF, "lineitem").filter("l_quantity > 10").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    counted = plan_of(QUERIES["f1_cell_totals"](spark, SF))
    assert "l_comment" not in counted and "l_extendedprice" not in counted.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", ["i20_marker_summary", "f16_region_mean", "i9_snn_graph", "c13_densify", "e6_region_range_join",
                                  "e4_parallel_zip", "g1_top_features", "i15_artificial_share"])
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan_of(QUERIES[name](spark, SF))


def test_feature_rank_is_limited_before_the_shuffle(spark):
    from cytolake.operators import normalize
    scored = spark.createDataFrame([("s", 1, 1.0)], "sample string, gene bigint, score double")
    assert "WindowGroupLimit" in plan_of(normalize.top_features(scored, 10))


def test_same_rows_at_other_partition_counts(spark):
    names = ["g1_top_features", "i8_knn", "g3_label_top", "i19_quasi_counts"]
    first = {n: rows_of(QUERIES[n](spark, SF).columns, QUERIES[n](spark, SF).collect()) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for n in names:
            df = QUERIES[n](spark, SF)
            assert rows_of(df.columns, df.collect()) == first[n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("query, module, name, rounds, full", [
    ("i7_batch_correction", "batch", "harmony", "max_rounds", 10), ("i16_region_mixture", "regions", "region_mixture", "rounds", None),
    ("malignant_cells", "analyses", "malignant_cells", "rounds", None)])
def test_rounds_are_the_operators_own(spark, monkeypatch, query, module, name, rounds, full):
    class Called(Exception):
        pass
    operator = getattr(getattr(matrix, module), name)

    def call(*args, **options):
        bound = inspect.signature(operator).bind(*args, **options)
        bound.apply_defaults()
        raise Called(bound.arguments[rounds])
    monkeypatch.setattr(getattr(matrix, module), name, call)
    with pytest.raises(Called, match=f"^{full}$"):
        QUERIES[query](spark, SF)


def test_tokens_of_a_document_are_counted_where_its_text_was_sent(spark, tmp_path):
    docs = [(1, "en", "a b  a"), (1, "en", "b\tc"), (2, None, "a\na"), (3, "fr", None), (4, "fr", "")]
    spark.createDataFrame(docs, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = fx.token_counts(spark, str(tmp_path))
    assert sorted(map(tuple, counts.collect()), key=str) == sorted(
        [("en", 1, "a", 2), ("en", 1, "b", 2), ("en", 1, "c", 1), (None, 2, "a", 2)], key=str)
    plan = normalize.log_normalize(counts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
