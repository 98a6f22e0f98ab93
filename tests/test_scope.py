"""The queries that do more than their SQL equal it where its cut is made on their input or their result, so they differ by that cut alone."""

import pytest
from oracle import same
from pyspark.sql import functions as F

from gridloom.plans import catalog

THREE = ("click", "view", "purchase")
ASCII = r"\A[ -~]*\z"


@pytest.fixture(scope="module")
def narrow(duck, data, tmp_path_factory):
    """Embeddings of the first n dimensions, of all rows or of each third."""
    at = {}
    for name, n, where in (("four", 4, "true"), ("three", 3, "true"), ("third", 4, "vec_id % 3 = 0")):
        d = tmp_path_factory.mktemp(name)
        duck.sql(f"copy (select vec_id, label, embedding[1:{n}] as embedding from embeddings where {where}) to '{d}/embeddings.parquet'")
        at[name] = str(d)
    return at


@pytest.mark.parametrize(
    ("name", "dims"),
    [*((n, "four") for n in ("ss_loadings", "loadings_report", "loading_congruence", "variance_explained", "ssq_factor_order")), ("congruence_report", "three"), ("theta_hat", "third")],
)
def test_loadings_queries_equal_their_sql_over_its_dimensions(name, dims, spark, narrow, duck):
    same(catalog.QUERIES[name](spark, narrow[dims]), catalog.ORACLES[name], duck)


@pytest.mark.parametrize("name", ["strip_dates", "clean_parens"])
def test_name_queries_equal_their_sql_over_ascii_names(name, spark, data, duck):
    same(catalog.QUERIES[name](spark, data).filter(F.col("model_name").rlike(ASCII)), catalog.ORACLES[name], duck)


def test_pivots_equal_their_sql_over_its_three_event_types(spark, data, duck):
    same(catalog.QUERIES["pivot_matrix"](spark, data).select("row_key", *THREE), catalog.ORACLES["pivot_matrix"], duck)
    same(catalog.QUERIES["unpivot_matrix"](spark, data).filter(F.col("col_key").isin(*THREE)), catalog.ORACLES["unpivot_matrix"], duck)
