"""Every query against its SQL twin, and the shape of its plan."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from themeloom.checks.compare import duck, rows_of_duck, rows_of_spark


@pytest.fixture(scope="module")
def con(tables):
    return duck(tables)


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, tables, con, name):
    assert rows_of_spark(queries()[name](spark, tables)) == rows_of_duck(con, oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_fitted_queries_give_rows(spark, tables, name):
    assert queries()[name](spark, tables).count() > 0


def test_entry(spark, tables):
    top = entry(spark)
    assert top.columns == ["cluster", "rank", "term", "value"]
    assert top.count() == 100


def _plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "term_frequency", "term_weights", "doc_vectors", "project_on_basis", "assign_given_centres",
        "nearest_docs_per_centre", "terms_of_nearest", "theme_nearest_terms", "compare_agreement",
        "top_terms_per_centre", "labelled_by_date",
    ],
)
def test_no_product_of_tables(spark, tables, name):
    plan = _plan(queries()[name](spark, tables))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_words_are_cut_once_and_counted_in_their_row(spark, tables):
    plan = _plan(queries()["term_frequency"](spark, tables))
    assert plan.count("regexp_extract_all") == 1
    # The one exchange spreads the small input over the cores.
    assert plan.count("Exchange") == 1


def test_only_the_needed_columns_are_read(spark, tables):
    plan = _plan(queries()["publication_counts_year"](spark, tables))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan


def test_best_per_cluster_are_picked_before_the_shuffle(spark, tables):
    plan = _plan(queries()["nearest_docs_per_centre"](spark, tables))
    assert "WindowGroupLimit" in plan and "Partial" in plan
