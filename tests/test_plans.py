"""The physical plans are the ones wanted: pushed filters, pruned columns, top-k
without a full sort, no Python and no shuffle where none is needed."""

import contextlib
import io

import pytest

from folioforge import catalogue


def plan(df, mode="formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_lookup_pushes_filters_and_prunes(spark, sf):
    text = plan(catalogue.QUERIES["entity_item"](spark, sf))
    assert "PushedFilters: [" in text and "EqualTo(p_brand,Brand#3)" in text and "EqualTo(p_type,ECONOMY)" in text
    assert "p_retailprice" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "Exchange" not in text


@pytest.mark.parametrize("name", ["bm25_topk", "cosine_topk"])
def test_top_k_is_not_a_sort(spark, sf, name):
    text = plan(catalogue.QUERIES[name](spark, sf), "simple")
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - {"yaml_header_parse"}))
def test_no_python_in_plans(spark, sf, name):
    text = plan(catalogue.QUERIES[name](spark, sf), "simple")
    assert "Python" not in text and "InPandas" not in text and "InArrow" not in text
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["inspect_preview", "slug_hash_name", "next_steps", "classify_and_tag", "section_plan", "search_multi_collection"])
def test_row_wise_queries_do_not_shuffle(spark, sf, name):
    assert "Exchange" not in plan(catalogue.QUERIES[name](spark, sf), "simple")


def test_anti_join_is_an_equi_join(spark, sf):
    text = plan(catalogue.QUERIES["ingest_skip_unchanged"](spark, sf), "simple")
    assert "LeftAnti" in text and "NestedLoop" not in text
