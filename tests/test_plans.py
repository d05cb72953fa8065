"""What plans must look like: pruned scans, pushed filters, no products of two tables."""

import re

import pytest

from mnemospark.plans import registry

QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [("bm25", "doc_id:bigint,text:string"), ("topk", "doc_id:bigint,n_chars:bigint"), ("dedup_exact", "doc_id:bigint,text:string"), ("corpus_mean", "embedding:array<float>"), ("verdict_pivot", "o_orderstatus:string,o_orderpriority:string")],
)
def test_scans_read_needed_columns_only(spark, sf_dir, name, columns):
    text = plan(QUERIES[name](spark, sf_dir))
    scans = re.findall(r"ReadSchema: struct<(.*?)>(?:\s|$)", text)
    assert scans and all(set(scan.split(",")) <= set(columns.split(",")) for scan in scans)


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["who_deleted"](spark, sf_dir))
    assert "EqualTo(event_type,error)" in text


@pytest.mark.parametrize("name", ["hamming_knn", "cosine_knn", "maxsim", "jaccard_dups", "concept_bridge", "acl_filter", "borrow_best", "table_token_score", "code_graph"])
def test_no_products_of_tables(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    # one-row tables (whitening) may be crossed; they come from an aggregate without a key
    assert text.count("BroadcastNestedLoopJoin") <= (2 if name == "hamming_knn" else 0)


@pytest.mark.parametrize("name", ["bm25", "hamming_knn", "lineage", "salience", "rrf", "chunk_text_512", "span_density"])
def test_stays_in_the_jvm(spark, sf_dir, name):
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, sf_dir)))
