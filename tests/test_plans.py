"""What the physical plans must and must not contain."""

import pytest

from labtables.plans.bindings import QUERIES

WRITES = {
    "flowcell_ready_stream", "latest_doc_stream", "routed_stream", "status_stream", "rollup_stream", "changes_since", "dispatch",
    "project_stream", "project_stream_rejects", "read_barcode_lookup", "list_files", "read_logs",
    "write_stats_tsv", "write_barcode_list", "write_libraries", "write_multi_sheet",
    "write_tracking", "read_long_stats", "log_facts",
}
ROW_WISE = [
    "select_processable", "jobs_to_monitor", "post_process_buckets", "job_state_to_status",
    "route_exact_prefix", "realms_by_method", "explode_samples", "explode_flowcells",
    "latest_flowcell_of_document", "libraries_rows", "array_cell_counts", "log_outcome",
    "tool_version", "feature_and_origin", "fastq_role", "species_key", "read_layout",
    "valid_report_entries", "merge_user_info", "lookup_document", "flowcell_dates",
]
ONE_SHUFFLE = [
    "qc_summary", "latest_report", "sample_counts_by_status", "pivot_types", "plate_overview",
    "current_status", "flowcell_ready", "project_rollup", "decision_table_match", "event_target",
]


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_all_pairs_join_and_no_python_per_row(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert operator not in text
    assert "Exchange SinglePartition" not in text


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_queries_do_not_shuffle(spark, sf_dir, name):
    assert "Exchange hashpartitioning" not in plan(spark, sf_dir, name)


@pytest.mark.parametrize("name", ONE_SHUFFLE)
def test_one_aggregate_is_one_shuffle(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_" in text


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "project_rollup")
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string>" in text
    assert "ReadSchema: struct<o_orderkey:bigint>" in text
    assert "EqualTo(c_custkey,42)" in plan(spark, sf_dir, "lookup_document")


def test_end_date_reads_the_log_once_and_without_a_window(spark, sf_dir):
    text = plan(spark, sf_dir, "project_end_date")
    assert text.count("FileScan") == 1 and "Window" not in text
    assert text.count("Exchange hashpartitioning") == 2


def test_sample_merge_reads_and_shuffles_each_side_once(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, sf_dir, "upsert_samples")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("FileScan") == 2 and text.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize(("name", "most"), [("join_counts", 9), ("null_share", 9), ("plate_report_overview", 15)])
def test_plate_tables_are_joined_once_and_plates_filtered_last(spark, sf_dir, name, most):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, sf_dir, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") <= most
    assert text.count("FullOuter") == 1 and text.count("LeftSemi") == 1


def test_documents_are_parsed_once(spark, sf_dir):
    text = plan(spark, sf_dir, "intake")
    assert text.count("from_json") == 1
    assert text.count("parseJson") == 1


def test_stored_table_is_not_shuffled_by_a_small_patch(spark):
    from labtables.operators.upsert import upsert_docs
    from labtables.sources.dimensions import dimension

    base = spark.range(1000).selectExpr("id", "CAST(id AS STRING) AS body")
    patch = dimension(spark, "id BIGINT, body STRING", [(1, "x"), (5000, "y")])
    text = upsert_docs(base, patch, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text
