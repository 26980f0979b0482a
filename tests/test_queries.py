"""Registered queries against their SQL; LOGTEL_ALL=1 runs every one of them."""

import os

import pytest
from comparing import DATA, difference

from logtel.plans.catalog import ORACLES, QUERIES

USUAL = [
    "checkpoint_frontier", "checkpoint_progression", "state_at_step", "dispositions", "reconcile_flush", "anchors",
    "partition_backlog", "advance_checkpoints", "bounded_read", "incremental_pull", "size_bounded_batches", "send_summary",
    "source_metrics", "duration_stats", "poll_throughput", "pair_stage_spans", "stage_lanes", "resolve_cycles",
    "stage_timeline", "run_bounds", "iteration_series", "dial_ranges", "percent_delta", "select_snapshot",
    "purge_keys", "upsert_by_key", "changed_files", "assemble_events", "write_previews", "read_row_export",
    "number_lines", "reassemble_lines", "read_checkpoints", "dump_run_errors", "drain_to_head", "stream_lines",
    "read_poll_files", "read_artifact_files", "read_iteration_files", "read_checkpoint_files", "read_dump_files", "stream_keyed_batches",
    "latest_per_key", "span_lanes", "segments_in_range", "message_metadata",
]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("LOGTEL_ALL") else USUAL)
def test_query(spark, name):
    wrong, rows, _ = difference(spark, f"{DATA}/sf0.001", name, QUERIES, ORACLES)
    assert wrong is None
    assert rows > 0
