"""Driver contract: entry, registry, and a sample of plans against the oracle at a small scale."""

import os

import pytest

import __spark_entry__ as entry_module
from riskweave.registry import Query
from tests.oracle import compare, connect

SF = os.environ.get("RISKWEAVE_TEST_SF", "/root/testdata/sf0.001")
SAMPLE = ["poisson_anomaly", "robust_anomaly", "ewma_state", "date_spine", "halo_join", "point_to_polyline_distance", "spatiotemporal_exclusion", "catalog_upsert",
          "scan_geojson_events", "ledger_append_once", "asof_forward_next_event", "greedy_decluster_first", "paired_event_test", "weighted_auc",
          "binned_rate_2d", "point_in_time_features", "pair_support_lift", "mamdani_centroid", "cluster_evidence", "stream_decayed_state", "stream_decluster"]


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["segment", "day", "n", "a_seis"] and df.count() > 0


def test_every_oracle_has_a_query():
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert len(queries) > 200 and set(oracle) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", list(entry_module.queries()) if os.environ.get("RISKWEAVE_ALL") else SAMPLE)
def test_plan_equals_oracle(spark, name):
    status, n, _, _, detail = compare(spark, connect(SF), Query(name, entry_module.queries()[name], entry_module.oracle_sql().get(name)), SF)
    assert status in ("OK", "ROWS", "EMPTY"), detail
