import os

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
# every query with BLOCKLENS_ALL=1, else one or two of each area
FEW = ["suspicious_by_source", "byt04_bigram_stats", "jn03_overlap_pairs", "acq2_merge_bad_ranges", "crv06_greedy_select", "crv02_validate_candidates",
       "val_ole2", "val_sqlite", "cal2_grid_search", "cal4_benchmark_metrics", "fsc3_follow_chain", "jn13_entry_allocation", "raid1_map_lba", "aud2_verify_chain",
       "cus3_custody_admit", "rpt04_recovery_report", "prj5_detect_filesystem", "prj3_device_fingerprint", "san7_recommend_method", "str1_health_alerts"]
NAMES = sorted(entry.queries()) if os.environ.get("BLOCKLENS_ALL") else FEW

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    res = oracle.compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert not res.startswith("FAIL"), res


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["source", "objects", "suspicious", "mean_entropy", "mean_confidence", "bytes"]


def test_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
