from pyspark.sql import functions as F

from blocklens.operators import reports


def test_reports_move_items_once_and_sort_nothing_as_a_whole(spark):
    """Parts in order of the ids for a case with several parts; no range partitioning below, and the numbering sees plain columns."""
    a = spark.range(200).selectExpr("200 - id as artifact_id", "id % 10 as op_id", "if(id % 3 = 0, 'png', 'pdf') as file_type", "cast(id % 3 + 1 as int) as tier", "id * 7 as recovered_bytes",
                                    "id / 200 as confidence_score", "cast(null as string) as limitations", "id as start_lba")
    ops = spark.range(10).selectExpr("id as op_id", "if(id < 8, 1, 2) as case_id", "'Recover' as op_type", "'Completed' as status")
    got = reports.recovery_report(reports.case_artifacts(a, ops), 25)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "_item" not in "".join(line for line in plan.splitlines() if "Window" in line)
    rows = {(r["case_id"], r["part"]): [x["artifact_id"] for x in r["artifacts"]] for r in got.collect()}
    for case, n in ((1, 160), (2, 40)):
        ids = [x for p in range(-(-n // 25)) for x in rows[case, p]]
        assert len(ids) == n and ids == sorted(ids) and all(len(rows[case, p]) == 25 for p in range(n // 25))
    assert [r[0] for r in reports.artifacts_for_case(a, ops, 2).select("artifact_id").collect()] == sorted(200 - i for i in range(200) if i % 10 >= 8)
