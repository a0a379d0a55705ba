"""The carving queries search at the operators' radius: fragments 100 blocks apart are put together."""

from blocklens.plans import carve_queries as cq


def test_queries_find_fragments_100_blocks_apart(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"u{i}", f"<p>page {i}</p>") for i in range(2)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(cq, "GAPS", [100] * 4)
    got = {r["image_id"]: (r["lba"], r["split"], r["gap"]) for r in cq.reassemble(spark, str(tmp_path)).collect()}
    assert got == {0: (3, 1, 100), 1: (3, 2, 100)}
    monkeypatch.setattr(cq.ct, "mixed", cq.two_part)
    found = [(r["image_id"], r["tier"], r["start_lba"]) for r in cq.recover(spark, str(tmp_path)).collect()]
    assert sorted(found) == [(0, 3, 3), (1, 3, 3)]
