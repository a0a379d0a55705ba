"""Components of link tables: the smallest node reached, in as many partitions as the links need."""

from blocklens.llm.graphs import components


def test_rounds_stay_in_few_partitions(spark):
    """Without merging of partitions, a round of few links must not be spread over all the session's shuffle partitions."""
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 9)] + [(7, 7)]
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        written = []
        from blocklens.llm import graphs
        cut = graphs.cut_lineage
        graphs.cut_lineage = lambda df: written.append(cut(df)) or written[-1]
        try:
            got = {tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        finally:
            graphs.cut_lineage = cut
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(k, 0) for k in range(41)} | {(100 + k, 100) for k in range(9)}
    assert len(written) > 2 and all(df.rdd.getNumPartitions() <= 8 for df in written[1:])
