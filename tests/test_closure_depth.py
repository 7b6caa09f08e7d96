from sourceloom.operators import graphs


def test_chains_of_more_than_a_hundred_hops(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(104)] + [(104, 50)], "source_id long, target_id long").coalesce(1)
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {(r.node, r.depth) for r in graphs.closure(edges, seeds).collect()} == {(k, k) for k in range(105)}
