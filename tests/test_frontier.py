from webloom.operators.frontier import reach


def test_chain_with_cycle_depth_3(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "a")],
                                  "src string, dst string")
    seeds = spark.createDataFrame([("a", "a")], "node string, seed string")
    got = {r.node: r.depth for r in reach(edges, seeds, 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node: r.depth for r in reach(edges, seeds, None).collect()}["e"] == 4


def test_smallest_seed_wins_at_same_depth(spark):
    edges = spark.createDataFrame([("x", "m"), ("y", "m")], "src string, dst string")
    seeds = spark.createDataFrame([("y", "hy"), ("x", "hx")], "node string, seed string")
    got = {r.node: (r.depth, r.seed) for r in reach(edges, seeds, 3).collect()}
    assert got["m"] == (1, "hx")
