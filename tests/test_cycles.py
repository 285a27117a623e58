"""Components and listed cycles against brute force, and the number of jobs on long chains."""

import random

import pytest

from tracelode.operators import graph


def brute(edges):
    nodes = {x for e in edges for x in e}
    reach = {a: {y for x, y in edges if x == a} for a in nodes}
    for k in nodes:
        for a in nodes:
            if k in reach[a]:
                reach[a] |= reach[k]
    comp = {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes if a in reach[a]}
    return {a: (c, sum(1 for x in comp.values() if x == c)) for a, c in comp.items()}


def run(spark, edges):
    return {r["id"]: (r["component"], r["size"]) for r in graph.cycle_nodes(spark.createDataFrame(edges, "from_id string, to_id string")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(f"r{k:02d}", f"r{(k + 1) % 9:02d}") for k in range(9)] + [("s", "s"), ("t", "s"), ("a00", "a01")]
    edges += [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(34)]
    edges += [(f"n{k:02d}", f"c{k}_0") for k in range(0, 30, 5)] + [(f"c{k}_{j}", f"c{k}_{j + 1}") for k in range(0, 30, 5) for j in range(6)] + [(f"c{k}_6", f"n{(k + 7) % 30:02d}") for k in range(0, 30, 5)]
    assert run(spark, edges) == brute(edges)


def test_long_chain_takes_few_jobs(spark):
    df = spark.range(10000).selectExpr("cast(id as string) as from_id", "cast(id + 1 as string) as to_id").cache()
    df.count()
    tracker, group = spark.sparkContext.statusTracker(), "long chain"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert graph.cycle_nodes(df).count() == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) < 100  # a job an edge before chains were contracted


def test_ring_of_a_chain(spark):
    edges = [(str(k), str((k + 1) % 500)) for k in range(500)] + [("x", "3"), ("7", "y")]
    got = run(spark, edges)
    assert len(got) == 500 and set(got.values()) == {("0", 500)}


def test_listed_cycles(spark):
    edges = [("b", "c"), ("c", "a"), ("a", "b"), ("b", "a"), ("d", "d"), ("a", "d"), ("z", "a")]
    got = {tuple(r["cycle"]): (r["component"], r["length"]) for r in graph.cycles(spark.createDataFrame(edges, "from_id string, to_id string")).collect()}
    assert got == {("a", "b", "a"): ("a", 2), ("a", "b", "c", "a"): ("a", 3), ("d", "d"): ("d", 1)}
    assert graph.cycles(spark.createDataFrame([("a", "b")], "from_id string, to_id string")).count() == 0
    ring = spark.createDataFrame([(f"{k:03d}", f"{(k + 1) % 100:03d}") for k in range(100)], "from_id string, to_id string")
    assert graph.cycles(ring).count() == 0 and graph.cycles(ring, 100).first()["length"] == 100
