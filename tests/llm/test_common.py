import random

import pyarrow as pa
import pytest

from scholarlake.llm import common as C
from scholarlake.llm.graph import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "cycle and loops"])
def test_components(spark, kind):
    r = random.Random(4)
    nodes = r.sample(range(-1000, 1000), 120)
    edges = {
        "chain": list(zip(nodes, nodes[1:], strict=False)),
        "star": [(nodes[0], n) for n in nodes[1:]],
        "random": [(r.choice(nodes), r.choice(nodes)) for _ in range(90)],
        "cycle and loops": [*zip(nodes, nodes[1:40] + nodes[:1], strict=False), (nodes[50], nodes[50]), (nodes[60], nodes[61]), (nodes[61], nodes[60])],
    }[kind]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.component for x in got} == brute(edges) and len(got) == len(brute(edges))


def test_a_rising_chain_takes_few_rounds(spark, monkeypatch):
    from scholarlake.llm import graph

    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, what: written.append(what) or C.materialize(df, what))
    got = components(spark.range(1000).selectExpr("id AS a", "id + 1 AS b")).collect()
    assert len(got) == 1001 and {x.component for x in got} == {0} and len(written) < 15


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_steps_cover_a_batch_in_order():
    texts = ["a" * 10, None, "b" * 50, "", "c" * 5, "d" * 200]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    for limit in (1, 15, 60, 1000):
        parts = [p.column("text").to_pylist() for p in C.steps(batch, limit=limit)]
        assert sum(parts, []) == texts
        assert all(len(p) == 1 or sum(len(x or "") for x in p) <= limit for p in parts)
    assert list(C.steps(batch.slice(0, 0))) == []


def test_small_and_names(spark, monkeypatch):
    rows = spark.range(100)
    assert "broadcast" in C.small(rows, 8)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(C, "BROADCAST_BYTES", 100)
    assert "broadcast" not in C.small(rows, 8)._jdf.queryExecution().logical().toString().lower()
    assert C.unused(spark.createDataFrame([(1, 2)], "key int, KEY_ int"), "key") == "key__"


def test_intermediates_are_dropped(spark):
    before = C.written()
    first, last = C.materialize(spark.range(3).toDF("x"), "a"), C.materialize(spark.range(4).toDF("x"), "b")
    C.drop_written(before)
    assert C.written() == before + 1 and last.count() == 4
    with pytest.raises(Exception, match="(?i)does not exist|not found|PATH|no such"):
        spark.read.parquet(first.inputFiles()[0]).count()
