"""Components against union-find over all links."""

import random

import pyarrow as pa
import pytest

from locusframe.llm import components as c
from locusframe.llm.scratch import Scratch


def truth(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def some_links(seed):
    rng = random.Random(seed)
    links = [(rng.randrange(800), rng.randrange(800)) for _ in range(450)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2001 + i) for i in range(150)]
    links += links[:20] + [(5, 5), (7000, 7000), (None, 3), (3, None)]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("nodes", [1, 7, 1 << 18])
def test_united_links_keep_components(monkeypatch, nodes):
    monkeypatch.setattr(c, "LOCAL_NODES", nodes)
    links = [x for x in some_links(1) if None not in x]
    batches = [pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links[i : i + 40])], ["a", "b"]) for i in range(0, len(links), 40)]
    out = [(a, b) for batch in c._unite(iter(batches)) for a, b in zip(*(x.to_pylist() for x in batch.columns))]
    assert len(out) <= len(links) and truth(out) == truth(links)
    assert list(c._unite(iter([]))) == []


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_connected(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    links = some_links(2)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if split == "2k" else "4m")
        got = c.connected(spark.createDataFrame(links, "a bigint, b bigint").repartition(8), Scratch(spark, "test")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["node"]: r["root"] for r in got} == truth(links) and len(got) == len(truth(links))


def test_no_links(spark):
    assert c.connected(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "test")).count() == 0
