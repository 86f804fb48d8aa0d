"""What components and the passes of near duplicates write: with many partitions each table has a price of its own."""

import random

import pytest

from tarnmark.llm import graph, near_dup


@pytest.fixture
def written(monkeypatch):
    names = []
    for module in (graph, near_dup):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, real=real: names.append(name) or real(df, name))
    return names


def test_stars_cost_one_table(spark, written):
    edges = [(1, 1 + k) for k in range(1, 30)] + [(100 + k, 100) for k in range(1, 5)] + [(100, 101), (7, 7), (None, 3)]
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r.node: r.component for r in found.collect()} == {k: 1 for k in range(1, 31)} | {100 + k: 100 for k in range(5)}
    assert len(written) == 1


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union(spark, written, seed):
    rng = random.Random(seed)
    nodes = rng.sample(range(10_000), 120)
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)] + [(k, k + 1) for k in range(20_000, 20_040)]
    group = {x: {x} for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b and group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((r.node, r.component) for r in found) == sorted((x, min(g)) for x, g in group.items())


def test_later_passes_merge_components_only(spark, written):
    """A group of near copies with several components in its buckets: links of the first pass are not gone through again."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(100)]
    texts = [" ".join(rng.choice(words) if rng.random() < i % 14 / 100 else w for w in base) for i in range(160)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_dup.near_duplicates(rows.repartition(3), width=4).collect()
    sets = [{tuple(t.split()[k : k + 4]) for k in range(97)} for t in texts]
    group = {i: {i} for i in range(160)}
    for i in range(160):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] is not group[j]:
                group[i] |= group[j]
                for x in group[j]:
                    group[x] = group[i]
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((i, min(g)) for i, g in group.items())
    assert written.count("pairs") == 2  # both later passes had something to compare
    assert len(written) < 24, written
