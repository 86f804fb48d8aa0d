"""Bit-parallel expansion, digests of ranges, index files and parsed indexes against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tarnmark.operators import graph, sync
from tarnmark.operators.digests import BRANCH, differing_leaves, digest_tree, leaf, status_by_digests
from tarnmark.operators.graph_bits import BITS, expand_bits, numbered
from tarnmark.operators.index_files import IndexFiles, index_cost
from tarnmark.operators.links import synthesized_index
from tarnmark.operators.navigation import index_token_cost
from tarnmark.operators.parsing import parse_indexes


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(4)
    rows = [(f"n{rng.randrange(120)}", k, "hub" if rng.random() < 0.3 else f"n{rng.randrange(120)}", rng.random() < 0.9) for k in range(400)]
    rows += [("hub", k, f"n{k}", True) for k in range(60)] + [("n1", 0, "n1", True)]
    return spark.createDataFrame(rows, "source_id string, edge_pos int, target_id string, resolved boolean")


@pytest.mark.parametrize("hops,direction", [(0, "out"), (1, "both"), (3, "out"), (3, "in")])
def test_bits_reach_what_rows_reach(spark, edges, hops, direction):
    rng = random.Random(hops)
    starts = [(q, f"n{rng.randrange(120)}") for q in range(150) for _ in range(rng.randrange(1, 4))] + [(999, "none"), (1000, "hub"), (1000, "hub")]
    df = spark.createDataFrame(starts, "query_id long, id string").repartition(5)
    rows = lambda d: sorted((r.query_id, r.id, r.distance) for r in d.collect())
    got = rows(expand_bits(df, edges, hops, direction))
    assert got == rows(graph.expand(df, edges, hops, direction))
    assert bool(got) == (hops > 0)


def test_words_are_full_and_bits_distinct(spark, edges):
    df = spark.createDataFrame([(f"q{i}", f"n{i % 9}") for i in range(300)], "query_id string, id string").repartition(7)
    got = [(r.word, r.bit) for r in numbered(df).collect()]
    assert sorted(got) == [(i // BITS, i % BITS) for i in range(300)]
    assert expand_bits(df.limit(0), edges, 2).count() == 0
    with pytest.raises(ValueError):
        expand_bits(df, edges, -1)


def store_rows(spark, rows):
    return spark.createDataFrame([(f"d{i}", f"c{i}", "t", "{}", h) for i, h in rows], "doc_id string, concept_id string, page_content string, metadata string, content_hash string")


def test_digests_find_what_a_join_finds(spark):
    old = store_rows(spark, [(i, f"h{i}") for i in range(2000)])
    new = store_rows(spark, [(i, f"h{i}" if i % 100 else f"new{i}") for i in range(10, 2010)])
    status = lambda d: sorted((r.doc_id, r.status) for r in d.collect())
    assert status(status_by_digests(new, old)) == status(sync.sync_status(new, old))
    assert {s for _, s in status(status_by_digests(new, new))} == {"skipped"}
    assert {s for _, s in status(status_by_digests(new, old.limit(0)))} == {"added"}
    assert status(status_by_digests(new, old, leaves=1)) == status(sync.sync_status(new, old))
    with pytest.raises(TypeError):
        status_by_digests(new, old.drop("content_hash"))


def test_only_leaves_that_differ_are_joined(spark):
    old = store_rows(spark, [(i, f"h{i}") for i in range(5000)])
    changed = [17, 400, 4999]
    new = store_rows(spark, [(i, f"h{i}" + "!" * (i in changed)) for i in range(5000)])
    leaves = 4 * BRANCH
    odd = {r.leaf for r in differing_leaves(digest_tree(old, leaves), digest_tree(new, leaves)).collect()}
    assert odd == {r.x for r in new.where(F.col("doc_id").isin([f"d{i}" for i in changed])).select(leaf("doc_id", leaves).alias("x")).collect()}
    assert differing_leaves(digest_tree(old, leaves), digest_tree(old.repartition(9), leaves)).count() == 0


@pytest.fixture(scope="module")
def concepts(spark):
    return spark.createDataFrame([(f"k/{i:04}", f"Tïtle {i}" if i % 3 else ("" if i % 2 else None)) for i in range(500)], "id string, title string").repartition(6)


def test_index_in_parts_is_the_index(spark, concepts):
    body = synthesized_index(concepts).first().body
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little is one part
    files = IndexFiles.write(concepts)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = body.encode()
    assert files.read() == text and files.size == len(text) and files.parts.count() > 1
    for start, size in ((0, 5), (3, 40), (2000, 9000), (len(text) - 7, 100), (len(text), 5), (0, 0)):
        assert files.read(start, size) == text[start : start + size]
    for r in files.entries().where("id in ('k/0000', 'k/0001', 'k/0499', 'k/0250')").collect():
        assert text[r.start : r.start + r.size].decode().endswith(f"(/{r.id}.md)\n")
    assert index_cost(concepts).first().tokens == index_token_cost(synthesized_index(concepts)) == len(body) // 4
    none = IndexFiles.write(concepts.limit(0))
    assert none.read() == b"# Index\n\n" and index_cost(concepts.limit(0)).first().tokens == 2
    with pytest.raises(ValueError):
        files.read(-1)


def test_parsed_indexes(spark):
    texts = ["# T\n\nwords\n- [a](a.md) [[W]] [b](a.md)", None, "[x](../../x.md)", "```\n# no"]
    got = parse_indexes(spark.createDataFrame(list(enumerate(texts)), "n int, raw string")).orderBy("n").collect()
    assert [(r.title, r.description, r.concept_ids) for r in got[:2]] == [("T", "words - [a](a.md) [[W]] [b](a.md)", ["a", "w"]), (None, None, [])]
    assert "escapes" in got[2].reason and got[2].concept_ids is None
    assert (got[3].title, got[3].reason) == (None, None)
