"""A small store of notes: loading, search, links, retrieval, sync, routing, tools."""

import pytest
from pyspark.sql import functions as F

from tarnmark.errors import BundleInvalid, BundleNotFound, ConceptNotFound, LinkUnresolved
from tarnmark.operators import graph, routing, search, sync, vectors
from tarnmark.operators.agent_tools import create_tools
from tarnmark.plans.bundle import Bundle


def note(meta, body=""):
    return f"---\n{meta}\n---\n{body}"


#: Ferries: three levels of folders, wikilinks by title and alias, one note that all roads lead to, and one that nothing links to.
STORE = {
    "index.md": "Routes of the northern islands,\nkept by the harbour office.\n\n## Where to begin\n\nSee [[Skarv]] or the [fares](money/fares.md#adults).\n",
    "boats/log.md": "06:10 left Skarv",
    "boats/new/asta.md": note("type: boat\ntitle: Asta", "Replaces [[M/F Hilma]], not the [sunken one](../old/gudrun.md).\n"),
    "boats/old/hilma.md": note(
        "type: boat\ntitle: M/F Hilma\ntimestamp: 2019-05-04T06:00:00+02:00\nberths: 12",
        "Calls at [one](/islands/north/skarv.md), [two](/islands/north/tern.md) and [three](/islands/south/lunde.md), back at [[Cormorant]].\n~~~\n[four](/money/fares.md)\n~~~\n",
    ),
    "islands/north/skarv.md": note("type: island\ntitle: Skarv\naliases: [Cormorant]", "By way of [[tern]]; see [[fares|what it costs]].\n"),
    "islands/north/tern.md": note("type: island\ntitle: Tern\ntags: [quiet]", "[The boat](../../boats/old/hilma.md) comes from [[Skarv]].\n"),
    "islands/south/lunde.md": note("type: island\ndescription: Puffins, mostly.\ntags: [quiet, windy]", "No links here.\n"),
    "money/fares.md": note("type: table\ntitle: Fares", "Adults pay 40, children sail free.\n"),
}
ASTA, HILMA, SKARV, TERN, LUNDE, FARES = "boats/new/asta", "boats/old/hilma", "islands/north/skarv", "islands/north/tern", "islands/south/lunde", "money/fares"


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text, encoding="utf-8")
    return root


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return Bundle.load(spark, write(tmp_path_factory.mktemp("store"), STORE))


def ids(df):
    return [r.id for r in df.collect()]


def test_loaded(store):
    assert ids(store.all_concepts().select("id")) == [ASTA, HILMA, SKARV, TERN, LUNDE, FARES]
    index = store.index().first()
    assert (index.title, index.description, index.concept_ids) == (None, "Routes of the northern islands, kept by the harbour office.", ["skarv", FARES])
    hilma = store.get(HILMA)
    assert (hilma.ts_iso, hilma.ts_offset_s, hilma.extra) == ("2019-05-04T06:00:00+02:00", 7200, '{"berths": 12}')
    assert hilma.outbound_links == [SKARV, TERN, LUNDE, "cormorant"]
    with pytest.raises(ConceptNotFound, match="Asta"):
        store.get("boats/new/Asta")


def test_search(store):
    assert ids(store.search("quiet")) == [TERN, LUNDE]
    assert ids(store.search("HILMA")) == [HILMA, ASTA, TERN]
    assert [(r.id, r.score) for r in store.search("puffins pay pay", 2).collect()] == [(LUNDE, 2), (FARES, 2)]
    assert ids(store.search("?!")) == [] and ids(store.search("")) == []
    assert [(r.id, r.score) for r in store.search("tern tern", 1).collect()] == [(TERN, 8)]
    with pytest.raises(ValueError):
        store.search("", 0)


def test_links(store):
    assert [(r.target_id, r.link_kind) for r in store.links_from(HILMA).collect()] == [(SKARV, "markdown"), (TERN, "markdown"), (LUNDE, "markdown"), (SKARV, "wiki")]
    assert [(r.target_id, r.resolved) for r in store.links_from(ASTA).collect()] == [(HILMA, True), ("boats/old/gudrun", False)]
    assert [r.source_id for r in store.backlinks(SKARV).collect()] == [HILMA, HILMA, TERN]
    assert store.backlinks(ASTA).count() == 0
    with pytest.raises(ConceptNotFound):
        store.backlinks("none")


def test_neighbors(store):
    assert ids(store.neighbors(FARES, 2, "in")) == [SKARV, HILMA, TERN]
    assert ids(store.neighbors(ASTA, 3)) == [HILMA, SKARV, TERN, LUNDE, FARES]
    assert ids(store.neighbors(LUNDE, 1, "both")) == [HILMA] and ids(store.neighbors(LUNDE, 0)) == []
    with pytest.raises(ValueError):
        store.neighbors(ASTA, -1)
    with pytest.raises(ValueError):
        store.neighbors(ASTA, 1, "up")


def test_errors_are_gathered(spark, tmp_path):
    root = write(tmp_path, {"a.md": note("type: x", "[b](b.md)"), "b.md": "bad", "_c.md": note("title: no type"), "d.md": b"\xff\xfe", "index.md": "[o](../o.md)"})
    with pytest.raises(BundleInvalid) as e:
        Bundle.load(spark, root)
    assert list(e.value.failed_files) == ["_c.md", "b.md", "d.md", "index.md"]
    assert e.value.failed_files["d.md"] == "file is not valid UTF-8"
    bundle = Bundle.load(spark, root, on_error="skip")
    assert ids(bundle.all_concepts()) == ["a"] and not bundle.links_from("a").first().resolved
    assert bundle.index().first().body == "# Index\n\n- [a](/a.md)\n"
    assert {r.path for r in bundle.skipped.collect()} == {"_c.md", "b.md", "d.md", "index.md"}


def test_roots(spark, tmp_path):
    with pytest.raises(BundleNotFound, match="not found"):
        Bundle.load(spark, tmp_path / "none")
    (tmp_path / "f.md").write_text("x")
    with pytest.raises(BundleNotFound) as e:
        Bundle.load(spark, tmp_path / "f.md")
    assert e.value.reason == "not_a_directory"
    with pytest.raises(ValueError):
        Bundle.load(spark, tmp_path, on_error="ignore")
    (tmp_path / "empty").mkdir()
    with pytest.warns(UserWarning, match="no concept files"):
        assert Bundle.load(spark, tmp_path / "empty").index().first().body == "# Index\n\n"
    with pytest.warns(DeprecationWarning):
        LinkUnresolved("a", "b")


def test_wiki_resolution(spark, tmp_path):
    files = {
        "x/nights.md": note("type: t\ntitle: Dark Nights\naliases: [Purchases]"), "y/nights.md": note("type: t"), "z/other.md": note("type: t\naliases: [purchases]"),
        "n.md": note("type: t", "[[NIGHTS]] [[dark nights]] [[X/Nights]] [[Purchases]] [[nobody]] [[other|O]]"),
    }
    got = [(r.target_id, r.resolved, r.ambiguous) for r in Bundle.load(spark, write(tmp_path, files)).links_from("n").collect()]
    assert got == [("nights", False, True), ("x/nights", True, False), ("x/nights", True, False), ("purchases", False, True), ("nobody", False, False), ("z/other", True, False)]


def test_graph_retrieval(spark, store):
    hits = [("q", 1, "none", None), ("q", 2, ASTA, store.root), ("q", 3, ASTA, None), ("q", 4, FARES, "/other"), ("q", 5, None, None)]
    df = spark.createDataFrame(hits, "query_id string, hit_rank int, concept_id string, bundle_root string")
    got = vectors.graph_retrieve(df, store.concepts, store.edges, store.root, expand_hops=2).orderBy("rank").collect()
    assert [r.concept_id for r in got] == [ASTA, HILMA, SKARV, TERN, LUNDE]
    assert '"title":"Asta"' in got[0].metadata and "description" not in got[0].metadata
    assert vectors.graph_retrieve(df, store.concepts, store.edges, store.root, expand_hops=0).count() == 1


def test_expansion_counts_from_the_nearest_start(spark):
    edges = spark.createDataFrame([(a, 0, b, True) for a, b in ["ab", "bc", "cd", "da", "xc", "aa"]], "source_id string, edge_pos int, target_id string, resolved boolean")
    starts = spark.createDataFrame([(1, "a"), (1, "x"), (2, "d"), (3, "none")], "query_id int, id string")
    got = {(r.query_id, r.id, r.distance) for r in graph.expand(starts, edges, 5).collect()}
    assert got == {(1, "b", 1), (1, "c", 1), (1, "d", 2), (2, "a", 1), (2, "b", 2), (2, "c", 3)}


def test_nearest_vectors(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "doc_id int, embedding array<double>")
    queries = spark.createDataFrame([(7, [2.0, 0.1]), (8, [0.0, 0.0])], "query_id int, embedding array<double>")
    got = [(r.query_id, r.hit_rank, r.doc_id) for r in vectors.nearest(store, queries, 2).orderBy("query_id", "hit_rank").collect()]
    assert got == [(7, 1, 1), (7, 2, 3), (8, 1, 1), (8, 2, 2)]
    assert vectors.nearest(store, queries.limit(0), 2).count() == 0


def test_sync(spark, store):
    docs = sync.prepared(store.concepts, store.root)
    empty = docs.limit(0)
    counts = lambda status: tuple(sync.sync_counts(status).first())[:4]
    assert counts(sync.sync_status(docs, empty)) == (6, 0, 0, 0)
    full = sync.merged(empty, sync.sync_status(docs, empty))
    assert counts(sync.sync_status(docs, full)) == (0, 0, 6, 0)
    assert counts(sync.sync_status(docs, full, overwrite=True)) == (0, 6, 0, 0)
    changed = sync.prepared(store.concepts.withColumn("body", F.when(F.col("id") == FARES, "new").otherwise(F.col("body"))), store.root)
    assert counts(sync.sync_status(changed, full)) == (0, 1, 5, 0)
    assert sync.merged(full, sync.sync_status(changed, full)).count() == 6
    with pytest.raises(TypeError, match="content_hash"):
        sync.sync_status(docs, full.drop("content_hash"))


def test_sync_outside_spark(store):
    docs = sync.prepared(store.concepts, store.root).coalesce(1)

    def write(rows):
        if any(r["concept_id"] == ASTA for r in rows):
            raise RuntimeError("store is full\nand more")

    got = {r.concept_id: (r.status, r.error) for r in sync.sync_external(docs, lambda ids: {}, write, batch_size=2).collect()}
    assert got[HILMA] == ("failed", f"{HILMA}: RuntimeError: store is full")
    assert sorted(s for s, _ in got.values()) == ["added"] * 4 + ["failed"] * 2
    with pytest.raises(ValueError):
        sync.sync_external(docs, None, None, batch_size=0)


def test_routing(spark, store, tmp_path):
    asked = ["Asta", "  TERN ", "m f  HILMA!", "windy", "skar", "asta and fares", "", "  ", None]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, query string")
    route = lambda **k: [r.route for r in routing.route(df, store.concepts, **k).orderBy("i").collect()]
    assert route(has_store=True) == ["bundle"] * 4 + ["vector"] * 5
    assert route(has_store=False) == ["bundle"] * 9
    log = str(tmp_path / "calls")

    def said(prompt):
        with open(log, "a") as f:
            f.write("x")
        return "Route: BOTH." if "fares" in prompt else "bundle or vector"

    routed = routing.route(df, store.concepts, has_store=True, classifier=said)
    for _ in range(2):
        assert [r.route for r in routed.orderBy("i").collect()] == ["bundle"] * 4 + ["vector", "both", "vector", "vector", "vector"]
    assert routed.count() == 9
    assert len(open(log).read()) == 6  # once for each query that is not blank
    assert route(has_store=False, classifier=said) == ["bundle"] * 9


def test_retriever_documents(spark, store):
    queries = spark.createDataFrame([(1, "quiet"), (2, "zzz")], "query_id int, query string")
    got = search.retrieve(store.concepts, queries, store.root, 2).orderBy("rank").collect()
    assert [(r.query_id, r.concept_id) for r in got] == [(1, TERN), (1, LUNDE)]


def test_tools(store):
    read, find, show, index = create_tools(store)
    assert [t.name for t in (read, find, show, index)] == ["read_concept", "search_concepts", "list_links", "read_index"]
    assert read.invoke({"concept_id": LUNDE}) == (
        f"# {LUNDE}\n\nID: {LUNDE}\nType: island\nDescription: Puffins, mostly.\nTags: quiet, windy\nRelated (resolved): none\nRelated (unresolved): none\n\n---\n\nNo links here."
    )
    assert f"Timestamp: 2019-05-04T06:00:00+02:00\nRelated (resolved): {SKARV}, {TERN}, {LUNDE}\nRelated (unresolved): none\n" in read.invoke({"concept_id": HILMA})
    assert read.invoke({"concept_id": "x"}) == "Error: Concept not found in bundle: x"
    assert find.invoke({"query": "puffins"}) == f"1. {LUNDE} - {LUNDE} (type: island)\n   Puffins, mostly."
    assert find.invoke({"query": "zzz'zz"}) == "No concepts matched the query \"zzz'zz\"."
    assert find.invoke({"query": "a", "top_k": 26}).startswith("Error: invalid tool input at top_k: ")
    assert find.invoke({}).startswith("Error: invalid tool input at query: ")
    assert show.invoke({"concept_id": HILMA}) == (
        f"Links for {HILMA} (direction: both):\n-> {SKARV} - Skarv\n-> {TERN} - Tern\n-> {LUNDE} - {LUNDE}\n<- {ASTA} - Asta\n<- {TERN} - Tern"
    )
    assert show.invoke({"concept_id": ASTA, "direction": "out"}).endswith("\n-> boats/old/gudrun - boats/old/gudrun (unresolved)")
    assert show.invoke({"concept_id": LUNDE, "direction": "out"}) == f"No links found for {LUNDE} (direction: out)."
    assert show.invoke({"concept_id": LUNDE, "direction": "up"}).startswith("Error: ")
    assert index.invoke() == STORE["index.md"]
    with pytest.raises(TypeError):
        create_tools("bundle")


def test_nearest_ties_count_after_rounding(spark):
    close = [(2, [1.0, 1e-7]), (1, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])]
    asked = spark.createDataFrame([("q", [1.0, 1e-7]), ("z", [0.0, 0.0])], "query_id string, embedding array<double>")
    for parts in (1, 4):
        rows = spark.createDataFrame(close, "doc_id long, embedding array<double>").repartition(parts)
        for k in (1, 2, 9):
            got = {}
            for r in vectors.nearest(rows, asked, k).orderBy("hit_rank").collect():
                got.setdefault(r.query_id, []).append(r.doc_id)
            assert got == {"q": [1, 2, 4, 3][:k] if k < 3 else got["q"], "z": [1, 2, 3, 4][:k]}
            assert got["q"][:2] == [1, 2][:k]


def test_batch_search_in_passes(spark, store, monkeypatch):
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["hilma", "quiet quiet puffins", "", "?!", "island boat what"] * 3)], "query_id int, query string")
    want = sorted(tuple(r) for r in search.search(store.concepts, asked, 3).collect())
    assert [r[2] for r in want if r[0] == 0] == ids(store.search("hilma", 3))
    monkeypatch.setattr(search, "PASS_BYTES", 20)
    monkeypatch.setattr(search, "BLOCK", 2)
    assert sorted(tuple(r) for r in search.search(store.concepts, asked, 3).collect()) == want
    assert search.search(store.concepts, asked.limit(0), 3).count() == 0
