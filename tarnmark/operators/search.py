"""Weighted lexical search, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tarnmark.functions.text import casefold, tokens
from tarnmark.storage import materialize

#: What a token found in each field adds to the score.
WEIGHTS = {"title": 4, "tags": 3, "description": 2, "body": 1}
#: Queries that come together as one row, and UTF-8 bytes of queries that one pass over the concepts takes.
BLOCK, PASS_BYTES = 256, 16 << 20
#: Weights of a slice of concepts (concepts x terms of a pass), concepts of a slice at most, and words whose terms a task remembers, of so many characters at most.
SLICE_CELLS, SLICE_ROWS, KNOWN_WORDS, KNOWN_CHARS = 1 << 22, 512, 1 << 19, 64
NONE = np.zeros(0, np.int32)


def folded(fold: Callable[[Column], Column] = casefold) -> Column:
    """The case-folded fields as the only element of an array: bound to a lambda, they are computed once for each row."""
    blank = lambda n: fold(F.coalesce(F.col(n), F.lit("")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda tag: fold(tag))
    return F.array(F.struct(blank("title").alias("title"), tags.alias("tags"), blank("description").alias("description"), blank("body").alias("body")))


def weight(t: Column, fields: Column) -> Column:
    """What one occurrence of a token adds: the weights of the fields that contain it; fields are case-folded already."""
    hits = {n: F.exists(fields[n], lambda g: F.contains(g, t)) if n == "tags" else F.contains(fields[n], t) for n in WEIGHTS}
    return sum((F.when(found, F.lit(WEIGHTS[n])).otherwise(F.lit(0)) for n, found in hits.items()), F.lit(0))


def score(query_tokens: Column, fields: Column) -> Column:
    """Every token occurrence adds its weight."""
    return F.aggregate(query_tokens, F.lit(0), lambda total, t: total + weight(t, fields))


def blocks_of(queries: DataFrame, fold: Callable[[Column], Column] = casefold) -> DataFrame:
    """(part, b, terms, asked): up to BLOCK queries; their distinct tokens, and of each query the places of its tokens among them."""
    asked = queries.select("query_id", tokens(fold(F.col("query")), fold=False).alias("t")).where("size(t) > 0")
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("query")), F.lit(0))).first()
    parts = -(-size // PASS_BYTES) or 1
    h = F.xxhash64("query_id")
    grouped = asked.groupBy(F.pmod(h, F.lit(parts)).alias("part"), F.pmod(F.shiftright(h, 20), F.lit(max(1, -(-n // (BLOCK * parts))))).alias("b"))
    blocks = grouped.agg(F.collect_list(F.struct("query_id", "t")).alias("q")).withColumn("terms", F.array_distinct(F.flatten("q.t")))
    places = F.transform("q", lambda q: F.struct(q["query_id"].alias("query_id"), F.transform(q["t"], lambda t: F.array_position("terms", t).cast("int") - 1).alias("at")))
    return materialize(blocks.select("part", "b", "terms", places.alias("asked")), "queries")


def _spread(concepts: DataFrame) -> DataFrame:
    """Concepts dealt out anew where a plain scan has fewer partitions than there are cores (a small table in one file)."""
    cores = concepts.sparkSession.sparkContext.defaultParallelism
    plan = concepts._jdf.queryExecution().sparkPlan().toString()
    if any(x in plan for x in ("Exchange", "Join", "Aggregate", "Window", "Sort")):
        return concepts
    return concepts.repartition(cores) if concepts.rdd.getNumPartitions() < cores else concepts


class _Terms:
    """The terms that lie within a word, each word looked at once."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, np.ndarray] = {}
        self.lengths: dict[str, set[int]] = {}  # of the terms that begin with these three characters, or are shorter
        for t in terms:
            self.lengths.setdefault(t[:3], set()).add(len(t))
        self.short = sorted({len(t) for t in terms if len(t) < 3})

    def within(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            number, lengths = self.number, self.lengths
            parts = [x for n in self.short for at in range(len(word) - n + 1) if (x := word[at : at + n]) in number]
            for at in range(len(word) - 2):
                if more := lengths.get(word[at : at + 3]):
                    parts += [x for n in more if (x := word[at : at + n]) in number]
            found = np.array([number[x] for x in set(parts)], np.int32) if parts else NONE
            if len(word) <= KNOWN_CHARS:
                self.known[word] = found
        return found

    def of(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of what lies within the words of each row; pairs may repeat."""
        words = lists.flatten().dictionary_encode()
        held = [self.within(w) for w in words.dictionary.to_pylist()] or [np.zeros(0, np.int32)]
        size = np.array([len(x) for x in held])
        start, at = np.cumsum(size) - size, words.indices.to_numpy()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        many = size[at]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[at], many)
        return np.repeat(row, many), np.concatenate(held)[place]


def _best(shipped, top_k: int):
    """Rows (id, words of each field) to the task's own best (query_id, id, score) of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, blocks, kind = shipped.value
        find = _Terms(terms)
        exact = np.float32 if sum(WEIGHTS.values()) * max((len(at) for _, asked in blocks for _, at in asked), default=0) < 1 << 24 else np.float64
        best: list[list[list[tuple]]] = [[[] for _ in asked] for _, asked in blocks]  # (minus score, is null, id)
        least = [np.ones(len(asked), exact) for _, asked in blocks]
        rows = max(1, min(SLICE_ROWS, SLICE_CELLS // max(1, len(terms))))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = [(x is None, x or "") for x in part.column(0).to_pylist()]
                weights = np.zeros((len(ids), len(terms)), exact)
                for name, weight in WEIGHTS.items():
                    hit = np.zeros(weights.shape, bool)
                    hit[find.of(part.column(part.schema.get_field_index(name)))] = True
                    weights[hit] += weight
                later = np.empty(len(ids), np.int64)  # the smaller the id, the larger
                later[sorted(range(len(ids)), key=ids.__getitem__, reverse=True)] = np.arange(len(ids))
                for (columns, asked), own, low in zip(blocks, best, least):
                    counts = np.zeros((len(columns), len(asked)), exact)
                    for q, (_, places) in enumerate(asked):
                        np.add.at(counts[:, q], places, 1)
                    scores = weights[:, columns] @ counts
                    able = np.flatnonzero((scores >= low).any(axis=0))
                    order = scores[:, able].astype(np.int64) * len(ids) + later[:, None]
                    if len(ids) > top_k:
                        taken = np.argpartition(-order, top_k - 1, axis=0)[:top_k]
                    else:
                        taken = np.broadcast_to(np.arange(len(ids))[:, None], order.shape)
                    for q, places in zip(able.tolist(), taken.T):
                        new = [(-int(s), *ids[r]) for r, s in zip(places.tolist(), scores[places, q].tolist()) if s >= low[q]]
                        own[q] = sorted(own[q] + new)[:top_k]
                        if len(own[q]) == top_k:
                            low[q] = -own[q][-1][0]
        for (_, asked), own in zip(blocks, best):
            flat = [(name, None if absent else i, -s) for (name, _), found in zip(asked, own) for s, absent, i in found]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (kind, pa.string(), pa.int32()))], names=["query_id", "id", "score"])

    return run


def search(concepts: DataFrame, queries: DataFrame, top_k: int = 5, fold: Callable[[Column], Column] = casefold) -> DataFrame:
    """(query_id, rank, id, score): the best concepts of each query (query_id, query).

    Queries are a stated set: they come in blocks, and a pass takes PASS_BYTES
    of them. A token has word characters only, so a field contains it where one
    of its words does: the distinct words of the folded fields go to the tasks,
    and each is searched for the tokens of a pass once. Scores are products of the
    weights with the counts of the tokens; a task keeps its own best ``top_k`` of
    each query, so the shuffle carries tasks x queries x top_k rows. ``fold`` makes
    letters alike, in queries and concepts. Of one score, a concept without an id
    comes last; queries of one query_id are ranked together.
    """
    if top_k < 1:
        raise ValueError(f"top_k must be at least 1, got {top_k}")
    blocks, concepts = blocks_of(queries, fold), _spread(concepts)
    words = lambda c: F.array_distinct(tokens(c, fold=False))
    fields = F.transform(folded(fold), lambda f: F.struct(*[(F.array_distinct(F.flatten(F.transform(F.filter(f[n], F.isnotnull), words))) if n == "tags" else words(f[n])).alias(n) for n in WEIGHTS]))
    rows = concepts.select("id", F.get(fields, F.lit(0)).alias("f")).select("id", "f.*")
    kind = queries.schema["query_id"].dataType
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = None
    for part in sorted(r.part for r in blocks.select("part").distinct().collect()) or [0]:  # one for each PASS_BYTES of queries
        some = blocks.where(F.col("part") == part).collect()  # PASS_BYTES or so
        terms = sorted({t for r in some for t in r.terms})
        number = {t: i for i, t in enumerate(terms)}
        asked = [(np.array([number[t] for t in r.terms]), [(q.query_id, np.array(q["at"])) for q in r.asked]) for r in some]
        shipped = concepts.sparkSession.sparkContext.broadcast((terms, asked, to_arrow_type(kind)))
        scored = rows.mapInArrow(_best(shipped, top_k), f"query_id {kind.simpleString()}, id string, score int")
        found = scored if found is None else found.unionByName(scored)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def search_one(concepts: DataFrame, query: str, top_k: int = 5, fold: Callable[[Column], Column] = casefold) -> DataFrame:
    """(rank, id, score) of a single query: a plan of one narrow pass and a top-k."""
    if top_k < 1:
        raise ValueError(f"top_k must be at least 1, got {top_k}")
    asked = tokens(fold(F.lit(query)), fold=False)
    scored = _spread(concepts).select("id", F.get(F.transform(folded(fold), lambda f: score(asked, f)), F.lit(0)).alias("score")).where("score > 0")
    top = scored.orderBy(F.desc("score"), F.asc_nulls_last("id")).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc_nulls_last("id")))).select("rank", "id", "score")


def documents_of(concepts: DataFrame, bundle_root: str, source: str = "bundle") -> DataFrame:
    """(concept_id, page_content, metadata): metadata is JSON without absent keys; ``source`` is its label of origin."""
    label = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("id"))
    return concepts.select(
        F.col("id").alias("concept_id"),
        F.col("body").alias("page_content"),
        F.to_json(
            F.struct(
                F.lit(bundle_root).alias("bundle_root"), F.col("id").alias("concept_id"), "description", "path", "resource",
                F.lit(source).alias("source"), "tags", F.col("ts_iso").alias("timestamp"), label.alias("title"), "type",
            )
        ).alias("metadata"),
    )


def retrieve(concepts: DataFrame, queries: DataFrame, bundle_root: str, top_k: int = 5, fold: Callable[[Column], Column] = casefold) -> DataFrame:
    """(query_id, rank, concept_id, page_content, metadata) of the best concepts of each query."""
    return documents_of_hits(search(concepts, queries, top_k, fold), concepts, bundle_root)


def documents_of_hits(hits: DataFrame, concepts: DataFrame, bundle_root: str) -> DataFrame:
    """Hits are a written table, small beside the concepts: bodies of hits only go on."""
    hits = materialize(hits.select("query_id", "rank", F.col("id").alias("concept_id")), "hits")
    own = concepts.join(hits.select(F.col("concept_id").alias("id")).distinct(), "id", "left_semi")
    return hits.join(documents_of(own, bundle_root), "concept_id").select("query_id", "rank", "concept_id", "page_content", "metadata")
