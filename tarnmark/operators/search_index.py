"""Lexical search by an inverted index: postings of grams, exact scores of the candidates that can still win.

A token counts where it is a substring, so the index holds character grams: of
every field of every concept, the distinct runs of one, two and three characters.
A token of up to three characters is one gram, and its postings are exact; the
concepts that may hold a longer one are the intersection of its grams' postings.
The weights of these fields, added up over the tokens of a query, bound its
score from above.

Layout (two Parquet tables below one folder):

* ``fields``: the case-folded fields of every concept under a number; numbers
  rise with ids and 32,768 of them are a block, which is a folder.
* ``postings``: (shelf, gram, field, lot, size, docs), sorted by gram in folders
  of gram hashes. A lot is some documents of one block that one task read; docs
  are places in the lot, two bytes each, or a bitmap where that is shorter.

A search reads the postings of its own grams, bounds the scores lot by lot, and
cuts to a few candidates of each query. These get exact scores from their bodies;
a task keeps the best of each query only.
Where a bound beyond the cut still exceeds the k-th exact score, one more round
takes just the concepts whose bounds do; then nothing else can win. So the rows
are those of a full scan, while bodies are read for candidates only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmark.functions.text import casefold
from tarnmark.operators.search import SLICE_CELLS, WEIGHTS, _Terms, blocks_of, folded
from tarnmark.storage import discard, fresh_path, materialize

FIELDS = tuple(WEIGHTS)
#: Characters are digits of a gram's code in this base; documents of a block; folders of gram hashes.
BASE, BLOCK, SHELVES = 1 << 21, 1 << 15, 64
#: Characters of a text, and entries of a lot, that are taken at once; from so many documents on a posting is a bitmap; documents that are scored at once.
STRETCH, LOT_ENTRIES, DENSE, SCORED = 1 << 20, 1 << 23, BLOCK // 16, 128
#: Candidates of a query in the first round: so many times top_k, and so many at least. Blocks that are named to the scan.
FIRST, LEAST_FIRST, NAMED_BLOCKS = 4, 32, 10_000


def _distinct(codes: np.ndarray) -> np.ndarray:
    """The distinct codes in order; ``codes`` is sorted in place."""
    codes.sort()
    return codes[np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]])]


def grams(text: str) -> np.ndarray:
    """Codes of the distinct runs of one, two and three characters."""
    found = []
    for at in range(0, len(text), STRETCH):
        p = np.frombuffer(text[at : at + STRETCH + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        two = p[:-1] * BASE + p[1:]
        found.append(_distinct(np.concatenate([p, two, two[:-1] * BASE + p[2:]])))
    return found[0] if len(found) == 1 else _distinct(np.concatenate([np.zeros(0, np.int64), *found]))


def token_grams(token: str) -> np.ndarray:
    """The codes whose postings are to be intersected: the token itself, or all its runs of three."""
    codes = grams(token)
    return codes[codes >= BASE ** min(2, len(token) - 1)]


def pack(places: np.ndarray) -> bytes:
    """Places below BLOCK as two bytes each, or as a bitmap of BLOCK bits if there are many."""
    if len(places) < DENSE:
        return places.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[places] = 1
    return np.packbits(bits).tobytes()


def _packed(places: np.ndarray, starts: np.ndarray) -> pa.Array:
    """What pack gives for each run of places; only runs that become bitmaps are looked at one by one."""
    size = np.diff(starts, append=len(places))
    two, pieces, done = places.astype("<u2"), [], 0
    for k in np.flatnonzero(size >= DENSE):
        stop = starts[k] + size[k]
        pieces += [two[done : starts[k]].tobytes(), pack(places[starts[k] : stop])]
        done = stop
    pieces.append(two[done:].tobytes())
    offsets = np.concatenate([[0], np.cumsum(np.where(size >= DENSE, BLOCK // 8, 2 * size))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(pieces))])


def unpack(docs: bytes, size: int = BLOCK) -> np.ndarray:
    """A flag for each of ``size`` places from what pack gave."""
    if len(docs) == BLOCK // 8:
        return np.unpackbits(np.frombuffer(docs, np.uint8), count=size).view(bool)
    flags = np.zeros(size, bool)
    flags[np.frombuffer(docs, "<u2")] = True
    return flags


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, title, tags, description, body) to (gram, field, lot, size, docs)."""
    waiting: dict[int, list] = {k: [] for k in range(len(FIELDS))}
    n, block, lot, last = 0, None, 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        for field, parts in waiting.items():
            if parts:
                code, place = np.concatenate([c for c, _ in parts]), np.concatenate([np.full(len(c), d - lot) for c, d in parts])
                order = np.argsort(code, kind="stable")
                code, place = code[order], place[order]
                starts = np.flatnonzero(np.diff(code, prepend=-1))
                same = [pa.array(np.full(len(starts), x, t)) for x, t in ((field, np.int32), (lot, np.int64), (last - lot + 1, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(code[starts]), *same, _packed(place, starts)], names=["gram", "field", "lot", "size", "docs"])
                parts.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                if n and (row["doc"] // BLOCK != block or n >= LOT_ENTRIES):
                    yield from flush()
                    n = 0
                if not n:
                    block, lot = row["doc"] // BLOCK, row["doc"]
                last = row["doc"]
                for field, name in enumerate(FIELDS):
                    texts = row[name] if name == "tags" else [row[name]]
                    codes = [grams(x) for x in texts if x]
                    if codes:
                        waiting[field].append((_distinct(np.concatenate(codes)) if len(codes) > 1 else codes[0], row["doc"]))
                        n += len(waiting[field][-1][0])
                n += 1
    yield from flush()


def _bounds(pool: dict, size: int, terms: list[str], asked: list) -> Iterator[tuple[object, np.ndarray]]:
    """(query, upper bound of the score of each place in the lot) of the queries of a block."""
    weights, values = np.zeros((len(terms), size), np.int32), list(WEIGHTS.values())
    for total, term in zip(weights, terms):
        codes = token_grams(term).tolist()
        for field, value in enumerate(values):
            held = [pool.get((field, c)) for c in codes]
            if all(x is not None for x in held):
                total[np.logical_and.reduce([unpack(x, size) for x in held])] += value
    for query, at in asked:
        yield query, weights[at].sum(axis=0, dtype=np.int32)


def _exact(shipped, top_k: int) -> Callable:
    """Rows (doc, id, title, tags, description, body, queries) to the task's own best (query_id, doc, id, score) of each query.

    A token has no white space within, so a task looks at what lies between white
    space once for the tokens of the pass, but for those of one or two characters:
    most words hold one. Scores are products, as in a scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = list(shipped.value.values())
        names = sorted({t for terms, _ in asked for t in terms})
        number = {t: i for i, t in enumerate(names)}
        short, longer = [(t, i) for t, i in number.items() if len(t) < 3], np.array([i for t, i in number.items() if len(t) > 2], np.int64)
        find, own_terms = _Terms([names[i] for i in longer]), [np.array([number[t] for t in terms], np.int64) for terms, _ in asked]
        exact = np.float32 if sum(WEIGHTS.values()) * max((len(at) for _, queries in asked for _, at in queries), default=0) < 1 << 24 else np.float64
        at_query = {query: (b, k) for b, (_, queries) in enumerate(asked) for k, (query, _) in enumerate(queries)}
        best: dict[object, list[tuple]] = {}  # (minus score, doc, id)
        least = [np.ones(len(queries), np.int64) for _, queries in asked]
        rows, kind = max(1, min(SCORED, SLICE_CELLS // max(1, len(names)))), None
        for batch in batches:
            kind = batch.schema.field("queries").type.value_type
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows).to_pylist()
                weights, hit = np.zeros((len(part), len(names)), exact), np.zeros(len(names), bool)
                for total, row in zip(weights, part):
                    for field, value in WEIGHTS.items():
                        text = "\n".join(x for x in row[field] or () if x) if field == "tags" else row[field]
                        if text:
                            hit[:] = False
                            hit[[i for t, i in short if t in text]] = True
                            if held := [x for x in map(find.within, set(text.split())) if len(x)]:
                                hit[longer[np.concatenate(held)]] = True
                            total[hit] += value
                wanted = [np.zeros((len(part), len(queries)), bool) for _, queries in asked]
                for r, row in enumerate(part):
                    for query in row["queries"]:
                        b, k = at_query[query]
                        wanted[b][r, k] = True
                for columns, (_, queries), want, low in zip(own_terms, asked, wanted, least):
                    if not want.any():
                        continue
                    counts = np.zeros((len(columns), len(queries)), exact)
                    for k, (_, places) in enumerate(queries):
                        np.add.at(counts[:, k], places, 1)
                    scores = (weights[:, columns] @ counts).astype(np.int64)
                    able = want & (scores >= low)
                    for k in np.flatnonzero(able.any(axis=0)).tolist():
                        query = queries[k][0]
                        new = [(-int(scores[r, k]), part[r]["doc"], part[r]["id"]) for r in np.flatnonzero(able[:, k]).tolist()]
                        best[query] = sorted(best.get(query, []) + new, key=lambda x: x[:2])[:top_k]
                        if len(best[query]) == top_k:
                            low[k] = -best[query][-1][0]
        flat = [(query, doc, name, -s) for query, found in best.items() for s, doc, name in found]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (kind, pa.int64(), pa.string(), pa.int32()))], names=["query_id", "doc", "id", "score"])

    return run


class SearchIndex:
    """An index of concepts in a folder; ``build`` writes one, ``open`` takes one that was written.

    ``fold`` makes letters alike, in the concepts as they are indexed and in queries; an index is opened with what it was built with.
    """

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[Column], Column] = casefold):
        self.spark, self.path, self.fold, self.pairs = spark, path.rstrip("/"), fold, 0

    @classmethod
    def build(cls, concepts: DataFrame, path: str | None = None, fold: Callable[[Column], Column] = casefold) -> "SearchIndex":
        """From concepts (id, title, tags, description, body), sorted by id once."""
        spark = concepts.sparkSession
        out = cls(spark, path or fresh_path(spark, "search-index"), fold)
        rows = concepts.select("id", *FIELDS).orderBy(F.asc_nulls_last("id")).withColumn("doc", F.monotonically_increasing_id())
        rows = rows.select("doc", "id", F.get(folded(fold), F.lit(0)).alias("f"), (F.col("doc") / BLOCK).cast("long").alias("block"))
        rows.select("doc", "id", "f.*", "block").write.partitionBy("block").parquet(f"{out.path}/fields")
        made = out._fields().select("doc", *FIELDS).mapInArrow(_postings, "gram long, field int, lot long, size int, docs binary")
        shelf = F.pmod(F.xxhash64("gram"), F.lit(SHELVES)).cast("int")
        made.withColumn("shelf", shelf).hint("rebalance", "shelf").sortWithinPartitions("shelf", "gram").write.partitionBy("shelf").parquet(f"{out.path}/postings")
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str, fold: Callable[[Column], Column] = casefold) -> "SearchIndex":
        return cls(spark, path, fold)

    def delete(self) -> None:
        files = self.spark.createDataFrame([], "x int")
        files.written_to = self.path
        discard(files)

    def _fields(self) -> DataFrame:
        return self.spark.read.schema("doc long, id string, title string, tags array<string>, description string, body string, block long").parquet(f"{self.path}/fields")

    def _wanted(self, blocks: DataFrame) -> DataFrame:
        """(part, b, shelf, gram): the grams that the blocks of queries need."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    codes = np.unique(np.concatenate([token_grams(t) for t in row["terms"]]))
                    columns = [pa.array(np.full(len(codes), row["part"])), pa.array(np.full(len(codes), row["b"])), pa.array(codes)]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "b", "gram"])

        rows = blocks.select("part", "b", "terms").mapInArrow(run, "part long, b long, gram long")
        return rows.withColumn("shelf", F.pmod(F.xxhash64("gram"), F.lit(SHELVES)).cast("int"))

    def _candidates(self, shipped, wanted: DataFrame, kind: str, choose: Callable) -> DataFrame:
        """(query_id, doc, bound): what ``choose(query, bounds, lot)`` takes of each lot (places)."""
        postings = self.spark.read.schema("gram long, field int, lot long, size int, docs binary, shelf int").parquet(f"{self.path}/postings")
        shelves = sorted(r.shelf for r in wanted.select("shelf").distinct().collect())  # SHELVES at most
        hits = postings.where(F.col("shelf").isin(shelves)).join(wanted.drop("shelf"), "gram").select("lot", "size", "part", "b", "gram", "field", "docs")
        like = self.spark.createDataFrame([], f"query_id {kind}, doc long, bound int")
        asked_type = pa.schema([(f.name, t) for f, t in zip(like.schema, like.toArrow().schema.types)])

        def run(lot: pa.Table) -> pa.Table:
            pool = dict(zip(zip(lot.column("field").to_pylist(), lot.column("gram").to_pylist()), lot.column("docs").to_pylist()))
            key, first, out = (lot.column("part")[0].as_py(), lot.column("b")[0].as_py()), lot.column("lot")[0].as_py(), [[], [], []]
            for query, bound in _bounds(pool, lot.column("size")[0].as_py(), *shipped.value[key]):
                places = choose(query, bound, first)
                out[0] += [query] * len(places)
                out[1].append(places + first)
                out[2].append(bound[places])
            flat = [np.concatenate(x).astype(t) if x else np.zeros(0, t) for x, t in zip(out[1:], (np.int64, np.int32))]
            return pa.table([pa.array(out[0], asked_type.types[0]), *map(pa.array, flat)], schema=asked_type)

        return hits.groupBy("lot", "part", "b").applyInArrow(run, like.schema)

    def _scored(self, found: DataFrame, shipped, top_k: int) -> DataFrame:
        """(query_id, doc, id, score) of candidates, from their bodies; of each task the best top_k of each query, and only positive scores."""
        blocks = [r.block for r in found.select((F.col("doc") / BLOCK).cast("long").alias("block")).distinct().limit(NAMED_BLOCKS + 1).collect()]
        fields = self._fields()
        if len(blocks) <= NAMED_BLOCKS:
            fields = fields.where(F.col("block").isin(blocks)) if blocks else fields.limit(0)
        each = found.groupBy("doc").agg(F.collect_list("query_id").alias("queries"))  # queries of one pass
        rows = fields.join(each, "doc").select("doc", "id", *FIELDS, "queries")
        kind = found.schema["query_id"].dataType.simpleString()
        return rows.mapInArrow(_exact(shipped, top_k), f"query_id {kind}, doc long, id string, score int")

    def search(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """(query_id, rank, id, score): the best concepts of each query (query_id, query), as a full scan would find them."""
        if top_k < 1:
            raise ValueError(f"top_k must be at least 1, got {top_k}")
        # by numbers of their own, as a query_id may be repeated or null
        asked = materialize(queries.select(F.monotonically_increasing_id().alias("number"), "query_id", "query"), "asked")
        blocks = blocks_of(asked.select(F.col("number").alias("query_id"), "query"), self.fold)
        found = [self._pass(blocks.where(F.col("part") == r.part), top_k) for r in blocks.select("part").distinct().collect()]  # one for each PASS_BYTES of queries
        discard(blocks)
        out = self.spark.createDataFrame([], "query_id long, doc long, id string, score int")
        for one in found:
            out = out.unionByName(one)
        out = out.withColumnRenamed("query_id", "number").join(asked.select("number", "query_id"), "number")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
        return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")

    def _pass(self, blocks: DataFrame, top_k: int) -> DataFrame:
        """(query_id, doc, id, score) of at least the best top_k of each query."""
        many, kind = max(FIRST * top_k, LEAST_FIRST), blocks.schema["asked"].dataType.elementType["query_id"].dataType.simpleString()
        rows = blocks.collect()  # PASS_BYTES of queries or so
        shipped = self.spark.sparkContext.broadcast({(r.part, r.b): (r.terms, [(q.query_id, q["at"]) for q in r.asked]) for r in rows})

        def strongest(query, bound: np.ndarray, lot: int) -> np.ndarray:
            places = np.flatnonzero(bound)
            rank = bound[places].astype(np.int64) * BLOCK - places
            return places[np.argpartition(-rank, many)[:many]] if len(places) > many else places

        wanted = materialize(self._wanted(blocks), "wanted")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "doc")
        first = self._candidates(shipped, wanted, kind, strongest).withColumn("n", F.row_number().over(order)).where(F.col("n") <= many)
        first = materialize(first, "candidates")
        scored = materialize(self._scored(first, shipped, top_k), "scored")
        # the k-th exact score of each query, and the last bound that was looked at
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
        least = scored.withColumn("n", F.row_number().over(place)).where(F.col("n") == top_k).select("query_id", F.col("score").alias("won"), F.col("doc").alias("won_doc"))
        last = first.where(F.col("n") == many).select("query_id", "bound", "doc").join(least, "query_id", "left")
        still = last.where("won is null or bound > won or (bound = won and doc < won_doc)").collect()  # a row a query of the pass
        self.pairs += first.count()
        discard(first)
        if still:
            open_ = self.spark.sparkContext.broadcast({r.query_id: (r.won or 0, -1 if r.won_doc is None else r.won_doc, r.bound, r.doc) for r in still})

            def able(query, bound: np.ndarray, lot: int) -> np.ndarray:
                if query not in open_.value:
                    return np.zeros(0, np.int64)
                won, won_doc, last, last_doc = open_.value[query]
                places = np.flatnonzero((bound >= max(won, 1)) & (bound <= last))
                doc, own = places + lot, bound[places]
                return places[((own > won) | (doc < won_doc)) & ((own < last) | (doc > last_doc))]

            rest = materialize(self._candidates(shipped, wanted, kind, able), "candidates")
            scored = scored.unionByName(materialize(self._scored(rest, shipped, top_k), "scored"))
            self.pairs += rest.count()
            discard(rest)
        discard(wanted)
        return scored

    def search_one(self, query: str, top_k: int = 5) -> DataFrame:
        """(rank, id, score) of a single query."""
        return self.search(self.spark.createDataFrame([(0, query)], "query_id int, query string"), top_k).drop("query_id")
