"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct word shingles. A signature has 60 slots of
16 bits (b-bit MinHash). It is split into 12 chunks of 5 slots. Two signatures
that differ in at most 23 slots have, by pigeonhole, a chunk with at most one
differing slot; each chunk therefore enumerates its allowed errors: one index
key for each slot left out. Pairs under that distance always share a key. (At
similarity 0.8 a slot differs with chance 0.2; a pair shares no key with chance
1e-7.) Equal sets form one class first, so copies cost nothing further.

Pairs that share a key pass three bounds inside the joins before anything is
compared: on the sizes; on a parity sketch (each shingle flips one of 1024
bits, so two sketches differ in no more bits than the sets do in shingles; of
sets above 1024 shingles a known share is drawn, and the bound is the mean and
five deviations); and, in the second pass, on the shingles that a set shares
with no other set of the pass, which no partner can contain. Links are confirmed
on the full sets; the two bounds without a draw lose none.

In a bucket of one key, every member is compared with the smallest one, its
pivot; then, in buckets that still hold several components, with a centre: the
member with the largest share of common shingles. Last, among all members that
have met a pivot, those outside its component are compared with those of other
components. Groups of near copies thus cost about two comparisons for each
member, and no link between different components is lost. Comparisons go to the
pivot's partition, salted by members, with hashed sets. Links of a later pass
join components, not documents: only the components that they touch are merged.

Defined results: null, empty and blank texts have an empty set and link with
nothing; so do rows without an id, which are kept; repeated rows are copies;
rows that share an id but not a text are linked by their own texts each; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm.common import materialize, per_batch, text_or_empty, tidy, utf8
from tarnmark.llm.graph import connected_components
from tarnmark.storage import discard

SLOTS, CHUNK = 60, 5
#: Differing slots up to which a pair is always found: each of the 12 chunks has 2 at least beyond it.
FOUND_DISTANCE = 2 * (SLOTS // CHUNK) - 1
#: Bits of the sketch, in words of 64; and the shingles that it takes at most, drawn beyond.
SKETCH_WORDS, SKETCH_BITS, SKETCH_SHINGLES = 16, 1024, 1024
#: Members of one pivot that one salt takes.
SALT_MEMBERS = 256

_RNG = np.random.default_rng(20240229)
_MULTIPLIERS = (_RNG.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_SKETCHER = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; ASCII case folded, words cut at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words))], dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    total = hashed[:n] * _PLACE[0]
    for k in range(1, width):
        total = _mix(total) + hashed[k : n + k] * _PLACE[k]
    return np.unique(_mix(total))


def least_hashes(shingles: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """For each hash function the mixed least value over the set."""
    least = np.full((len(functions), 1), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, (functions * shingles[None, at : at + 512]).min(axis=1, keepdims=True))
    return _mix(least[:, 0])


def sketch_level(n: int) -> int:
    """Of a set of n shingles one in 2 ** level is drawn, so that about SKETCH_SHINGLES remain."""
    return max(0, (n - 1) // SKETCH_SHINGLES).bit_length()


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS signed words; a bit is set where an odd number of drawn shingles fall."""
    level = sketch_level(len(shingles))
    mixed = _mix(shingles * _SKETCHER)
    drawn = mixed[mixed >> np.uint64(64 - level) == 0] if level else mixed
    odd = np.bincount((drawn & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


_SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set), signature (60 slots of 16 bits)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, hashes, sigs = [], [], []
            for text in utf8(batch.column(1)):
                s = shingle_set(text, width)
                n.append(len(s))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append((least_hashes(s, _MULTIPLIERS) & np.uint64(0xFFFF)).astype("<u2").tobytes())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "signature"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(per_batch(make), "doc_id long, n_shingles long, set_hash binary, signature binary")


_SKETCHED = "cls long, n long, level int, shingles binary, " + ", ".join(f"{s} long" for s in _SKETCH)


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """cls, n, level, shingles (sorted 64-bit hashes) and s0 to s15 of rows (cls, set_hash, text).

    Rows whose text is not of the class (an id that repeats with another text) go.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, words = [], []
            for cls, wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                s = shingle_set(text, width)
                blob = s.tobytes()
                if xxhash.xxh3_128_digest(blob) == wanted:
                    rows.append((cls, len(s), sketch_level(len(s)), blob))
                    words.append(parity_sketch(s))
            columns = np.array(words, dtype=np.int64).reshape(-1, SKETCH_WORDS)
            kinds, own = (pa.int64(), pa.int64(), pa.int32(), pa.binary()), list(zip(*rows)) or [()] * 4
            arrays = [*map(pa.array, own, kinds), *(pa.array(columns[:, k], pa.int64()) for k in range(SKETCH_WORDS))]
            return pa.RecordBatch.from_arrays(arrays, names=["cls", "n", "level", "shingles", *_SKETCH])

        return step

    return texts.select("cls", "set_hash", "text").mapInArrow(per_batch(make), _SKETCHED)


def exploded(sets: DataFrame) -> DataFrame:
    """(cls, h): one row for each shingle of rows (cls, shingles)."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, 256):
                sets_ = [np.frombuffer(b, "<i8") for b in batch.column(1).slice(at, 256).to_pylist()]
                cls = np.repeat(np.array(batch.column(0).slice(at, 256).to_pylist(), dtype=np.int64), [len(s) for s in sets_])
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.concatenate(sets_))], names=["cls", "h"])

        return step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return sets.select("cls", "shingles").mapInArrow(tidy(run), "cls long, h long")


def unshared(sets: DataFrame) -> DataFrame:
    """(cls, u): shingles of a class that no other class of sets has; classes without any are absent."""
    once = exploded(sets).groupBy("h").agg(F.count("*").alias("n"), F.min("cls").alias("cls")).where("n = 1")
    return once.groupBy("cls").agg(F.count("*").alias("u"))


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, cls): one key for each chunk and each slot of it that may differ."""
    slots = [F.substring("signature", 2 * i + 1, 2) for i in range(SLOTS)]
    keys = [
        F.xxhash64(F.lit(c * CHUNK + out), F.concat(*[slots[c * CHUNK + k] for k in range(CHUNK) if k != out]))
        for c in range(SLOTS // CHUNK)
        for out in range(CHUNK)
    ]
    return classes.select(F.explode(F.array(*keys)).alias("key"), "cls")


def _reaches(both: Column, total: Column, threshold: int) -> Column:
    """Sets of ``total`` shingles together, ``both`` of them common, reach the similarity."""
    return 100 * both >= threshold * (total - both)


def _close(a: str, b: str, threshold: int) -> Column:
    """Set sizes and sketches of the rows prefixed a and b allow the similarity."""
    distance = sum(F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in _SKETCH)
    total, share = F.col(f"{a}n") + F.col(f"{b}n"), F.pow(F.lit(0.5), F.col(f"{a}level"))
    apart = total * ((100 - threshold) / (100 + threshold))  # most shingles that only one set has
    drawn = apart * share + 5 * F.sqrt(apart * share * (1 - share))
    within = (F.col(f"{a}level") != F.col(f"{b}level")) | (distance <= drawn + 1e-6)
    return _reaches(F.least(f"{a}n", f"{b}n"), total, threshold) & within


_BOUNDS = ("n", "level", *_SKETCH)


def _as(sets: DataFrame, prefix: str, name: str) -> DataFrame:
    return sets.select(F.col("cls").alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in _BOUNDS])


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of those (pivot, member, a, b) with 100 * intersection >= threshold * union on full sets; sets: cls and shingles."""
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / SALT_MEMBERS).cast("int").alias("salts"))
    pivots = salts.join(sets, F.col("pivot") == F.col("cls")).select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.lit(None).cast("long").alias(x) for x in ("member", "a", "b")], "shingles"
    )
    members = pairs.join(salts, "pivot").join(sets, F.col("member") == F.col("cls")).select(
        "pivot", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), "member", "a", "b", "shingles"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            found = []
            sets_ = batch.column(5)
            for i, (pivot, salt, member, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)))):
                other = np.frombuffer(sets_[i].as_buffer(), dtype="<u8")
                if member is None:
                    now, own = (pivot, salt), other.copy()
                elif now == (pivot, salt) and 100 * min(len(own), len(other)) >= threshold * max(len(own), len(other)):
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= threshold * (len(own) + len(other) - both):
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    rows = pivots.unionByName(members).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("member").asc_nulls_first())
    return rows.mapInArrow(tidy(compare), "a long, b long")


def _renamed(rows: DataFrame, column: str, component: DataFrame) -> DataFrame:
    """rows with a column of nodes replaced by their components; a node without an edge is its own."""
    named = component.select(F.col("node").alias(column), F.col("component").alias("renamed"))
    return rows.join(named, column, "left").withColumn(column, F.coalesce("renamed", column)).drop("renamed")


def _mixed(labelled: DataFrame, component: DataFrame) -> DataFrame:
    """(cls, pivot, c, pc): members, with their and their pivot's component, of buckets that hold several.

    labelled: the same columns, with c and pc as nodes of component.
    """
    labelled = _renamed(_renamed(labelled, "c", component), "pc", component).select("cls", "pivot", "c", "pc")
    several = labelled.groupBy("pivot").agg(F.max(F.col("c") != F.col("pc")).alias("several")).where("several").select("pivot")
    return materialize(labelled.join(several, "pivot", "left_semi"), "mixed")


def _bounds(mixed: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(cls, s, n, level, sketch): s shingles are not of this class alone; classes that can reach nothing are absent."""
    known = sets.join(mixed.select("cls").distinct(), "cls", "left_semi")
    known = known.join(unshared(known), "cls", "left").withColumn("s", F.col("n") - F.coalesce("u", F.lit(0)))
    return materialize(known.where(100 * F.col("s") >= threshold * F.col("n")).select("cls", "s", *_BOUNDS), "bounds")


def _may_link(threshold: int) -> Column:
    """Rows prefixed a_ and b_ are of different components, and no bound rules a link out."""
    shared = _reaches(F.least("a_s", "b_s"), F.col("a_n") + F.col("b_n"), threshold)
    return (F.col("a_c") != F.col("b_c")) & shared & _close("a_", "b_", threshold)


def _with_bounds(rows: DataFrame, bounds: DataFrame, prefix: str) -> DataFrame:
    fields = ("cls", "c", "s", *_BOUNDS)
    return rows.join(bounds, "cls").select("pivot", "pc", *[F.col(x).alias(f"{prefix}{x}") for x in fields])


def _pairs(rows: DataFrame) -> DataFrame:
    names = {"pivot": "a_cls", "member": "b_cls", "a": "a_c", "b": "b_c"}
    return rows.select(*[F.col(x).alias(name) for name, x in names.items()]).distinct()


def _centre_pairs(mixed: DataFrame, bounds: DataFrame, threshold: int) -> DataFrame:
    """(pivot, member, a, b): the centre of each bucket, the members of other components that no bound rules out, and both components."""
    scored = mixed.join(bounds.select("cls", (F.col("s") / F.col("n")).alias("share")), "cls")
    centres = scored.groupBy("pivot").agg(F.min(F.struct(-F.col("share"), "cls", "c", "pc")).alias("m")).select("pivot", "m.cls", "m.c", "m.pc")
    a = materialize(_with_bounds(centres, bounds, "a_").drop("pc"), "centres")
    pairs = _with_bounds(mixed, bounds, "b_").join(a, "pivot").where(_may_link(threshold))
    return _pairs(pairs)


def _crossing_pairs(mixed: DataFrame, bounds: DataFrame, threshold: int) -> DataFrame:
    """(pivot, member, a, b): pairs of one bucket in different components that no bound rules out, and both components."""
    strays = _with_bounds(mixed.where("c <> pc"), bounds, "a_").select(F.col("pivot").alias("by"), *[F.col(f"a_{x}") for x in ("cls", "c", "s", *_BOUNDS)])
    others = _with_bounds(mixed, bounds, "b_").select(F.col("pivot").alias("with"), "pc", *[F.col(f"b_{x}") for x in ("cls", "c", "s", *_BOUNDS)])
    once = (F.col("b_c") == F.col("pc")) | (F.col("a_cls") < F.col("b_cls"))
    pairs = strays.join(others, (F.col("by") == F.col("with")) & once & _may_link(threshold))
    return _pairs(pairs)


def near_duplicates(docs: DataFrame, *, width: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Documents are linked where their shingle sets have a Jaccard similarity of
    ``threshold`` percent or more (80 at least, for which the signature is laid
    out); component_id is the smallest id reachable.
    """
    if threshold < 80:
        raise ValueError("the index guarantees similarities of 80 percent or more")
    signed = materialize(signatures(docs, width), "signatures")
    classes = (
        signed.where("set_hash is not null and doc_id is not null")
        .groupBy("set_hash")
        .agg(F.min("doc_id").alias("least_id"), F.first("signature").alias("signature"))
    )
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")  # numbers stay as written
    keys = index_keys(classes)
    shared = materialize(keys.groupBy("key").agg(F.min("cls").alias("pivot"), F.count("*").alias("size")).where("size > 1").drop("size"), "keys")
    met = materialize(keys.join(shared, "key").where("cls <> pivot").select("pivot", "cls").distinct(), "met")

    wanted = met.select("cls").unionByName(met.select(F.col("pivot").alias("cls"))).distinct()
    wanted = classes.join(wanted, "cls", "left_semi").select(F.col("least_id").alias("id"), "cls", "set_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).join(wanted, "id")
    sets = materialize(sketches(texts.distinct(), width), "sets")  # an id may repeat

    stars = met.join(_as(sets, "b_", "cls"), "cls").join(_as(sets, "a_", "pivot"), "pivot").where(_close("a_", "b_", threshold))
    stars = stars.select("pivot", F.col("cls").alias("member"), F.col("pivot").alias("a"), F.col("cls").alias("b"))
    stars = materialize(stars, "stars")
    links = materialize(_confirmed(stars, sets, threshold), "links")
    merged = [connected_components(links, "a", "b")]  # the nodes of each are components of the one before
    mixed = _mixed(met.select("cls", "pivot", F.col("cls").alias("c"), F.col("pivot").alias("pc")), merged[0])
    bounds = None
    for pairs_of in (_centre_pairs, _crossing_pairs):
        if mixed.isEmpty():
            break
        bounds = bounds or _bounds(mixed, sets, threshold)  # later buckets are among the first ones
        pairs = materialize(pairs_of(mixed, bounds, threshold), "pairs")
        if not pairs.isEmpty():
            before, links = links, materialize(_confirmed(pairs, sets, threshold), "links")
            discard(before, pairs)
            merged.append(connected_components(links, "a", "b"))
            if pairs_of is _centre_pairs:
                wider, mixed = mixed, _mixed(mixed, merged[-1])
                discard(wider)

    discard(shared, met, sets, stars, mixed, bounds, links)
    linked = classes.select("cls", "least_id", F.col("cls").alias("root"), F.lit(False).alias("linked"))
    for component in merged:
        named = component.select(F.col("node").alias("root"), F.col("component").alias("to"))
        linked = linked.join(named, "root", "left").select(
            "cls", "least_id", F.coalesce("to", "root").alias("root"), (F.col("linked") | F.col("to").isNotNull()).alias("linked")
        )
    linked = linked.where("linked")
    least = materialize(linked.groupBy("root").agg(F.min("least_id").alias("of_component")), "least")
    linked = linked.join(least, "root").select("cls", "of_component")
    labelled = classes.select("set_hash", "cls", "least_id").join(linked, "cls", "left")
    labelled = labelled.select("set_hash", F.coalesce("of_component", "least_id").alias("least_id"))
    named = signed.join(labelled, "set_hash", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least_id", "doc_id"))
    return named.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: all documents, four-word shingles, similarity 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, threshold=80)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = n.doc_id
"""
