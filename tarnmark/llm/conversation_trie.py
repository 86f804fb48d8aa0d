"""Prefix trie of conversations: succinct level-order tries by shard, upper levels merged apart.

A prefix is known by two 64-bit sums over its turns, each turn's hash mixed with
its place; a trillion prefixes hold two different ones of equal sums with chance
1e-14. One row for each conversation and depth (conversation, depth, prefix,
parent, words) is written, and:

* Prefixes with more than LIGHT members are heavy. They are counted with partial
  aggregates, and as members add up to rows there are at most rows / LIGHT of
  them; LIGHT grows with the rows so that there are never more than UPPER.
* The shallowest prefix of a conversation that is not heavy is its shard. Shards
  are small, so any hot first turn or group of copies is split below its heavy
  part. A task sorts its shards, and for as many as fit builds one level-order
  trie in numpy: a LOUDS bit vector (a one for each child of a node, then a zero,
  in order of levels), the label of each node, and from the bits the parents;
  sums of subtrees roll up from the last level by add.at.
* Heavy prefixes, with the sums of the shards below them, form a trie of their
  own, which one task rolls up in the same way.
* The digest of the conversations that end at a heavy prefix is streamed: sorted
  ranges are joined to pieces of text where they lie, then hashed in order.

A conversation is a path, so the hashes of its turns (40 bytes each, no text) come
together in one row; 10 million turns in one conversation take 400 MB there.

Defined results: a null role or text is empty; turns without number come first;
turns of equal number are ordered by role, then by the MD5 of the text, and
repeated rows count as turns of their own; rows without conv_id belong to no
conversation and are left out; c - c % 20 is taken with the sign of c, as in SQL;
a table without conversations gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm.common import materialize, per_batch, table, tidy
from tarnmark.storage import discard

#: A word, conversations that share the start of one, and the turns at most that they take from it.
WORD, BLOCK, SHARED = r"[^\x20\x09-\x0D]+", 20, 3
#: Members of a prefix at most that a shard may hold, heavy prefixes at most, rows that one trie takes, and ids of a piece of text.
LIGHT, UPPER, TRIE_ROWS, PIECE = 32, 1_000_000, 500_000, 1 << 14
_EMPTY = hashlib.sha256(b"").hexdigest()
ROWS = "conv_id long, turns int, depth int, hi long, lo long, up_hi long, up_lo long, words long"
NODES = (
    "hi long, lo long, up_hi long, up_lo long, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
_NODES = pa.schema([(x.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]]) for x in NODES.split(", ")])


# ------------------------------------------------------------- conversations


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<a, b, words>>): each conversation's turns in order, as two hashes and a count of words."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("digest"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Sequences whose first turns are those of the first conversation of their block; how many tells a checksum of the id.

    Reads own twice, so it had better be a written table.
    """
    c = F.col("conv_id")
    shared = F.crc32(c.cast("string").cast("binary")) % (SHARED + 1)
    first = own.where(c % BLOCK == 0).select(c.alias("base"), F.slice("turns", 1, SHARED).alias("start"))
    joined = own.withColumns({"base": c - c % BLOCK, "h": shared.cast("int")}).join(first, "base", "left")
    start = F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the finisher of splitmix64; its constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth, the textless prefix of depth 0 included."""

    def make() -> Callable:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            n = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten()
            a, b, words = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            ends = np.cumsum(n + 1)  # a place for depth 0 before the turns of each
            depth = np.arange(ends[-1]) - np.repeat(ends - n - 1, n + 1)
            spread = depth > 0
            out = {"conv_id": np.repeat(batch.column(0).to_numpy(), n + 1), "turns": np.repeat(n, n + 1).astype(np.int32), "depth": depth.astype(np.int32)}
            place = _mixed(depth.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            for name, values in (("hi", a), ("lo", b)):
                own = np.zeros(ends[-1], np.uint64)
                own[spread] = _mixed(values.view(np.uint64) ^ place[spread])
                total = np.cumsum(own, dtype=np.uint64)  # modulo 2^64
                total -= np.repeat(total[ends - n - 1], n + 1)  # own is zero at depth 0, so this is what came before
                out |= {name: total.view(np.int64), f"up_{name}": (total - own).view(np.int64)}
            out["words"] = np.zeros(ends[-1], np.int64)
            out["words"][spread] = words
            names = [x.split()[0] for x in ROWS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(out[x]) for x in names], names=names)

        return step

    return turns.select("conv_id", "turns").mapInArrow(per_batch(make), ROWS)


# --------------------------------------------------------------------- LOUDS


class Louds:
    """A level-order trie: bits (a one for each child, then a zero, node by node), labels, and where levels begin.

    Node 0 stands above all tops and has no label of its own.
    """

    def __init__(self, bits: np.ndarray, labels: np.ndarray, levels: list[int]):
        self.bits, self.labels, self.levels = bits, labels, levels
        ones = np.flatnonzero(bits)
        self.parent = np.concatenate([[-1], ones - np.arange(len(ones))]).astype(np.int64)  # zeros before a node's one
        zeros = np.flatnonzero(bits == 0)
        self.children = np.diff(zeros, prepend=-1) - 1
        self.first_child = np.cumsum(self.children) - self.children + 1

    @classmethod
    def of(cls, degrees: np.ndarray, labels: np.ndarray, levels: list[int]) -> "Louds":
        bits = np.ones(degrees.sum() + len(degrees), np.uint8)
        bits[np.cumsum(degrees + 1) - 1] = 0
        return cls(bits, labels, levels)

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """The sum of values over each node's subtree."""
        out = values.copy()
        for a, b in reversed(list(zip(self.levels, [*self.levels[1:], len(out)]))):
            if a:
                np.add.at(out, self.parent[a:b], out[a:b])
        return out

    def child(self, node: int, label: tuple[int, int]) -> int | None:
        """The child with a label; labels of one node's children are sorted."""
        a, n = self.first_child[node], self.children[node]
        part = self.labels[a : a + n]
        k = int(np.searchsorted(part[:, 0], label[0]))
        while k < n and part[k, 0] == label[0]:
            if part[k, 1] == label[1]:
                return int(a + k)
            k += 1
        return None

    def packed(self) -> tuple[bytes, bytes]:
        """(bits in bytes, labels as little-endian pairs)."""
        return np.packbits(self.bits).tobytes(), self.labels.astype("<i8").tobytes()


def _grown(conv: np.ndarray, level: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[Louds, np.ndarray]:
    """(trie, node of each row) of rows that tell a conversation's prefix at each level from 0 on."""
    _, slot = np.unique(conv, return_inverse=True)
    at, node = np.zeros(slot.max() + 1, np.int64), np.zeros(len(conv), np.int64)
    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(level.max() + 2))
    degrees, labels, levels, n = [], [np.zeros((1, 2), np.int64)], [0], 1
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows = by_level[a:b]
        above = at[slot[rows]]
        order = np.lexsort((lo[rows], hi[rows], above))
        rows, above = rows[order], above[order]
        new = np.concatenate([[True], (np.diff(above) != 0) | (np.diff(hi[rows]) != 0) | (np.diff(lo[rows]) != 0)])
        node[rows] = at[slot[rows]] = n + np.cumsum(new) - 1
        start = levels[-1]
        degrees.append(np.bincount(above[new] - start, minlength=n - start))
        labels.append(np.stack([hi[rows][new], lo[rows][new]], axis=1))
        levels.append(n)
        n += int(new.sum())
    degrees.append(np.zeros(n - levels[-1], np.int64))
    return Louds.of(np.concatenate(degrees).astype(np.int64), np.concatenate(labels), levels), node


def _ends(node: np.ndarray, conv: np.ndarray, n: int) -> list[str]:
    """Of each node the digest of the conversations that end there."""
    out = [_EMPTY] * n
    order = np.lexsort((conv, node))
    node, conv = node[order], conv[order]
    cuts = np.flatnonzero(np.diff(node, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(node)]):
        out[node[a]] = hashlib.sha256(",".join(map(str, conv[a:b].tolist())).encode()).hexdigest()
    return out


def _of_shards(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The nodes of complete shards, rolled up."""
    conv, depth = rows["conv_id"], rows["depth"].astype(np.int64)
    trie, node = _grown(conv, depth - rows["s"], rows["hi"], rows["lo"])
    n = len(trie.parent)
    one = np.zeros(n, np.int64)  # a row of each node
    one[node] = np.arange(len(node))
    members, first = np.bincount(node, minlength=n), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, node, conv)
    words = rows["words"][one]
    own = np.arange(n) > 0
    leaves = trie.rolled_up(((trie.children == 0) & own).astype(np.int64))
    saved = trie.rolled_up(np.where(own, (members - 1) * words, 0))
    ended = rows["turns"] == rows["depth"]
    top = trie.parent == 0
    columns = [rows[x][one] for x in ("hi", "lo", "up_hi", "up_lo")] + [top, first, depth[one], first[np.maximum(trie.parent, 0)], members, trie.children, leaves, saved]
    arrays = [pa.array(x[1:]) for x in columns] + [pa.array(_ends(node[ended], conv[ended], n)[1:])]
    arrays[7] = pa.array(columns[7][1:], mask=top[1:])
    return pa.RecordBatch.from_arrays(arrays, schema=_NODES)


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by shard, in lots of complete shards that hold TRIE_ROWS or so."""

    def lot(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        return {x: t.column(x).to_numpy() for x in t.column_names}

    waiting, n = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
        if n >= TRIE_ROWS:
            last = waiting[-1]
            x, y = last.column("s_hi").to_numpy(), last.column("s_lo").to_numpy()
            cut = int(np.flatnonzero((x != x[-1]) | (y != y[-1]))[-1]) + 1 if (x[0], y[0]) != (x[-1], y[-1]) else 0
            if cut:  # the last shard may go on in the next batch
                yield lot([*waiting[:-1], last.slice(0, cut)])
                waiting, n = [last.slice(cut)], last.num_rows - cut
    if waiting:
        yield lot(waiting)


# ------------------------------------------------------------------- shards


def _heavy(rows: DataFrame, light: int) -> DataFrame:
    """(hi, lo, up_hi, up_lo, depth, conv_id, n_convs, words) of the prefixes with more members than ``light``."""
    counted = rows.groupBy("hi", "lo").agg(
        F.max("up_hi").alias("up_hi"), F.max("up_lo").alias("up_lo"), F.max("depth").cast("long").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
    )
    return counted.where(F.col("n_convs") > light)


def sharded(rows: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows below heavy prefixes with their shard (s_hi, s_lo) and its depth s, dealt out and sorted by shard; the written shards)."""
    known = rows.join(heavy.select("hi", "lo", F.lit(True).alias("heavy")), ["hi", "lo"], "left")
    top = F.min(F.when(F.col("heavy").isNull(), F.struct("depth", "hi", "lo"))).alias("top")
    tops = known.groupBy("conv_id").agg(top).where("top is not null")
    tops = materialize(tops.select("conv_id", F.col("top.depth").cast("long").alias("s"), F.col("top.hi").alias("s_hi"), F.col("top.lo").alias("s_lo")), "shards")
    below = rows.join(tops, "conv_id").where(F.col("depth") >= F.col("s"))
    return below.repartition("s_hi", "s_lo").sortWithinPartitions("s_hi", "s_lo"), tops


def _nodes_of_shards(below: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _whole_shards(batches):
            yield _of_shards(lot)

    return below.mapInArrow(tidy(run), NODES)


def succinct(turns: DataFrame, *, light: int = LIGHT) -> DataFrame:
    """(louds, labels, levels): the tries of all shards of sequences; ``Louds`` reads them (bits, labels and levels unpacked)."""
    rows = materialize(prefixes(turns), "prefixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _whole_shards(batches):
            trie, _ = _grown(lot["conv_id"], lot["depth"] - lot["s"], lot["hi"], lot["lo"])
            bits, labels = trie.packed()
            yield pa.RecordBatch.from_arrays([pa.array([bits]), pa.array([labels]), pa.array([trie.levels], pa.list_(pa.int64()))], names=["louds", "labels", "levels"])

    return sharded(rows, materialize(_heavy(rows, light), "heavy"))[0].mapInArrow(tidy(run), "louds binary, labels binary, levels array<long>")


# ------------------------------------------------------------- upper levels


def _digests(ends: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of rows (hi, lo, conv_id): pieces of text from sorted ranges, hashed in their order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            columns = [*[pa.array([x], pa.int64()) for x in (*key, ids[0])], pa.array([",".join(map(str, ids))])]
            return pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "first", "piece"])

        for batch in batches:
            for hi, lo, conv in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if ids and (key != (hi, lo) or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                key = hi, lo
                ids.append(conv)
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["hi", "lo", "ends_sha256"])

        for batch in batches:
            for hi, lo, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if key != (hi, lo):
                    if key:
                        yield done()
                    key, state = (hi, lo), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
        if key:
            yield done()

    cut = ends.repartitionByRange("hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id").mapInArrow(pieces, "hi long, lo long, first long, piece string")
    return cut.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(hashed, "hi long, lo long, ends_sha256 string")


def _of_upper(t: pa.Table) -> pa.RecordBatch:
    """The nodes of the upper trie, with what the shards below have summed up."""
    col = {x: t.column(x).to_numpy() for x in t.column_names if x != "ends_sha256"}
    order = np.argsort(col["depth"], kind="stable")
    ends = t.column("ends_sha256").take(pa.array(order)).to_pylist()
    col = {k: v[order] for k, v in col.items()}
    depth, n = col["depth"], len(order)
    index, parent, bfs, levels = {}, np.zeros(n + 1, np.int64), [], [0]
    cuts = np.searchsorted(depth, np.arange(depth[-1] + 2))
    for a, b in zip(cuts[:-1], cuts[1:]):  # each level in the order of its parents
        above = [index[x] if depth[a] else 0 for x in zip(col["up_hi"][a:b].tolist(), col["up_lo"][a:b].tolist())]
        levels.append(len(bfs) + 1)
        for k in np.lexsort((col["lo"][a:b], col["hi"][a:b], above)):
            bfs.append(a + int(k))
            parent[len(bfs)] = above[k]
            index[int(col["hi"][a + k]), int(col["lo"][a + k])] = len(bfs)
    bfs = np.array(bfs)
    col = {k: v[bfs] for k, v in col.items()}
    degrees = np.bincount(parent[1:], minlength=n + 1)
    trie = Louds.of(degrees, np.concatenate([np.zeros((1, 2), np.int64), np.stack([col["hi"], col["lo"]], axis=1)]), levels)
    children = degrees[1:] + col["kids"]
    up = lambda own: trie.rolled_up(np.concatenate([[0], own]))[1:]
    leaves, saved = up(col["leaves"] + (children == 0)), up(col["saved"] + (col["n_convs"] - 1) * col["words"])
    root = trie.parent[1:] == 0
    first = np.concatenate([[0], col["conv_id"]])[trie.parent[1:]]
    arrays = [pa.array(x) for x in (col["hi"], col["lo"], col["up_hi"], col["up_lo"], root, col["conv_id"], col["depth"])]
    arrays += [pa.array(first, mask=root), *map(pa.array, (col["n_convs"], children, leaves, saved)), pa.array([ends[k] for k in bfs])]
    return pa.RecordBatch.from_arrays(arrays, schema=_NODES)


def _upper(heavy: DataFrame, tops: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of heavy prefixes; UPPER at most, so one task rolls them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            yield _of_upper(pa.Table.from_batches(parts).combine_chunks())

    below = tops.where("depth > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(
        F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    ends = rows.where("depth = turns").join(heavy.select("hi", "lo"), ["hi", "lo"]).select("hi", "lo", "conv_id")
    full = heavy.join(below, ["hi", "lo"], "left").join(_digests(ends), ["hi", "lo"], "left")
    full = full.withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in ("kids", "leaves", "saved")} | {"ends_sha256": F.coalesce("ends_sha256", F.lit(_EMPTY))})
    return full.coalesce(1).mapInArrow(tidy(run), NODES)


def trie_nodes(turns: DataFrame, *, light: int = LIGHT) -> DataFrame:
    """One row a node of the trie of sequences (conv_id, turns); see NODES, without the columns that tell prefixes apart."""
    rows = materialize(prefixes(turns), "prefixes")
    light = max(light, -(-rows.count() // UPPER))
    heavy = materialize(_heavy(rows, light), "heavy")
    below, tops = sharded(rows, heavy)
    nodes = materialize(_nodes_of_shards(below), "nodes")
    upper = materialize(_upper(heavy, nodes.where("top"), rows), "upper")
    discard(rows, tops)
    names = [x.split()[0] for x in NODES.split(", ")][5:]
    above = heavy.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("above"))
    tops = nodes.where("top and depth > 0").join(above, ["up_hi", "up_lo"], "left").withColumn("parent_conv_id", F.col("above"))
    inner = nodes.where("not top or depth = 0")
    return inner.select(names).unionByName(tops.select(names)).unionByName(upper.select(names))


def trie_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12: every node of the trie of all rebuilt conversations."""
    own = materialize(sequences(table(spark, sf_dir, "conversations")), "turns")
    out = trie_nodes(rebuilt(own))
    discard(own)
    return out


#: CRC32 of a conversation's decimal id, bit by bit.
_CRC = (
    "xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: "
    "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))), 4294967295::BIGINT), 4294967295)"
)
ORACLE = f"""WITH t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT DISTINCT conv_id, {_CRC} % {SHARED + 1} AS h, conv_id - conv_id % {BLOCK} AS base FROM t),
s AS (SELECT c.conv_id, x.pos AS d, x.role, x.text FROM c JOIN t x ON x.conv_id = c.base AND x.pos <= c.h),
k AS (SELECT c.conv_id, c.h, count(s.d) AS had FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY ALL),
r AS (SELECT * FROM s UNION ALL SELECT k.conv_id, x.pos - k.h + k.had, x.role, x.text FROM k JOIN t x ON x.conv_id = k.conv_id AND x.pos > k.h),
p AS MATERIALIZED (SELECT conv_id, d, md5(array_to_string(list(md5(role || chr(1) || text)) OVER (PARTITION BY conv_id ORDER BY d), ',')) AS key,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM r
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS MATERIALIZED (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ended FROM p GROUP BY key, d),
m AS (SELECT n.*, q.key AS up FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1),
g AS (SELECT up, count(*) AS n_children FROM m WHERE up IS NOT NULL GROUP BY up),
u AS (SELECT q.key, count(*) FILTER (g.up IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved FROM n LEFT JOIN g ON g.up = n.key JOIN p q ON q.conv_id = n.conv_id AND q.d <= n.d GROUP BY q.key)
SELECT m.conv_id, m.d::BIGINT AS depth, a.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, coalesce(g.n_children, 0)::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves,
  u.saved::BIGINT AS saved_tokens, sha256(coalesce(m.ended, '')) AS ends_sha256
FROM m JOIN u ON u.key = m.key LEFT JOIN g ON g.up = m.key LEFT JOIN n a ON a.key = m.up"""
