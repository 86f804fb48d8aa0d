"""Packing of token sequences by minimum bin slack.

Documents are cut into full windows and one remainder each. The remainders are
packed: the longest one left opens a window, and a subset-sum dynamic program
over a bitset of reachable fill levels picks the multiset of remaining lengths
that fills the rest of the window closest to capacity; the counts come from
backtracking. A chosen multiset is applied as often as the counts allow, so the
program runs over the histogram of lengths (at most one class per length), never
over documents.

Only that histogram reaches the driver, and only the list of chosen multisets
(bounded by the number of lengths, whatever the number of documents) goes back.
Each piece finds its place by its rank among pieces of its length: the rank in
its task, plus the counts of the tasks before, from prefix sums.

Defined results: null and empty texts have the end id only; an empty table
gives no row; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmark.llm.common import materialize, text_or_empty, tidy, utf8
from tarnmark.llm.tokens import WordEncoder, public_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, local_rank long"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum comes closest to room from below."""
    reach, before = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        before.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    level, chosen = reach.bit_length() - 1, {}
    for length, reached in reversed(before):
        used = 0
        while not reached >> level & 1:
            level, used = level - length, used + 1
        if used:
            chosen[length] = used
    return chosen


def plan_windows(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, uses, first_sequence, first_offset) that place every piece."""
    left = {x: n for x, n in counts.items() if n}
    taken = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = best_fill(left, window - longest) if longest < window else {}
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            uses = chosen[length]
            rows.append((length, taken[length], taken[length] + uses * times, uses, sequence, offset))
            taken[length] += uses * times
            left[length] -= uses * times
            offset += uses * length
            if not left[length]:
                del left[length]
        sequence += times
    return rows


def cut_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int) -> DataFrame:
    """Pieces of at most ``window`` ids with their rank among equals of their task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = WordEncoder.of(tokenizer_path, True), TaskContext.get().partitionId()
        seen, end, size = np.zeros(window + 1, dtype=np.int64), np.array([end_id], dtype="<u4").tobytes(), 4 * window
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(at, 1024), []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(utf8(part.column(1)))):
                    ids += end
                    for start in range(0, len(ids), size):
                        piece = ids[start : start + size]
                        n = len(piece) // 4
                        rows.append((doc_id, start // 4, n, zlib.crc32(piece), len(ids) // 4, task, int(seen[n])))
                        seen[n] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in zip(*rows)], names=[x.split()[0] for x in PIECES.split(", ")]
                    )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(tidy(cut), PIECES)


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 1024, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, tokenizer_path, window, end_id), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= window rows
    places = spark.createDataFrame(
        plan_windows(histogram, window), "length long, rank_from long, rank_to long, uses long, first_sequence long, first_offset long"
    )
    ranked = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    at = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & F.col("rank").between(F.col("rank_from"), F.col("rank_to") - 1))
        .select(
            "doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens",
            (F.col("first_sequence") + (at / F.col("uses")).cast("long")).alias("sequence_id"),
            (F.col("first_offset") + (at % F.col("uses")) * ranked["length"]).alias("offset"),
        )
    )


def pack_documents(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Query op10: all documents in windows of 1024."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path or public_path("byte_bpe_50k.json"))
