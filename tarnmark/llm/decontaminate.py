"""Benchmark decontamination by a prefix-filtered join; DataFrame functions only.

A window is ``window`` consecutive words of an item (all of a shorter item). A
document contains a window if all its words stand there in order, so the
overlap asked for is the whole window and one necessary token is a prefix long
enough: of the window's word shingles the rarest in the corpus. The first pass
over the documents counts the shingles of all windows; nothing but sums leaves
it. The second looks for the prefix shingles only (one a window, and none of
windows of which some shingle occurs nowhere). The offset within the window
bounds position and length there, and the words around it verify the whole
window exactly. Items are attached to documents as sets of items, once for each
document and set.

Broadcasts are checked by rows and bytes; what is larger is joined by shuffle.

Defined results: null, empty and wordless texts have no words and no hits;
items without words have no windows; items with equal text are all reported;
rows that repeat an id are each returned, each with the hits of its own text; an
empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm.common import materialize, text_or_empty

#: ASCII letters that fold, and what separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows and bytes up to which a table is broadcast (rows take about 60 bytes beside their strings).
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(win, size, items): each distinct window, its words joined by spaces, with all item ids as sorted strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(text_or_empty()).alias("words"))
    items = items.where("size(words) > 0").withColumn("size", F.least(F.size("words"), F.lit(window)))
    starts = items.select("item_id", "size", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at"))
    return (
        starts.select("item_id", "size", F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("win"))
        .groupBy("win", "size")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )


def _hash_at(words: str, at: str | Column, width: int) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.xxhash64(F.lit(width), *[F.get(F.col(words), at + k) for k in range(width)])


def _hint(table: DataFrame, text: Column | None = None):
    """broadcast if the table is within the bounds, else nothing."""
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)) if text is not None else F.lit(0), F.lit(0))).first()
    return F.broadcast if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else (lambda df: df)


def _shingled(docs: DataFrame, width: int) -> DataFrame:
    """(id, copy, words, at, h): every shingle of the documents."""
    rows = docs.where(F.size("words") >= width).select("id", "copy", "words", F.posexplode("words").alias("at", "_"))
    return rows.where(F.col("at") <= F.size("words") - width).withColumn("h", _hash_at("words", "at", width))


def _found(docs: DataFrame, prefix: DataFrame, width: int, window: int, hint) -> DataFrame:
    """(id, copy, start, size, set_id): where documents have a window, by its prefix shingle."""
    first = F.greatest(F.lit(0), F.col("at") - (window - width))
    near = F.slice("words", first + 1, F.col("at") + window - first)
    here = _shingled(docs, width).select("id", "copy", "at", "h", first.alias("first"), near.alias("near"))
    start = F.col("at") - F.col("offset")
    within = (start >= 0) & (start - F.col("first") + F.col("size") <= F.size("near"))
    equal = F.array_join(F.slice("near", start - F.col("first") + 1, F.col("size")), " ") == F.col("win")
    return here.join(hint(prefix.where(F.col("width") == width)), "h").where(within).where(equal).select("id", "copy", start.alias("start"), "size", "set_id")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits: one row per row of docs.

    ``hits`` lists the spans of words (start, size), sorted; null without any.
    """
    windows = materialize(benchmark_windows(benchmark, window), "windows")
    sets = materialize(windows.select("items").distinct().withColumn("set_id", F.monotonically_increasing_id()), "items")
    windows = windows.join(sets, "items").select("win", "size", "set_id", F.least("size", F.lit(shingle)).alias("width"))
    parts = windows.withColumn("w", F.split("win", " ")).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("width"))))
    by_width = reduce(lambda e, k: F.when(F.col("width") == k, _hash_at("w", "offset", k)).otherwise(e), range(1, shingle + 1), F.lit(0).cast("long"))
    shingles = materialize(parts.select("win", "size", "set_id", "width", "offset", by_width.alias("h")), "shingles")
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect())  # ``shingle`` rows at most

    words = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("copy"), words_of(text_or_empty()).alias("words"))
    counted = words.select(F.col("id").alias("doc_id"), F.col("copy").alias("own"), F.size("words").cast("long").alias("n_words"))
    if widths:
        wanted = materialize(shingles.select("width", "h").distinct(), "wanted")
        hint = _hint(wanted)
        seen = [_shingled(words, k).select("h").join(hint(wanted.where(F.col("width") == k).select("h")), "h") for k in widths]
        rarity = reduce(DataFrame.unionByName, seen).groupBy("h").agg(F.count("*").alias("n"))
        rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "h")).alias("p")
        prefix = shingles.join(rarity, "h", "left").groupBy("win", "size", "set_id", "width").agg(rarest).where("p.n > 0")
        prefix = materialize(prefix.select("win", "size", "set_id", "width", "p.offset", "p.h"), "prefix")
        hint = _hint(prefix, F.col("win"))
        found = materialize(reduce(DataFrame.unionByName, [_found(words, prefix, k, window, hint) for k in widths]), "found")
        spans = found.groupBy("id", "copy").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("hits"))
        named = found.select("id", "copy", "set_id").distinct().join(_hint(sets, F.concat_ws(" ", "items"))(sets), "set_id")
        named = named.groupBy("id", "copy").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        # spans come by start: each adds what reaches beyond the end so far
        covered = F.aggregate(
            "hits",
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda s, x: F.struct(
                F.greatest(s["end"], x["start"] + x["size"]).alias("end"),
                (s["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(s["end"], x["start"]))).alias("n"),
            ),
            lambda s: s["n"],
        )
        same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["copy"] == b["copy"])
        hits = spans.join(named, same(spans, named)).select(spans["id"], spans["copy"], "hits", "items", covered.cast("long").alias("n_hit"))
        counted = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("copy")), "left")
    else:
        counted = counted.withColumns({"n_hit": F.lit(0), "hits": F.lit(None).cast("array<struct<start:int,size:int>>"), "items": F.lit(None).cast("array<string>")})
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "hits",
    )


def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: all documents against all benchmark items, windows of ten words."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("hits")


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i+1:i+k], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM bi)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i+1:i+k], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS MATERIALIZED (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
