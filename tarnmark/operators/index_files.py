"""The index of a collection as parts of one ordered text, and its cost, without a row that holds it all.

Concepts are sorted by id in ranges; each task writes the lines of its range as text,
and prefix sums over the parts' sizes say where each part begins. Any stretch of the
index is then read from the parts it touches. What the index costs is a sum of
lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmark.storage import materialize

HEAD = "# {title}\n\n"


def index_line(concept_id: Column, title: Column) -> Column:
    """The line of one concept, with its line feed."""
    label = F.coalesce(F.when(title != "", title), concept_id)
    return F.concat(F.lit("- ["), label, F.lit("](/"), concept_id, F.lit(".md)\n"))


def index_cost(concepts: DataFrame, title: str = "Index") -> DataFrame:
    """(tokens): a token for four characters of the index, one at least; a sum of lengths."""
    chars = F.coalesce(F.sum(F.length(index_line(F.col("id"), F.col("title")))), F.lit(0)) + len(HEAD.format(title=title))
    return concepts.agg(chars.alias("n")).select(F.greatest(F.lit(1), F.floor(F.col("n") / 4)).cast("long").alias("tokens"))


class IndexFiles:
    """A written index: ``lines`` (part, id, line) and ``parts`` (part, n, start, size) in bytes."""

    def __init__(self, lines: DataFrame, title: str = "Index"):
        self.lines, self.title = lines, title
        self.head = HEAD.format(title=title).encode()
        sizes = lines.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("size"))
        start = F.sum("size").over(Window.orderBy("part")) - F.col("size") + len(self.head)  # a row a part
        self.parts = materialize(sizes.withColumn("start", start).select("part", "n", "start", "size"), "index-parts")

    @classmethod
    def write(cls, concepts: DataFrame, title: str = "Index") -> "IndexFiles":
        rows = concepts.select("id", index_line(F.col("id"), F.col("title")).alias("line")).orderBy("id").withColumn("part", F.spark_partition_id())
        return cls(materialize(rows.select("part", "id", "line"), "index-lines"), title)

    @property
    def size(self) -> int:
        return (self.parts.agg(F.sum("size")).first()[0] or 0) + len(self.head)

    def entries(self) -> DataFrame:
        """(id, start, size): where the line of each concept lies in the text, in bytes; sums run within parts only."""
        before = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        own = self.lines.select("part", "id", F.octet_length("line").alias("size"))
        placed = own.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0))).join(self.parts.select("part", "start"), "part")
        return placed.select("id", (F.col("start") + F.col("within")).alias("start"), "size")

    def read(self, start: int = 0, size: int | None = None) -> bytes:
        """A stretch of the text, from the parts it touches."""
        if start < 0 or size is not None and size < 0:
            raise ValueError(f"start and size must not be negative, got {start} and {size}")
        stop = self.size if size is None else start + size
        out = [self.head[start:stop]]
        for part in self.parts.where((F.col("start") < stop) & (F.col("start") + F.col("size") > start)).orderBy("part").collect():
            text = "".join(r.line for r in self.lines.where(F.col("part") == part.part).orderBy("id").select("line").collect()).encode()
            out.append(text[max(0, start - part.start) : stop - part.start])
        return b"".join(out)
