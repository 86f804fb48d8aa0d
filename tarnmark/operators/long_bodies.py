"""Links of bodies too long for one task: pieces of lines, read apart.

Whether a line of a piece is code depends on all lines before it. A piece is
therefore a map of three states (no code, code by either mark) to three; the
maps are a few bytes each and are composed along a body, after which every piece
knows its own state and is read alone. A text itself is moved once, when its
pieces are dealt to the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnmark.functions import link_text
from tarnmark.storage import discard, materialize

#: The states between lines: no code, or the mark of the code that is open.
STATES = ("", "```", "~~~")


def links_by_pieces(bodies: DataFrame, piece_chars: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(occurrences, invalid) of bodies (id, body): rows as ``occurrences`` gives them, and (id, reason) of bodies with links out of the collection.

    Bodies are cut after lines, once a piece has ``piece_chars`` characters; a line
    is never cut. Null and empty bodies have no links; rows that repeat an id are
    read each; other columns are ignored. Both tables are written ones.
    """
    if piece_chars < 1:
        raise ValueError(f"piece_chars is {piece_chars}, but a piece has one character at least")
    cut = F.posexplode(link_text.pieces(F.col("body"), piece_chars)).alias("piece", "text")
    cut = bodies.select("id", F.monotonically_increasing_id().alias("row"), "body").select("id", "row", cut)
    dealt = materialize(cut.repartition("row", "piece"), "pieces")
    before = _states_before(dealt)
    start = F.when(F.col("state") != "", F.concat("state", F.lit("\n"))).otherwise(F.lit(""))
    text = dealt.join(before, ["row", "piece"]).select("id", "row", "piece", F.concat(start, "text").alias("text"))
    found = materialize(text.select("id", "row", "piece", link_text.links(F.col("text"), F.col("id")).alias("found")).where("size(found) > 0"), "piece-links")
    discard(dealt)
    ahead = Window.partitionBy("row").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    places = found.select("row", "piece", F.coalesce(F.sum(F.size("found")).over(ahead), F.lit(0)).cast("int").alias("ahead"))
    reason = link_text.escape_reason(F.col("found"))
    first = found.select("id", "row", "piece", reason.alias("reason")).where("reason is not null").groupBy("row").agg(F.min(F.struct("piece", "id", "reason")).alias("x"))
    invalid = materialize(first.select("row", "x.id", "x.reason"), "escapes")
    links = found.join(invalid.select("row"), "row", "left_anti").join(places, ["row", "piece"])
    links = links.select(F.col("id").alias("source_id"), "ahead", F.posexplode("found").alias("pos", "link"))
    links = materialize(links.select("source_id", (F.col("ahead") + F.col("pos")).alias("edge_pos"), "link.target_id", "link.anchor_text", "link.link_kind"), "occurrences")
    discard(found)
    return links, invalid.drop("row")


def _states_before(pieces: DataFrame) -> DataFrame:
    """(row, piece, state): the state before each piece, by the maps of all pieces before it.

    A text of Spark has 2 GiB at most, so a body has some 2,000 pieces of the
    default size, and the window holds three short words of each.
    """
    marks = pieces.select("row", "piece", link_text.fence_marks(F.col("text")).alias("marks"))
    maps = marks.select("row", "piece", F.create_map(*[x for s in STATES for x in (F.lit(s), link_text.fence_state(F.lit(s), F.col("marks")))]).alias("map"))
    ahead = Window.partitionBy("row").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    state = F.aggregate(F.col("maps"), F.lit(""), lambda at, m: F.element_at(m, at))
    return maps.select("row", "piece", F.collect_list("map").over(ahead).alias("maps")).select("row", "piece", state.alias("state"))
