"""Plain-text views of concepts and links, as tables and as callables for agents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmark.errors import ConceptNotFound
from tarnmark.functions.text import snippet, strip

MAX_RESULTS = 25


def _label(title: Column, concept_id: Column) -> Column:
    return F.coalesce(F.when(title != "", title), concept_id)


def concept_texts(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, text): metadata, related ids and body of each concept."""
    names = lambda resolved: F.array_join(F.array_sort(F.collect_set(F.when(F.col("resolved") == resolved, F.col("target_id")))), ", ")
    related = edges.groupBy("source_id").agg(names(True).alias("good"), names(False).alias("broken"))
    c = concepts.join(related, F.col("id") == F.col("source_id"), "left")
    some = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    listed = lambda x: F.coalesce(F.when(F.col(x) != "", F.col(x)), F.lit("none"))
    text = F.concat_ws(
        "\n",  # null lines vanish
        F.concat(F.lit("# "), _label(F.col("title"), F.col("id"))), F.lit(""), some("ID", F.col("id")), some("Type", F.col("type")),
        some("Description", F.col("description")), some("Resource", F.col("resource")),
        F.when(F.size("tags") > 0, some("Tags", F.array_join("tags", ", "))), some("Timestamp", F.col("ts_iso")),
        some("Related (resolved)", listed("good")), some("Related (unresolved)", listed("broken")),
        F.lit(""), F.lit("---"), F.lit(""), strip(F.col("body")),
    )
    return c.select("id", text.alias("text"))


def link_texts(concepts: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """(id, text): what each concept links to and is linked from, each neighbour once, first occurrence first."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction must be 'out', 'in' or 'both', got {direction!r}")
    titles = concepts.select(F.col("id").alias("other"), "title")
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("edge_pos"))
    out = edges.withColumn("r", first("source_id", "target_id")).where("r = 1").select(
        F.col("source_id").alias("id"), F.lit(0).alias("side"), F.lit("").alias("k"), F.col("edge_pos").alias("p"), F.col("target_id").alias("other"), "resolved"
    )
    back = edges.where("resolved").withColumn("r", first("target_id", "source_id")).where("r = 1").select(
        F.col("target_id").alias("id"), F.lit(1).alias("side"), F.col("source_id").alias("k"), F.col("edge_pos").alias("p"), F.col("source_id").alias("other"), "resolved"
    )
    rows = {"out": out, "in": back, "both": out.unionByName(back)}[direction].join(titles, "other", "left")
    line = F.concat(
        F.when(F.col("side") == 0, "-> ").otherwise("<- "), F.col("other"), F.lit(" - "), _label(F.col("title"), F.col("other")),
        F.when(F.col("resolved"), "").otherwise(" (unresolved)"),
    )
    grouped = rows.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("side", "k", "p", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    told = F.concat(F.lit("Links for "), F.col("id"), F.lit(f" (direction: {direction}):\n"), F.col("lines"))
    none = F.concat(F.lit("No links found for "), F.col("id"), F.lit(f" (direction: {direction})."))
    return concepts.select("id").join(grouped, "id", "left").select("id", F.coalesce(told, none).alias("text"))


def result_texts(hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query_id, text): ranked lines for hits (query_id, rank, id), each with a snippet."""
    c = hits.join(concepts.select("id", "title", "type", "description", "body"), "id")
    about = snippet(F.coalesce(F.when(F.col("description") != "", F.col("description")), F.col("body")))
    line = F.concat_ws(
        "\n",
        F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("id"), F.lit(" - "), _label(F.col("title"), F.col("id")), F.lit(" (type: "), F.col("type"), F.lit(")")),
        F.when(about != "", F.concat(F.lit("   "), about)),
    )
    return c.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


@dataclass(frozen=True)
class Tool:
    """A named function with a JSON schema; wrong input gives a line that begins with ``Error:``."""

    name: str
    description: str
    function: Callable[..., str]
    schema: dict = field(default_factory=dict)

    def invoke(self, arguments: dict | None = None) -> str:
        given = dict(arguments or {})
        for name, rule in self.schema.items():
            if name not in given:
                if "default" not in rule:
                    return f"Error: invalid tool input at {name}: Field required"
                given[name] = rule["default"]
            value = given[name]
            if not isinstance(value, rule["type"]) or isinstance(value, bool):
                return f"Error: invalid tool input at {name}: Input should be a valid {'integer' if rule['type'] is int else 'string'}"
            if "enum" in rule and value not in rule["enum"]:
                return f"Error: invalid tool input at {name}: Input should be one of {', '.join(rule['enum'])}"
            if "minimum" in rule and value < rule["minimum"]:
                return f"Error: invalid tool input at {name}: Input should be greater than or equal to {rule['minimum']}"
            if "maximum" in rule and value > rule["maximum"]:
                return f"Error: invalid tool input at {name}: Input should be less than or equal to {rule['maximum']}"
        try:
            return self.function(**{k: given[k] for k in self.schema})
        except (ConceptNotFound, ValueError) as e:
            return f"Error: {e}"


def create_tools(bundle) -> list[Tool]:
    """read_concept, search_concepts, list_links and read_index over a loaded bundle."""
    from tarnmark.plans.bundle import Bundle

    if not isinstance(bundle, Bundle):
        raise TypeError(f"bundle must be a Bundle, got {type(bundle).__name__!r}")

    def one(table: DataFrame, concept_id: str) -> str:
        bundle._known(concept_id)
        return table.where(F.col("id") == concept_id).first().text

    def read_concept(concept_id: str) -> str:
        own = F.col("id") == concept_id
        return one(concept_texts(bundle.concepts.where(own), bundle.edges.where(F.col("source_id") == concept_id)), concept_id)

    def search_concepts(query: str, top_k: int) -> str:
        hits = bundle.search(query, top_k).withColumn("query_id", F.lit(0))
        row = result_texts(hits, bundle.concepts).first()
        return row.text if row else f"No concepts matched the query {query!r}."

    def list_links(concept_id: str, direction: str) -> str:
        near = bundle.edges.where((F.col("source_id") == concept_id) | (F.col("target_id") == concept_id))
        return one(link_texts(bundle.concepts, near, direction), concept_id)

    def read_index() -> str:
        return bundle.index().first().body

    concept_id = {"concept_id": {"type": str}}
    return [
        Tool("read_concept", "Metadata, related ids and text of one concept.", read_concept, concept_id),
        Tool(
            "search_concepts", "A numbered list of the concepts that match a text best.", search_concepts,
            {"query": {"type": str}, "top_k": {"type": int, "default": 5, "minimum": 1, "maximum": MAX_RESULTS}},
        ),
        Tool(
            "list_links", "What a concept links to and is linked from; broken links are marked.", list_links,
            concept_id | {"direction": {"type": str, "default": "both", "enum": ("out", "in", "both")}},
        ),
        Tool("read_index", "The overview of the bundle, with links to its concepts.", read_index),
    ]
