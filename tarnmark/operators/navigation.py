"""Budget-bounded reading along links, for many questions at once.

State is a table with one row for each question. A round finds candidates by
joins, reads a prefix of them by window sums, and writes the new state; a model
is asked by a Python function over the rows that are still active, and its
answers are written before anything depends on them, so that a plan evaluated
twice cannot ask twice. (A task that is retried after a failure asks again.)
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from tarnmark.functions.payload import read_answer, read_decision, read_plan, response_text
from tarnmark.functions.text import strip, token_estimate
from tarnmark.storage import materialize

STRATEGIES = ("progressive", "exhaustive")
#: Fixed value: links that one progressive round follows.
PICKS = 2
STATE = (
    "question_id string, question string, visited array<string>, context array<string>, tokens_used long, hops int, answer string, "
    "citations array<string>, traversal_path array<string>, degraded boolean, degraded_steps array<string>, step string"
)


def entry_text(concept_id, body):
    return F.concat(F.lit("## Concept: "), concept_id, F.lit("\n\n"), body)


def estimated(text, token_estimator: Callable[[str], int] | None = None):
    """Tokens of a text column: four characters each, or what token_estimator says."""
    if token_estimator is None:
        return token_estimate(text)
    return F.udf(lambda t: None if t is None else int(token_estimator(t)), "long", useArrow=True)(text)


def index_token_cost(index: DataFrame, token_estimator: Callable[[str], int] | None = None) -> int:
    return index.select(estimated(F.col("body"), token_estimator).alias("n")).first().n


def _index_cost(body: str, token_estimator: Callable[[str], int] | None) -> int:
    return token_estimator(body) if token_estimator else max(1, len(body) // 4)


def candidates(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(question_id, candidates): unread targets of resolved links, in reading, then document order."""
    read = state.select("question_id", "visited", F.posexplode("visited").alias("path_pos", "source_id"))
    ahead = read.join(edges.where("resolved"), "source_id").where(~F.array_contains("visited", F.col("target_id")))
    first = ahead.groupBy("question_id", "target_id").agg(F.min(F.struct("path_pos", "edge_pos")).alias("at"))
    return first.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("at", "target_id"))).alias("c")).select(
        "question_id", F.col("c.target_id").alias("candidates")
    )


def read_round(state: DataFrame, chosen: DataFrame, concepts: DataFrame, *, max_concepts: int, token_budget: int, token_estimator: Callable[[str], int] | None = None) -> DataFrame:
    """State after reading a prefix of what is chosen (question_id, chosen), with ``blocked``.

    Reading stops at ``max_concepts``; the first entry that would exceed the
    budget blocks the question. Costs are never negative, so both are prefixes.
    """
    wanted = chosen.select("question_id", F.posexplode("chosen").alias("pos", "id"))
    entry = entry_text(F.col("id"), F.col("body"))
    costs = concepts.join(wanted.select("id").distinct(), "id", "left_semi").select("id", estimated(entry, token_estimator).cast("long").alias("cost"))
    so_far = Window.partitionBy("question_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = wanted.join(costs, "id").withColumn("n", F.count("*").over(so_far)).withColumn("sum", F.sum("cost").over(so_far))
    own = state.select("question_id", F.size("visited").alias("had"), F.col("tokens_used").alias("used"))
    within = placed.join(own, "question_id").where(F.col("n") + F.col("had") <= max_concepts)
    within = within.withColumn("fits", F.col("used") + F.col("sum") <= token_budget)
    # bodies are fetched for what is read only
    read = within.where("fits").join(concepts.select("id", entry.alias("entry")), "id")
    blocked = within.groupBy("question_id").agg(F.max(~F.col("fits")).alias("blocked"))
    got = read.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "entry", "cost"))).alias("got"))
    got = blocked.join(got, "question_id", "left")
    joined = state.join(got, "question_id", "left")
    ids = F.coalesce("got.id", F.array().cast("array<string>"))
    more = F.coalesce(F.aggregate("got.cost", F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))
    return joined.select(
        "question_id", "question", F.concat("visited", ids).alias("visited"),
        F.concat("context", F.coalesce("got.entry", F.array().cast("array<string>"))).alias("context"),
        (F.col("tokens_used") + more).alias("tokens_used"), (F.col("hops") + 1).cast("int").alias("hops"), "answer", "citations",
        F.concat("traversal_path", ids).alias("traversal_path"), "degraded", "degraded_steps", "step",
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
    )


def _next(state: DataFrame, edges: DataFrame, *, max_hops: int, max_concepts: int, token_budget: int) -> DataFrame:
    """After a round: go on while budgets last and links lead to something new."""
    ahead = candidates(state, edges).select("question_id", F.lit(True).alias("more"))
    on = ~F.col("blocked") & (F.col("hops") < max_hops) & (F.size("visited") < max_concepts) & (F.col("tokens_used") < token_budget)
    joined = state.join(ahead, "question_id", "left")
    return joined.withColumn("step", F.when(on & F.col("more").isNotNull(), "loop").otherwise("generate")).drop("more", "blocked")


def start(questions: DataFrame, index_body: str, index_tokens: int, can_read: bool) -> DataFrame:
    """State before the first round: only the index is read."""
    none = F.array().cast("array<string>")
    return questions.select(
        F.col("question_id").cast("string").alias("question_id"), "question", none.alias("visited"), F.array(F.lit(index_body)).alias("context"),
        F.lit(index_tokens).cast("long").alias("tokens_used"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("answer"),
        none.alias("citations"), F.array(F.lit("index")).alias("traversal_path"), F.lit(False).alias("degraded"), none.alias("degraded_steps"),
        F.lit("plan" if can_read else "generate").alias("step"),
    )


def _ask(rows: DataFrame, model: Callable, messages: Callable, columns: list[str]) -> DataFrame:
    """(question_id, reply): the model's answer to each row, asked once and written."""

    def run(frames):
        for frame in frames:
            replies = [response_text(model(messages(*[row[c] for c in columns]))) for _, row in frame.iterrows()]
            yield pd.DataFrame({"question_id": frame["question_id"], "reply": replies})

    return materialize(rows.select("question_id", *columns).mapInPandas(run, "question_id string, reply string"), "replies")


#: What each step asks for; replies are one JSON object with the keys named here (fixed values).
ASKED = {
    "plan": 'You see a question and the contents page of a collection of notes. Pick the notes worth opening, the most useful first. Reply with nothing but an object {"concept_ids": [...]} that holds their ids, spelled as on the page.',
    "decide": 'You see a question, the notes opened so far, and the ids they link to. Reply with nothing but an object: {"sufficient": true} once the notes settle the question, else {"sufficient": false, "next_concept_ids": [...]} with the linked ids to open next.',
    "generate": 'You see a question and the notes opened for it. Reply with nothing but an object {"answer": "...", "citations": [...]}: an answer that rests on these notes alone and admits what they leave open, and the ids of the notes it rests on.',
}


def _sheet(step: str, **parts: str) -> list[tuple[str, str]]:
    """Messages of a step: what is asked for, and the parts under their names."""
    return [("system", ASKED[step]), ("human", "\n\n".join(f"[{name}]\n{text}" for name, text in parts.items()))]


def plan_messages(question: str, context) -> list[tuple[str, str]]:
    return _sheet("plan", contents=context[0], question=question)


def decide_messages(question: str, context, candidates) -> list[tuple[str, str]]:
    return _sheet("decide", notes="\n\n".join(context), linked=json.dumps(list(candidates)), question=question)


def generate_messages(question: str, context, visited) -> list[tuple[str, str]]:
    return _sheet("generate", notes="\n\n".join(context), opened=json.dumps(list(visited)), question=question)


_NAMES = ArrayType(StringType())
_DECIDED = StructType([StructField("enough", BooleanType()), StructField("ids", _NAMES)])
_ANSWERED = StructType([StructField("answer", StringType()), StructField("citations", _NAMES)])


def _read(reader: Callable, kind):
    """A model's replies, a batch at a time, as columns of a type."""
    return F.udf(reader, kind, useArrow=True)


def _known(ids, known: DataFrame, rows: DataFrame) -> DataFrame:
    """(question_id, chosen): of an array column of ids, those known, first of repeats, in order."""
    each = rows.select("question_id", F.posexplode(F.array_distinct(ids)).alias("pos", "id"))
    kept = each.join(known.select("id"), "id", "left_semi").groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("k"))
    return kept.select("question_id", F.col("k.id").alias("chosen"))


def check_bounds(index_tokens: int, max_hops: int, max_concepts: int, token_budget: int, strategy: str) -> None:
    for name, value, least in (("max_hops", max_hops, 0), ("max_concepts", max_concepts, 0), ("token_budget", token_budget, 1)):
        if value < least:
            raise ValueError(f"{name} is {value}, but the least that makes sense is {least}")
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    if index_tokens > token_budget:
        raise ValueError(f"token_budget is {token_budget}, but reading the index alone costs {index_tokens}")


def explore(starts: DataFrame, concepts: DataFrame, edges: DataFrame, index_body: str, *, max_hops: int = 3, max_concepts: int = 10, token_budget: int = 8000, token_estimator: Callable[[str], int] | None = None) -> DataFrame:
    """Exhaustive reading without a model: starts (question_id, question, chosen) are read, then all links, round by round."""
    bounds = {"max_hops": max_hops, "max_concepts": max_concepts, "token_budget": token_budget}
    spark = starts.sparkSession
    index_tokens = _index_cost(index_body, token_estimator)
    check_bounds(index_tokens, strategy="exhaustive", **bounds)
    can_read = max_hops >= 1 and max_concepts >= 1 and index_tokens < token_budget
    state = start(starts, index_body, index_tokens, can_read)
    if not can_read:
        return state.drop("step")
    limits = {"max_concepts": max_concepts, "token_budget": token_budget, "token_estimator": token_estimator}
    chosen = _known(F.col("chosen"), concepts, starts.select(F.col("question_id").cast("string").alias("question_id"), "chosen"))
    state = materialize(_next(read_round(state, chosen, concepts, **limits), edges, **bounds), "state")
    done = spark.createDataFrame([], state.schema)
    for _ in range(1, max_hops):
        active = state.where("step = 'loop'")
        if active.isEmpty():
            break
        done = done.unionByName(state.where("step <> 'loop'"))
        ahead = candidates(active, edges).withColumnRenamed("candidates", "chosen")
        state = materialize(_next(read_round(active, ahead, concepts, **limits), edges, **bounds), "state")
    return done.unionByName(state).drop("step")


def navigate(
    questions: DataFrame, concepts: DataFrame, edges: DataFrame, index_body: str, model: Callable, *,
    max_hops: int = 3, max_concepts: int = 10, token_budget: int = 8000, strategy: str = "progressive",
    token_estimator: Callable[[str], int] | None = None,
) -> DataFrame:
    """Final state of each question (question_id, question).

    The model plans what to read, decides after each round whether that suffices
    (``progressive``) or all links are read (``exhaustive``), and answers; it gets
    a list of (role, text). Citations are kept if they were read. Answers that
    break the format degrade the step, which then reads nothing more. Texts cost
    what ``token_estimator`` says, by default a token for four characters.
    """
    bounds = {"max_hops": max_hops, "max_concepts": max_concepts, "token_budget": token_budget}
    limits = {"max_concepts": max_concepts, "token_budget": token_budget, "token_estimator": token_estimator}
    index_tokens = _index_cost(index_body, token_estimator)
    check_bounds(index_tokens, strategy=strategy, **bounds)
    if not questions.where(F.col("question").isNull() | (strip(F.col("question")) == "")).isEmpty():
        raise ValueError("question must be a non-empty string")
    can_read = max_hops >= 1 and max_concepts >= 1 and index_tokens < token_budget and not concepts.isEmpty()
    state = materialize(start(questions, index_body, index_tokens, can_read), "state")
    done = state.where("step = 'generate'")
    if can_read:
        replies = _ask(state, model, plan_messages, ["question", "context"]).withColumn("ids", _read(read_plan, _NAMES)("reply"))
        chosen = _known(F.col("ids"), concepts, replies.where("ids is not null"))
        state = _degrade(state.join(replies.select("question_id", F.col("ids").isNull().alias("bad")), "question_id"), "plan")
        state = materialize(_next(read_round(state, chosen, concepts, **limits), edges, **bounds), "state")
        for _ in range(1, max_hops):
            done = done.unionByName(state.where("step <> 'loop'"))
            active = state.where("step = 'loop'").join(candidates(state, edges), "question_id")
            if active.isEmpty():
                state = state.limit(0)
                break
            if strategy == "exhaustive":
                chosen, going = active.select("question_id", F.col("candidates").alias("chosen")), active.drop("candidates")
            else:
                replies = _ask(active, model, decide_messages, ["question", "context", "candidates"]).withColumn("d", _read(read_decision, _DECIDED)("reply"))
                decided = materialize(active.join(replies, "question_id"), "decided")
                bad = _degrade(decided.withColumn("bad", F.col("d").isNull()).drop("d", "reply", "candidates"), "decide")
                over = decided.select("question_id", (F.col("d").isNull() | F.col("d.enough")).alias("over"))
                joined = bad.join(over, "question_id")
                done = done.unionByName(joined.where("over").drop("over").withColumn("step", F.lit("generate")))
                going = joined.where("not over").drop("over")
                picks = F.filter(F.array_distinct("d.ids"), lambda x: F.array_contains("candidates", x))
                picks = F.when(F.size(picks) > 0, picks).otherwise(F.col("candidates"))
                chosen = decided.where("d is not null and not d.enough").select("question_id", F.slice(picks, 1, PICKS).alias("chosen"))
            state = materialize(_next(read_round(going, chosen, concepts, **limits), edges, **bounds), "state")
        done = done.unionByName(state)
    done = materialize(done, "read")
    replies = _ask(done, model, generate_messages, ["question", "context", "visited"]).withColumn("a", _read(read_answer, _ANSWERED)("reply"))
    final = _degrade(done.join(replies, "question_id").withColumn("bad", F.col("a").isNull()), "generate")
    cited = F.filter(F.array_distinct("a.citations"), lambda c: F.array_contains("visited", c))
    return final.select(
        "question_id", "question", "visited", "context", "tokens_used", "hops", F.coalesce("a.answer", "reply").alias("answer"),
        F.coalesce(cited, F.array().cast("array<string>")).alias("citations"), "traversal_path", "degraded", "degraded_steps",
    )


def _degrade(state: DataFrame, step: str) -> DataFrame:
    """Rows with ``bad`` get the step in their list of degraded ones."""
    listed = F.when(F.col("bad"), F.concat("degraded_steps", F.array(F.lit(step)))).otherwise(F.col("degraded_steps"))
    return state.withColumn("degraded_steps", listed).withColumn("degraded", F.col("degraded") | F.col("bad")).drop("bad")


def valid_citations(answers: DataFrame) -> DataFrame:
    """answers (question_id, citations, visited) with the citations that were read, first of repeats."""
    kept = F.filter(F.array_distinct("citations"), lambda c: F.array_contains("visited", c))
    return answers.select("question_id", kept.alias("citations"))
