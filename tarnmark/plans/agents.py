"""Retrievers, a router and a navigator that hold a loaded bundle and their settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tarnmark.operators import navigation, routing, search, vectors
from tarnmark.plans.bundle import Bundle

DIRECTIONS = ("out", "in", "both")


def require_bundle(bundle) -> Bundle:
    if not isinstance(bundle, Bundle):
        raise TypeError(f"expected a loaded Bundle, not {type(bundle).__name__}")
    return bundle


def _at_least(name: str, value: int, least: int) -> int:
    if value < least:
        raise ValueError(f"{name} must be at least {least}, got {value}")
    return value


class LexicalRetriever:
    """Documents of the concepts that match each query best; a call may set its own ``top_k``."""

    def __init__(self, bundle: Bundle, top_k: int = 5):
        self.bundle, self.top_k = require_bundle(bundle), _at_least("top_k", top_k, 1)

    def retrieve(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """queries (query_id, query) to (query_id, rank, concept_id, page_content, metadata)."""
        k = self.top_k if top_k is None else top_k
        return search.documents_of_hits(self.bundle.search_many(queries, k), self.bundle.concepts, self.bundle.root)


class GraphRetriever:
    """What a store finds, and what its links reach.

    ``store(queries, k)`` gives hits (query_id, hit_rank, concept_id,
    bundle_root), k of each query at most. A call's own ``top_k`` bounds the
    hits that are asked for, not the documents that links add.
    """

    def __init__(self, bundle: Bundle, store: Callable[[DataFrame, int], DataFrame], top_k: int = 5, expand_hops: int = 1, direction: str = "out"):
        if not callable(store):
            raise TypeError(f"store must be callable, not {type(store).__name__}")
        if direction not in DIRECTIONS:
            raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}, got {direction!r}")
        self.bundle, self.store, self.direction = require_bundle(bundle), store, direction
        self.top_k, self.expand_hops = _at_least("top_k", top_k, 1), _at_least("expand_hops", expand_hops, 0)

    def retrieve(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """queries to (query_id, rank, concept_id, distance, page_content, metadata)."""
        hits = self.store(queries, self.top_k if top_k is None else _at_least("top_k", top_k, 1))
        own = self.bundle
        return vectors.graph_retrieve(hits, own.concepts, own.edges, own.root, expand_hops=self.expand_hops, direction=self.direction)


class Router:
    """Routes queries to the bundle, a store or both."""

    def __init__(self, bundle: Bundle, *, has_store: bool = False, classifier: Callable[[str], str] | None = None):
        if classifier is not None and not callable(classifier):
            raise TypeError(f"classifier must be callable, not {type(classifier).__name__}")
        self.bundle, self.has_store, self.classifier = require_bundle(bundle), has_store, classifier

    def route(self, queries: DataFrame) -> DataFrame:
        return routing.route(queries, self.bundle.concepts, has_store=self.has_store, classifier=self.classifier)


class Navigator:
    """Answers questions by reading along links within bounds; they are checked before any question is asked."""

    def __init__(self, bundle: Bundle, model: Callable, *, token_estimator: Callable[[str], int] | None = None, strategy: str = "progressive", **limits: int):
        if not callable(model):
            raise TypeError(f"model must be callable, not {type(model).__name__}")
        self.bundle, self.model = require_bundle(bundle), model
        self.settings = {"max_hops": 3, "max_concepts": 10, "token_budget": 8000} | limits
        self.index_body = bundle.index().first().body
        navigation.check_bounds(navigation._index_cost(self.index_body, token_estimator), strategy=strategy, **self.settings)
        self.settings |= {"strategy": strategy, "token_estimator": token_estimator}

    def ask(self, questions: DataFrame) -> DataFrame:
        """questions (question_id, question) to their final states."""
        return navigation.navigate(questions, self.bundle.concepts, self.bundle.edges, self.index_body, self.model, **self.settings)
