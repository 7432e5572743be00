"""Searches as configuration: what to look for, where, and what to leave out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_case_flag
from ..operators import graph, search, term_index


@dataclass(frozen=True)
class SearchConfig:
    """One named search.  Fields: those to search, else the priority field alone."""

    name: str
    terms: list[str]
    fields: list[str] = field(default_factory=list)
    priority_field: str | None = None
    co_occurrences: list[tuple[str, str]] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=list)
    exclude_by_title_only: bool = False
    dropped_content: dict[str, list[str]] = field(default_factory=dict)
    co_occurrence_only: bool = False
    entities: tuple[str, ...] = ("events",)
    fields_of: dict[str, list[str]] = field(default_factory=dict)

    def for_kind(self, kind: str) -> SearchConfig:
        """The search with the fields named for one kind of entity, if there are any."""
        return replace(self, fields=self.fields_of[kind]) if kind in self.fields_of else self

    def searched(self) -> list[str]:
        chosen = self.fields or ([self.priority_field] if self.priority_field else [])
        if not chosen:
            raise ValueError(f"{self.name}: neither fields nor a priority field")
        return chosen



def run_search(texts: DataFrame, config: SearchConfig, index: DataFrame | None = None) -> DataFrame:
    """Entities with hits or co-occurrences, priority hits first by ``place`` within equals of id; with an index of words only texts that can hold a term are scanned."""
    scope = texts.filter(F.col("field").isin(*config.searched()))
    if index is not None:
        wanted = [split_case_flag(t)[0] for t in [*config.terms, *(t for pair in config.co_occurrences for t in pair)]]
        scope = term_index.texts_to_scan(scope, index, wanted, list(config.dropped_content))
    for name, passages in config.dropped_content.items():
        scope = search.dropping_content(scope, name, passages)
    hits = search.entity_hits(scope, config.terms, config.priority_field)
    if config.co_occurrences:
        pairs = search.co_occurrences(scope, config.co_occurrences)
        counted = pairs.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" + ", "term_a", "term_b"))), "|").alias("co_occurrences"), F.bool_or(F.col("field") == F.lit(config.priority_field or "")).alias("has_priority_co_occurrence"))
        hits = hits.join(counted, "entity_id", "right" if config.co_occurrence_only else "full_outer")
    if config.exclusions:
        hits = search.excluding(hits, texts, config.exclusions, ["title"] if config.exclude_by_title_only else config.searched())
    return hits


@dataclass(frozen=True)
class EventSearch:
    """Pathways by the titles of their events."""

    terms: list[str]
    excluded_title_terms: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    name: str = ""


REGISTRY: dict[str, SearchConfig | EventSearch] = {}


def registered(config: SearchConfig | EventSearch) -> SearchConfig | EventSearch:
    REGISTRY[config.name] = config
    return config


def events_to_aops(events: DataFrame, membership: DataFrame, aops: DataFrame, config: EventSearch) -> DataFrame:
    """Pathways with matching events: counts, without excluded titles, of given statuses."""
    found = graph.aops_containing(membership, graph.events_by_title(events, config.terms)).join(aops, "aop_id")
    found = graph.without_title_terms(found, config.excluded_title_terms)
    return found.filter(F.col("status").isin(*config.statuses)) if config.statuses else found
