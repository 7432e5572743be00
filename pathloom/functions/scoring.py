"""Completeness and integration scores as declarative field lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import has_content, has_visible_content

# Which fields count towards a score, and how they are named.
EVENT_FREE_TEXT = ("title", "short_name", "description", "doa_free_text", "measurement_method", "references")
EVENT_STRUCTURED = {"taxonomy_terms": "taxonomy_terms", "life_stage_terms": "life_stage_terms", "sex_terms": "sex_terms", "ecs": "sub_events"}
KER_FREE_TEXT = ("description", "modulating_factors", "doa_free_text", "uncertainties", "response_relationship", "time_scale", "known_loops", "evidence_collection_strategy", "references")
KER_STRUCTURED = ("aop_ids", "weight_of_evidence", "empirical_support", "biological_plausibility", "quantitative_understanding", "sex_terms", "life_stage_terms", "taxonomy_terms")
KER_ALWAYS_FILLED = ("weight_of_evidence", "empirical_support", "biological_plausibility", "quantitative_understanding")
AOP_FREE_TEXT = ("title", "short_name", "abstract", "authors", "background", "overall_assessment_description", "doa_free_text", "ke_essentiality", "woe_evidence", "quantitative_considerations", "potential_applications", "references")
AOP_CONDITIONAL = ("development_strategy", "known_modulating_factors")
AOP_STRUCTURED = ("point_of_contact", "stressors", "sex_applicability", "life_stage_applicability", "taxonomy_applicability")
AOP_LEAST = {"event_ids": 3, "kers": 2}
NEW_HANDBOOK = 2.5


@dataclass(frozen=True)
class Check:
    """A field that counts one point when ``filled``; listed under ``name`` when not; ``counts``: whether it can be scored."""

    name: str
    filled: Column
    counts: Column | None = None
    listed: Column | None = None


def _score(free: list[Check], structured: list[Check]) -> Column:
    """percent, raw_score, max_score and the names of empty fields, in order."""
    yes = F.lit(True)
    point = lambda c: F.when((yes if c.counts is None else c.counts) & c.filled, 1).otherwise(0)
    possible = lambda c: F.when(yes if c.counts is None else c.counts, 1).otherwise(0)
    total = sum((point(c) for c in [*free, *structured]), F.lit(0))
    most = sum((possible(c) for c in [*free, *structured]), F.lit(0))
    empty = lambda checks: F.array_compact(F.array(*[F.when(~c.filled & (yes if c.listed is None else c.listed), F.lit(c.name)) for c in checks]))
    return F.struct(
        F.coalesce(F.round(100 * total / F.nullif(most, F.lit(0)), 2), F.lit(0.0)).alias("percent"), total.alias("raw_score"), most.alias("max_score"),
        empty(free).alias("empty_free_text"), empty(structured).alias("empty_structured"),
    )


def _filled(df: DataFrame, name: str) -> Column:
    """Whether a field has content; a field that the table lacks is empty."""
    if name not in df.columns:
        return F.lit(False)
    kind = df.schema[name].dataType.typeName()
    return has_content(F.col(f"`{name}`"), kind)


def _visible(df: DataFrame, name: str) -> Column:
    if name in df.columns and df.schema[name].dataType.typeName() == "string":
        return has_visible_content(F.col(f"`{name}`"))
    return _filled(df, name)


def event_completion(df: DataFrame) -> Column:
    """Six free texts, the level, organ or cell where the level asks for it, four structured fields."""
    level = F.coalesce(F.trim("level_of_biological_organization"), F.lit(""))
    tissue, cell = level == "Tissue", level.isin("Cellular", "Molecular")
    held = lambda name: F.coalesce(F.col(name).isNotNull(), F.lit(False)) if name in df.columns else F.lit(False)
    structured = [
        Check("level_of_biological_organization", level != ""),
        Check("organ_term", held("organ_term"), tissue, tissue),
        Check("cell_term", held("cell_term"), cell, cell),
        *[Check(shown, _filled(df, name)) for name, shown in EVENT_STRUCTURED.items()],
    ]
    return _score([Check(n, _filled(df, n)) for n in EVENT_FREE_TEXT], structured)


def ker_completion(df: DataFrame) -> Column:
    """Nine free texts and eight structured fields; the four evidence blocks always exist, so they always count."""
    structured = [Check(n, F.lit(True) if n in KER_ALWAYS_FILLED else _filled(df, n)) for n in KER_STRUCTURED]
    return _score([Check(n, _filled(df, n)) for n in KER_FREE_TEXT], structured)


def aop_completion(df: DataFrame) -> Column:
    """Visible content of free texts and structured fields, least numbers of distinct events and relationships; two more texts under the new handbook."""
    new = F.coalesce(F.col("handbook_version") >= NEW_HANDBOOK, F.lit(False)) if "handbook_version" in df.columns else F.lit(False)
    free = [Check(n, _visible(df, n)) for n in AOP_FREE_TEXT] + [Check(n, _visible(df, n), new) for n in AOP_CONDITIONAL]
    distinct = lambda n: F.size(F.array_distinct(F.map_keys(n) if df.schema[n].dataType.typeName() == "map" else F.col(n)))
    least = [Check(n, F.coalesce(distinct(n) >= k, F.lit(False)) if n in df.columns else F.lit(False)) for n, k in AOP_LEAST.items()]
    return _score(free, [*[Check(n, _visible(df, n)) for n in AOP_STRUCTURED], *least])


def integration_rank(df: DataFrame, percent: Column, in_programme: Column, endorsed: Column, only_open: Column, method: Column, aop_count: Column, source: Column | None = None) -> DataFrame:
    """``df`` with the integration score, its bounded maximum and percentage, and ``has_method``."""
    has_method = has_content(method)
    bounded = F.when(F.coalesce(only_open, F.lit(False)), -4).otherwise(0)
    bounded += F.when(percent >= 80, 3).when(percent >= 50, 2).when(percent >= 25, 1).otherwise(0)
    bounded += F.when(in_programme & endorsed, 3).when(in_programme, 2).otherwise(0) + F.when(has_method, 1).otherwise(0)
    most = F.lit(7)
    if source is not None:
        bounded += F.when(source == "title_search", 2).when(source == "full_text_search", 1).otherwise(0)
        most += F.when(source.isNotNull(), 2).otherwise(0)
    return df.withColumns({
        "integration_score": bounded + F.coalesce(aop_count, F.lit(0)),
        "max_i_score_sans_aop_count": most,
        "percent_i_score_sans_aop_count": bounded / most * 100,
        "has_method": has_method,
    })


def average_percent(percent: Column) -> Column:
    """Mean to two digits; 0 over no rows."""
    return F.coalesce(F.round(F.avg(percent), 2), F.lit(0.0))


def with_tables(kers: DataFrame, tables: bool = True, flag: str = "has_any_tables") -> DataFrame:
    """Relationships with evidence tables, or those without; unknown counts as without."""
    return kers.filter(F.coalesce(F.col(flag), F.lit(False)) == F.lit(tables))


def ker_statistics(kers: DataFrame, flag: str = "has_any_tables", percent: str = "percent") -> DataFrame:
    """Relationships in all, with and without evidence tables, and the mean completeness of each lot."""
    has, score = F.coalesce(F.col(flag), F.lit(False)), F.col(percent)
    return kers.agg(
        F.count("*").alias("total_kers"), F.count_if(has).alias("kers_with_tables"), F.count_if(~has).alias("kers_without_tables"),
        average_percent(score).alias("average_percent"), average_percent(F.when(has, score)).alias("average_percent_with_tables"), average_percent(F.when(~has, score)).alias("average_percent_without_tables"),
    )
