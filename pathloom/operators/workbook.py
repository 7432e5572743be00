"""Curated workbook sheets as tables: harmonized events, assays, target families, chemicals.

Sheets come as DataFrames with a row number (``row_ix``), from CSV files or a workbook (``refined_sheets``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import citation_kind, citation_url, citation_year
from ..functions.evidence import target_family
from ..functions.fuzzy import best_matches
from ..sources.shared import written
from .graph import carried_headers, coverage, placed

# What marks a dropped event and the end of a sheet.
EXCLUDED = ("E", "nan")
DROPPED = "DROPPED"
SENTINEL = "N/A, NEURODEGENERATION"
NEXT_CHARS = 100
#: Fixed value: least likeness of an event's description in the assays' sheet to a harmonized title.
LEAST_LIKENESS = 0.6
# Sheets of the curated workbook, the columns kept of them (by header in lower case with underscores) and what they become.
SHEETS = {
    "harmonization": ("Suppl2_KEs AOP Harmonization", {"aop_wiki_terminologies": "header", "standardized_term_applied_for_the_aop_network": "title", "references": "references", "target_family": "target_family", "category": "category"}),
    "assays": ("Suppl6_ICE Assays", {"aeid": "aeid", "endpoint_name": "endpoint_name", "target_families_general": "target_family", "relationship_to_ke_in_aop_network": "relation", "summary_of_target_families": "listed_family"}),
    "chemicals": ("Suppl4_Compiled Compounds", {"chemical": "chemical", "casrn": "casrn", "positive/negative": "direction_of_effect", "evidence_of_seizure_from_literature": "literature_citation", "evidence_of_seizure_from_pubchem": "pubchem_evidence"}),
}
SKIPPED_ROWS, LISTED_FAMILIES = 1, 27
TITLES_TO_FIX = {"Altered Synaptic Serotinin Release": "Altered Synaptic Serotonin Release"}
#: Pathways that are meant to be one, and the event they begin with.
COMBINED_PAIRS = [("presynaptic_neuron", "Activated Presynaptic Neuron", "215", "230"), ("synaptic_serotonin", "Altered Serotonin Transporter Activity", "214", "223")]


def refined_sheet(rows: DataFrame, columns: dict[str, str], sheet: str) -> DataFrame:
    """The columns kept of a sheet under their names, texts trimmed, blank ones null; a column that isn't there is an error."""
    there = {"_".join(c.lower().split()): c for c in rows.columns}
    if missing := sorted(set(columns) - set(there)):
        raise ValueError(f"{sheet} has no column {', '.join(missing)}")
    kept = [F.nullif(F.trim(F.col(f"`{there[name]}`")), F.lit("")).alias(to) for name, to in columns.items()]
    return rows.select(F.lit(sheet).alias("sheet"), F.col("row_ix").cast("long").alias("row_ix"), *kept)


def refined_sheets(read: Callable[[str, int], DataFrame]) -> dict[str, DataFrame]:
    """The sheets harmonization, assays, chemicals and target_families of the curated workbook; ``read(sheet, rows to skip)`` gives one as a table of texts.

    Misspelt titles are put right; the standalone list of target families is the column of that
    name in the assays' sheet, its first distinct values.
    """
    found = {name: refined_sheet(read(sheet, SKIPPED_ROWS), columns, sheet) for name, (sheet, columns) in SHEETS.items()}
    title = F.coalesce(*[F.when(F.col("title") == wrong, F.lit(right)) for wrong, right in TITLES_TO_FIX.items()], F.col("title"))
    found["harmonization"] = found["harmonization"].withColumn("title", title)
    listed = found["assays"].filter("listed_family is not null").groupBy(F.col("listed_family").alias("target_family")).agg(F.min("row_ix").alias("row_ix"))
    found["target_families"] = placed(listed, [F.col("row_ix")]).filter(F.col("place") <= LISTED_FAMILIES).select("target_family", "row_ix")
    found["assays"] = found["assays"].drop("listed_family").filter("aeid is not null or endpoint_name is not null")
    return found


def harmonized_events(sheet: DataFrame, header: str = "header", title: str = "title", kept: tuple[str, ...] = ()) -> DataFrame:
    """Rows under ``AOP <number>`` headers: aop_id, event_id, event_index, title and the columns ``kept``; of a repeated event the last row; nothing from the sentinel on."""
    ends = sheet.filter(F.col(header) == SENTINEL).groupBy("sheet").agg(F.min("row_ix").alias("_end"))
    rows = sheet.join(ends, "sheet", "left").filter(F.col("_end").isNull() | (F.col("row_ix") < F.col("_end")))
    is_header = F.coalesce(F.col("cell").rlike(r"^AOP (\d+)"), F.lit(False))
    under = carried_headers(rows.select("sheet", "row_ix", F.col(header).alias("cell"), title, *kept), "sheet", ["row_ix"], is_header, "cell")
    number = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    events = under.select("sheet", "row_ix", "event_index", number(F.col("header"), r"^AOP (\d+)").alias("aop_id"), number(F.col("cell"), r"(\d+)").alias("event_id"), F.col(title).alias("title"), *kept)
    last = F.row_number().over(Window.partitionBy("sheet", "aop_id", "event_id").orderBy(F.desc("row_ix")))
    return events.withColumn("_n", last).filter("_n = 1").drop("_n")


def harmonized_titles(events: DataFrame) -> DataFrame:
    """For each event its harmonized titles (excluded and missing ones as ``DROPPED``), and whether they disagree."""
    title = F.when(F.col("title").isin(*EXCLUDED), F.lit(DROPPED)).otherwise(F.coalesce("title", F.lit(DROPPED)))
    return events.groupBy("event_id").agg(F.array_sort(F.collect_set(title)).alias("titles")).withColumn("conflict", F.size("titles") > 1)


def harmonized_aops(events: DataFrame) -> DataFrame:
    """Events with a harmonized title: neither blank nor excluded."""
    return events.filter(F.col("title").isNotNull() & (F.col("title") != "") & ~F.col("title").isin(*EXCLUDED))


def merged_titles(events: DataFrame) -> DataFrame:
    """Harmonized titles of a pathway that stand for several of its original events."""
    return events.groupBy("aop_id", "title").agg(F.count_distinct("event_id").alias("n_events")).filter("n_events > 1")


def pair_checks(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings on pairs of pathways meant to be one (``pair``, ``mie``, ``one``, ``two``): validation_type, pair, aop_id, title, row_ix.

    ``merged``: titles that stand for several events; ``no_mie``: the expected title isn't there;
    ``count_mismatch``: different numbers of distinct titles; ``extra``: events of the longer side
    whose title the other lacks, as many as it is longer, the first by row number as text.
    """
    sides = pairs.select("pair", "mie", F.inline(F.array(F.struct(F.col("one").alias("aop_id"), F.col("two").alias("other")), F.struct(F.col("two").alias("aop_id"), F.col("one").alias("other")))))
    low = F.lower(F.trim("title"))
    held = written(events.select("aop_id", "title", "row_ix").join(sides, "aop_id").withColumn("low", low), "paired-events")
    sizes = held.groupBy("pair", "aop_id", "other", "mie").agg(F.count("*").alias("n"), F.count_distinct("low").alias("titles"), F.bool_or(F.col("low") == F.lower(F.trim("mie"))).alias("has_mie"))
    facing = sizes.join(sizes.select("pair", F.col("aop_id").alias("other"), F.col("n").alias("n_other"), F.col("titles").alias("titles_other")), ["pair", "other"])
    row = lambda df, kind, title=None, at=None: df.select(F.lit(kind).alias("validation_type"), "pair", "aop_id", (F.lit(None).cast("string") if title is None else F.col(title)).alias("title"), (F.lit(None).cast("long") if at is None else F.col(at).cast("long")).alias("row_ix"))
    merged = row(held.groupBy("pair", "aop_id", "title").agg(F.count("*").alias("n")).filter("n > 1"), "merged", "title")
    no_mie = row(facing.filter("not has_mie"), "no_mie", "mie")
    mismatch = row(facing.filter("titles <> titles_other"), "count_mismatch")
    longer = held.join(facing.filter("n > n_other").select("pair", "aop_id", (F.col("n") - F.col("n_other")).alias("most")), ["pair", "aop_id"])
    there = held.select("pair", F.col("aop_id").alias("other"), "low").distinct()
    lacking = longer.join(there, ["pair", "other", "low"], "left_anti")
    first = F.row_number().over(Window.partitionBy("pair", "aop_id").orderBy(F.col("row_ix").cast("string")))
    extra = row(lacking.withColumn("place", first).filter("place <= most"), "extra", "title", "row_ix")
    return merged.unionByName(no_mie).unionByName(mismatch).unionByName(extra)


def enriched_events(events: DataFrame, known: DataFrame, aops: DataFrame) -> DataFrame:
    """Curated events of pathways that are known, with the title and level on record and whether there is a record."""
    record = known.select(F.col("ke_id").cast("string").alias("event_id"), F.col("title").alias("title_from_wiki"), F.col("level_of_biological_organization").alias("lobo"), F.lit(True).alias("found"))
    there = aops.select(F.col("aop_id").cast("string").alias("aop_id")).distinct()
    return events.join(there, "aop_id", "left_semi").join(record, "event_id", "left").withColumn("event_match", F.coalesce("found", F.lit(False))).drop("found")


def extraction_summary(enriched: DataFrame) -> DataFrame:
    """For each pathway its events, those matched and unmatched, excluded and without a title."""
    return enriched.groupBy("aop_id").agg(
        F.count("*").alias("total_events"), F.count_if("event_match").alias("matched_events"), F.count_if(~F.col("event_match")).alias("unmatched_events"),
        F.count_if(F.col("title") == EXCLUDED[0]).alias("excluded_events"), F.count_if(F.col("title") == EXCLUDED[1]).alias("nan_events"),
    )


def harmonized_summary(enriched: DataFrame) -> DataFrame:
    """For each harmonized title the events, levels, pathways, references and target families behind it; excluded titles have none."""
    told = lambda c: F.array_sort(F.collect_set(F.when(~F.col(c).isin("nan", "", "None"), F.col(c))))
    sets = {"event_ids": F.array_sort(F.collect_set("event_id")), "lobos": F.array_sort(F.collect_set(F.nullif("lobo", F.lit("")))), "aop_ids": F.array_sort(F.collect_set("aop_id")), "references": told("references"), "target_families": told("target_family")}
    rows = enriched.filter(F.col("title").isNotNull() & ~F.col("title").isin(*EXCLUDED)).groupBy(F.col("title").alias("harmonized_title"))
    return rows.agg(F.count_distinct("event_id").alias("total_events"), *[c.alias(n) for n, c in sets.items()]).withColumn("lobo_count", F.size("lobos"))


def relation_parts(text: Column) -> Column:
    """Pathway ids named in a relation text; without any, the event descriptions in it, each once."""
    named = F.regexp_extract(text, r"(?i)AOPs?[:\s]+.*", 0)
    ids = F.regexp_extract_all(F.substring(named, 1, NEXT_CHARS), F.lit(r"\b(\d+)\b"), F.lit(1))
    described = F.regexp_extract_all(F.trim(text), F.lit(r"(?i)(?:MIE|KEs?)\s+(?:the\s+)?([^,]+?)(?=\s+and\s+(?:MIE|KE)|$)"), F.lit(1))
    none = F.array().cast("array<string>")
    listed = F.coalesce(ids, none)
    return F.struct(listed.alias("aop_ids"), F.when(F.size(listed) > 0, none).otherwise(F.coalesce(F.array_distinct(F.transform(described, lambda x: F.trim(x))), none)).alias("ke_descriptions"))


def assays_by(assays: DataFrame, by: str) -> DataFrame:
    """One of the three groupings of assays (aeid, aop_ids or ke_descriptions): rows, names with repeats, distinct target families that aren't null."""
    parsed = assays.withColumn("parts", relation_parts(F.col("relation"))).withColumn("family", target_family(F.col("target_family")))
    keyed = parsed.withColumn("key", F.col("aeid").cast("string")) if by == "aeid" else parsed.withColumn("key", F.explode(f"parts.{by}"))
    return keyed.groupBy("key").agg(F.count("*").alias("n_assays"), F.array_sort(F.collect_list("endpoint_name")).alias("assays"), F.array_sort(F.collect_set("family")).alias("families"))


def aeid_conflicts(by_aeid: DataFrame) -> DataFrame:
    """Endpoints with several assays, or else with several target families."""
    kind = F.when(F.size("assays") > 1, "assays").when(F.size("families") > 1, "families")
    return by_aeid.select("key", kind.alias("several")).filter("several is not null")


def family_coverage(chemicals: DataFrame, events: DataFrame, assays: DataFrame) -> DataFrame:
    """For each target family whether it has chemicals, events and assays: all unions, intersections and gaps in one row."""
    named = lambda df: df.select(target_family(F.col("target_family")).alias("family"))
    return coverage({"chemicals": named(chemicals), "events": named(events), "assays": named(assays)}, "family")


#: Named sets over the three sources, as (in, not in) of standalone list, assays and harmonization.
FAMILY_SETS = {
    "standalone_set": ("s", ""), "assays_set": ("a", ""), "harmonization_set": ("h", ""), "all_sources_union": ("s|a|h", ""), "both_dfs_union": ("a|h", ""),
    "in_all_three": ("s&a&h", ""), "in_standalone_and_assays": ("s&a", ""), "in_standalone_and_harmonization": ("s&h", ""), "in_assays_and_harmonization": ("a&h", ""),
    "only_in_standalone": ("s", "a|h"), "only_in_assays": ("a", "s|h"), "only_in_harmonization": ("h", "s|a"),
    "standalone_not_in_assays": ("s", "a"), "standalone_not_in_harmonization": ("s", "h"), "assays_not_in_standalone": ("a", "s"), "harmonization_not_in_standalone": ("h", "s"),
}


def family_sets(standalone: DataFrame, assays: DataFrame, harmonization: DataFrame) -> DataFrame:
    """(category, family) of all sixteen named sets of normalized target families (column ``target_family`` of each source)."""
    named = lambda df: df.select(target_family(F.col("target_family")).alias("family")).filter("family is not null")
    flags = coverage({"s": named(standalone), "a": named(assays), "h": named(harmonization)}, "family")
    terms = lambda said: " ".join({"|": "or", "&": "and"}.get(c, f"in_{c}") for c in said)
    categories = [F.when(F.expr(f"({terms(into)})" + (f" and not ({terms(out)})" if out else "")), F.lit(name)) for name, (into, out) in FAMILY_SETS.items()]
    return flags.select(F.explode(F.array_compact(F.array(*categories))).alias("category"), "family")


def bridged_events(reviewed: DataFrame, families: DataFrame) -> DataFrame:
    """Events linked to assays through target families: title, event_id, source, assays and families, each once.

    ``reviewed``: target_family, ord, h_events, event, matched_event_id, human_verified, suggested_event;
    ``families``: target_family, assays.  Of several ways to an event the first counts: families in
    order, in each the workbook's events, then an accepted match, then a suggestion.
    """
    way = lambda rank, source, title, key: F.struct(F.lit(rank).alias("rank"), F.lit(source).alias("source"), title.alias("title"), key.alias("event_id"))
    none = F.lit(None).cast("string")
    listed = F.transform(F.coalesce("h_events", F.array().cast("array<string>")), lambda t: way(0, "harmonized_workbook", t, none))
    matched = F.when(F.coalesce("human_verified", F.lit(False)), way(1, "fuzzy_matched", F.col("event"), F.col("matched_event_id").cast("string")))
    suggested = way(2, "manual_suggestion", F.col("suggested_event"), none)
    ways = F.filter(F.concat(listed, F.array(matched, suggested)), lambda w: F.coalesce(w["title"], F.lit("")) != "")
    rows = reviewed.select("target_family", "ord", F.inline(ways)).join(families, "target_family")
    first = F.min(F.struct("ord", "rank", "source", "event_id"))
    return rows.groupBy("title").agg(
        first.alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("assays")))).alias("assays"), F.array_sort(F.collect_set("target_family")).alias("families")
    ).select("title", "f.event_id", "f.source", "assays", "families")


def map_target_families(families: DataFrame, events: DataFrame, assays: DataFrame) -> DataFrame:
    """Families with their events and assays, matched case aside."""
    low = lambda df, c: df.withColumn("_k", F.lower(target_family(F.col(c))))
    e = low(events, "target_family").groupBy("_k").agg(F.array_sort(F.collect_set("title")).alias("h_events"))
    a = low(assays, "target_family").groupBy("_k").agg(F.array_sort(F.collect_list(F.col("aeid").cast("string"))).alias("assays"))
    return low(families, "target_family").join(e, "_k", "left").join(a, "_k", "left").drop("_k")


def normalized_chemicals(chemicals: DataFrame) -> DataFrame:
    """One row for each CASRN (the last one): the direction as it is and whether it is an expected one, evidence as Yes, No or Unknown, the cited source taken apart."""
    last = F.row_number().over(Window.partitionBy("casrn").orderBy(F.desc("row_ix")))
    seen = F.upper(F.trim("pubchem_evidence"))
    raw = F.trim("literature_citation")
    rows = chemicals.withColumn("_n", last).filter("_n = 1").drop("_n")
    return rows.select(
        "casrn", *(["chemical"] if "chemical" in rows.columns else []), "direction_of_effect", F.coalesce(F.lower("direction_of_effect").isin("positive", "negative"), F.lit(False)).alias("expected_direction"),
        F.when(F.contains(seen, F.lit("Y")), "Yes").when(seen.isin("N", "NO"), "No").otherwise("Unknown").alias("pubchem_evidence"),
        F.when(raw.isNotNull(), F.struct(raw.alias("raw"), citation_kind(raw).alias("kind"), citation_year(raw).alias("year"), citation_url(raw).alias("url"))).alias("citation"),
    )


#: Tables exported from the curated workbook by group, each with its field set.
EXPORTS = {
    "events": {"curated_events": "curated_event", "harmonized_summary": "harmonized_summary", "event_to_harmonized": "event_to_harmonized", "aop_to_harmonized": "aop_to_harmonized"},
    "assays": {"assays_by_aeid": "assays_by_aeid", "assays_by_aop": "aop_id_mapping", "assays_by_ke_description": "ke_description_mapping", "ke_description_to_harmonized": "ke_description_to_harmonized"},
    "target_families": {"target_family_sets": "target_families_summary", "tf_to_events_assays": "tf_to_events_assays"},
    "chemicals": {"chemicals": "chemicals_by_casrn"},
}


def export_tables(enriched: DataFrame, assays: DataFrame, family_sets_: DataFrame, mapped: DataFrame, chemicals: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``EXPORTS`` by name, with the columns their field sets read."""
    by = lambda kind, name: assays_by(assays, kind).select(F.col("key").alias(name), "assays", F.col("families").alias("target_families"))
    curated = enriched.withColumnsRenamed({"row_ix": "row_index", "title": "harmonized_event"})
    described = by("ke_descriptions", "ke_description")
    titles = enriched.filter(F.col("title").isNotNull() & ~F.col("title").isin(*EXCLUDED)).groupBy("title").agg(F.min("row_ix").alias("ord"))
    return {
        "curated_events": curated, "harmonized_summary": harmonized_summary(enriched), "event_to_harmonized": curated.select("event_id", "harmonized_event").distinct(),
        "aop_to_harmonized": curated.select("aop_id", "row_index", "harmonized_event", F.col("event_id").alias("original_event_id")),
        "assays_by_aeid": by("aeid", "aeid"), "assays_by_aop": by("aop_ids", "aop_id"), "assays_by_ke_description": described,
        "ke_description_to_harmonized": best_matches(described, titles, LEAST_LIKENESS, "ke_description").withColumnRenamed("ke_description", "input_term"),
        "target_family_sets": family_sets_.groupBy("category").agg(F.array_sort(F.collect_set("family")).alias("target_families")), "tf_to_events_assays": mapped, "chemicals": chemicals,
    }
