"""Exports: CSV and JSON through Spark's writers, Markdown reports of small results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One exported column: its name, a dotted path into the row, a transformer and a default."""

    name: str
    path: str
    transform: str = "plain"
    default: str = ""


def _joined(column: Column) -> Column:
    return F.array_join(F.filter(column, lambda x: x.isNotNull() & (x.cast("string") != "")), ", ")


def _of_each(column: Column, part: str) -> Column:
    return _joined(F.transform(column, lambda x: x[part]))


def _component(ecs: Column, part: str) -> Column:
    return _joined(F.transform(ecs, lambda e: e[part]["term"]))


def sourced_term(term: Column) -> Column:
    """``source: term`` of a struct, the term alone without a source."""
    both = F.concat_ws(": ", F.nullif(term["source"], F.lit("")), term["term"])
    return F.when(F.coalesce(term["term"], F.lit("")) != "", both)


def ordered_path(events: Column) -> Column:
    """Events (structs of event_id and title) as ``id:title`` with arrows between them."""
    return F.array_join(F.transform(events, lambda e: F.concat_ws(":", F.coalesce(e["event_id"].cast("string"), F.lit("")), F.coalesce(e["title"], F.lit("")))), " → ")


def ordered_events(paths: Column) -> Column:
    """A struct of before, branches and after: the path to the branching, the branches in brackets, what comes after them."""
    branches = F.filter(F.transform(paths["branches"], ordered_path), lambda b: b != "")
    shown = F.when(F.size(branches) > 0, F.concat(F.lit("[BRANCHES: "), F.array_join(branches, " | "), F.lit("]")))
    return F.concat_ws(" ", F.nullif(ordered_path(paths["before"]), F.lit("")), shown, F.nullif(ordered_path(paths["after"]), F.lit("")))


def entity_link(base: Column, kind: str, entity_id: Column, anchor: Column | None = None) -> Column:
    """``base/kind/id``, with ``#anchor`` where there is one."""
    link = F.concat(base, F.lit(f"/{kind}/"), entity_id.cast("string"))
    return link if anchor is None else F.concat(link, F.coalesce(F.concat(F.lit("#"), anchor), F.lit("")))


def elapsed(seconds: Column) -> Column:
    """``HH:MM:SS.sss``."""
    whole = F.floor(seconds).cast("long")
    rest = seconds - whole + whole % 60
    return F.format_string("%02d:%02d:%06.3f", F.floor(whole / 3600), F.floor(whole % 3600 / 60), rest.cast("double"))


TRANSFORMS = {
    "plain": lambda c: c.cast("string"),
    "clean": lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"(?U)\s+", " ")),
    "round_2": lambda c: F.when(c.isNotNull(), F.format_string("%.2f", c.cast("double"))),
    "yes_no": lambda c: F.when(c, "Yes").otherwise("No"),
    "list": _joined,
    "json": lambda c: F.to_json(c),
    "titles": lambda c: _of_each(c, "title"),
    "sources": lambda c: _of_each(c, "source"),
    "term": sourced_term,
    "ec_objects": lambda c: _component(c, "biological_object"),
    "ec_actions": lambda c: _component(c, "biological_action"),
    "ec_processes": lambda c: _component(c, "biological_process"),
    "path": ordered_events,
}


def _fields(*fields: tuple) -> list[Field]:
    return [Field(*f) for f in fields]


_FOUND = (("entity_id", "entity_id"), ("title", "title"), ("terms_found", "terms_found", "list"), ("matched_fields", "matched_fields", "list"), ("snippet_count", "snippet_count", "plain", "0"))
_METHOD = (("has_method", "has_method", "yes_no"), ("integration_score", "integration_score", "plain", "0"), ("aop_count", "aop_count", "plain", "0"))
_PERCENT = ("completion_percent", "completion_percent", "round_2", "0.00")
# The columns of each export, as name, path, transformer and default.
FIELD_SETS = {
    "aop_summary": _fields(("AOP ID", "id"), ("Title", "title", "clean"), ("OECD Status", "oecd_status"), ("License", "wiki_license"), ("Handbook Version", "handbook_version"), ("Completion %", "percent", "round_2"), ("Raw Score", "raw_score"), ("Max Score", "max_score"), ("Events", "num_events", "plain", "0"), ("KERs", "num_kers", "plain", "0"), ("Stressors", "num_stressors", "plain", "0"), ("Empty Free Text Fields", "empty_free_text", "list"), ("Empty Structured Fields", "empty_structured", "list")),
    "aop_detail": _fields(("aop_id", "id"), ("title", "title", "clean"), ("oecd_status", "oecd_status"), ("wiki_license", "wiki_license"), ("adverse_outcomes", "adverse_outcomes", "clean"), ("detected_as_aop_network", "detected_as_aop_network"), ("has_internal_loops", "has_internal_loops"), ("missing_mie", "missing_mie"), ("source_event_ids", "source_event_ids", "json"), ("ordered_events_path", "ordered_events", "path")),
    "event_summary": _fields(("Event ID", "ke_id"), ("Title", "title", "clean"), ("Integration Score", "integration_score", "plain", "0"), ("Completion %", "percent", "round_2"), ("AOP Count", "aop_count", "plain", "0"), ("Has Method", "has_method", "yes_no"), ("OECD Endorsed", "any_oecd_endorsed", "yes_no"), ("In OECD Program", "in_oecd_aop_program", "yes_no"), ("Only Open for Adoption", "only_open_for_adoption", "yes_no")),
    "event_detail": _fields(("ke_id", "ke_id"), ("title", "title", "clean"), ("integration_score", "integration_score", "plain", "0"), ("source", "source"), ("completion_score", "percent", "round_2"), ("any_open_for_adoption", "any_open_for_adoption"), ("any_all_rights_reserved", "any_all_rights_reserved"), ("aop_count", "aop_count", "plain", "0"), ("aops", "aops", "json"), ("fields_with_input_term", "fields_with_input_term", "list"), ("higher_priority_field", "higher_priority_field"), ("summary_oecd_statuses", "statuses", "list"), ("level_of_biological_organization", "level_of_biological_organization"), ("cell_term", "cell_term", "term"), ("organ_term", "organ_term", "term"), ("ec_objects", "ecs", "ec_objects"), ("ec_actions", "ecs", "ec_actions"), ("ec_processes", "ecs", "ec_processes"), ("description", "description", "clean")),
    "concordance_ker": _fields(("KER ID", "ker_id"), ("Upstream KE", "upstream_ke", "plain", "N/A"), ("Downstream KE", "downstream_ke", "plain", "N/A"), ("AOPs", "aops", "list"), ("Search Terms Found", "terms_found", "list"), ("Field Searched", "field"), ("Snippet", "snippet")),
    "search_results_aop": _fields(("entity_id", "entity_id"), ("title", "title"), ("snippet_count", "snippet_count", "plain", "0"), ("has_priority_term_match", "has_priority_term_match", "yes_no"), ("has_priority_co_occurrence", "has_priority_co_occurrence", "yes_no"), ("sex_applicability", "sex_applicability", "list"), ("life_stage_applicability", "life_stage_applicability", "list"), ("taxonomy_applicability", "taxonomy_applicability", "titles"), ("co_occurrences", "co_occurrences"), ("co_occurrence_fields", "co_occurrence_fields", "list"), ("terms_found", "terms_found", "list"), ("matched_fields", "matched_fields", "list")),
    "search_results_event": _fields(*_FOUND, *_METHOD, _PERCENT),
    "search_results_ker": _fields(*_FOUND, ("has_any_tables", "has_any_tables", "yes_no"), _PERCENT),
    "search_results_event_with_flags": _fields(_FOUND[0], _FOUND[1], ("Found in Event Search", "found_in_event_search", "yes_no"), ("Found Through AOPs", "found_through_aops", "yes_no"), *_FOUND[2:], *_METHOD, _PERCENT),
    "curated_event": _fields(("AOP ID", "aop_id"), ("Event Index", "event_index"), ("Row Index", "row_index"), ("Event ID", "event_id"), ("Title from Wiki", "title_from_wiki"), ("Harmonized Name", "harmonized_event"), ("Event Match", "event_match", "yes_no"), ("References", "references"), ("Target Family", "target_family")),
    "harmonized_event": _fields(("Harmonized Title", "harmonized_title"), ("AOP ID", "aop_id"), ("Event ID", "event_id"), ("Row Index", "row_index"), ("Event Index", "event_index"), ("Title from Wiki", "title_from_wiki"), ("LOBO", "lobo"), ("Event Match", "event_match", "yes_no"), ("References", "references"), ("Target Family", "target_family")),
    "harmonized_summary": _fields(("Harmonized Title", "harmonized_title"), ("Total Events", "total_events", "plain", "0"), ("LOBO Count", "lobo_count", "plain", "0"), ("LOBOs", "lobos", "list"), ("Event IDs", "event_ids", "list"), ("AOP IDs", "aop_ids", "list"), ("References", "references", "list"), ("Target Families", "target_families", "list")),
    "target_families_summary": _fields(("Category", "category"), ("Target Families", "target_families", "list")),
    "tf_to_events_assays": _fields(("Target Family", "target_family"), ("Harmonized Events", "h_events", "list"), ("Assays", "assays", "list")),
    "aop_id_mapping": _fields(("AOP ID", "aop_id"), ("Assays", "assays", "list"), ("Target Families", "target_families", "list")),
    "ke_description_mapping": _fields(("KE Description", "ke_description"), ("Assays", "assays", "list"), ("Target Families", "target_families", "list")),
    "ke_description_to_harmonized": _fields(("KE Description", "input_term"), ("Harmonized KE Match", "matched_term"), ("Match Score", "match_score")),
    "event_to_harmonized": _fields(("Event ID", "event_id"), ("Harmonized Event", "harmonized_event")),
    "aop_to_harmonized": _fields(("AOP ID", "aop_id"), ("Row Index", "row_index"), ("Harmonized Event", "harmonized_event"), ("Original Event ID", "original_event_id")),
    "assays_by_aeid": _fields(("AEID", "aeid"), ("Assays", "assays", "list"), ("Target Families", "target_families", "list")),
    "chemicals_by_casrn": _fields(("CASRN", "casrn"), ("Chemical", "chemical"), ("Direction of Effect", "direction_of_effect"), ("PubChem Evidence", "pubchem_evidence"), ("Parsed Citations", "citation", "json")),
}


def exported(df: DataFrame, fields: list[Field]) -> DataFrame:
    """The fields as text columns, nulls replaced by their defaults; a path may lead into structs."""
    return df.select(*[F.coalesce(TRANSFORMS[f.transform](F.col(f.path)), F.lit(f.default)).alias(f.name) for f in fields])


def write_csv(df: DataFrame, path: str, sort_by: list[Column] | None = None, one_file: bool = False) -> None:
    """CSV with a header, quotes doubled; sorted by range over all files, or as one file where asked (small reports)."""
    rows = df.orderBy(*sort_by) if sort_by else df
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def unpivoted(stats: DataFrame) -> DataFrame:
    """One row of statistics as metric and value, fractions to two digits."""
    shown = [F.struct(F.lit(f.name).alias("metric"), (F.format_string("%.2f", f.name) if f.dataType.typeName() == "double" else F.col(f.name).cast("string")).alias("value")) for f in stats.schema]
    return stats.select(F.explode(F.array(*shown)).alias("m")).select("m.*")


def markdown_cell(value: object) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame) -> str:
    """A Markdown table of all rows of a report, read partition by partition; for large tables see ``markdown_lines``."""
    lines = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(lines + [f"| {' | '.join(map(markdown_cell, row))} |" for row in df.toLocalIterator()]) + "\n"


def markdown_lines(df: DataFrame) -> DataFrame:
    """``line``: the rows as lines of a Markdown table, to be written by Spark (bars escaped, line breaks as blanks, null as nothing)."""
    cells = [F.trim(F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def results_name(search: str, date: str, co_occurrence_only: bool = False, priority_field_only: bool = False, extension: str = "csv") -> str:
    """File name of a search's results."""
    parts = [search, "results", *["co_occurrence_only"] * co_occurrence_only, *["priority_field_only"] * priority_field_only, date]
    return "_".join(parts) + f".{extension}"
