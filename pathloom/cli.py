"""Commands over one dated snapshot of the knowledge base: ``python -m pathloom --data-dir DIR COMMAND ...``.

``DIR/snapshot.xml`` (or ``--snapshot``) is read once for a date; typed tables are kept in
``DIR/cache``, results go to ``DIR/outputs``.  ``DIR`` may be any folder Spark can read.
"""

from __future__ import annotations

import argparse
import importlib
import os
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import citations, evidence, fuzzy, grammar, references, scoring
from .functions.text import clean_html, parse_term_groups
from .operators import graph, harmonize, review, scope, search, sheets, term_index, workbook
from .plans import search_config
from .sources import html_tables, json_documents, sinks, snapshot, spreadsheet

# Texts searched of each kind of entity; what concordance is searched by, in which fields, without which passage.
TEXT_FIELDS = {
    "aops": ["title", "short_name", "abstract", "background", "development_strategy", "overall_assessment_description", "doa_free_text", "ke_essentiality", "woe_evidence", "quantitative_considerations", "known_modulating_factors", "potential_applications", "references"],
    "events": ["title", "short_name", "description", "measurement_method", "doa_free_text", "references"],
    "kers": ["description", "biological_plausibility", "empirical_support", "weight_of_evidence", "quantitative_understanding", "uncertainties", "modulating_factors", "response_relationship", "time_scale", "known_loops", "evidence_collection_strategy", "doa_free_text", "references"],
}
CONCORDANCE_TERMS = ["dose concordance", "temporal concordance", "incidence concordance"]
CONCORDANCE_FIELDS = ["empirical_support", "quantitative_understanding", "weight_of_evidence", "biological_plausibility"]
CONCORDANCE_DROPPED = {"empirical_support": ["Include consideration of temporal concordance here"]}
ENDORSED, OPEN_LICENSE = "WPHA/WNT Endorsed", "Open for adoption"
REQUIRED = ("ids", "aops", "events", "kers")
KEYS = {"aops": "aop_id", "events": "ke_id", "kers": "ker_id"}


class Knowledge:
    """Typed tables of one snapshot, built once for its date."""

    def __init__(self, spark: SparkSession, data_dir: str, xml: str | None = None, day: str | None = None, refresh: bool = False) -> None:
        self.spark, self.root, self.day, self.refresh = spark, data_dir.rstrip("/"), day or date.today().isoformat(), refresh
        self.xml = xml or f"{self.root}/snapshot.xml"

    def _table(self, name: str, build) -> DataFrame:
        return snapshot.cached(self.spark, f"{self.root}/cache", name, self.day, build, self.refresh, required=name in REQUIRED)

    def _typed(self, name: str, reader) -> DataFrame:
        return self._table(name, lambda: reader(self.spark, self.xml, self.ids()))

    def ids(self) -> DataFrame:
        return self._table("ids", lambda: snapshot.checked(self.spark, snapshot.checked_file(self.spark, self.xml), snapshot.id_map(self.spark, self.xml)))

    def membership(self) -> DataFrame:
        return self._typed("membership", snapshot.membership)

    def aop_kers(self) -> DataFrame:
        return self._typed("aop_kers", snapshot.aop_relationships)

    def events(self) -> DataFrame:
        said = graph.regulatory_relevance(self.membership().withColumn("ord", F.struct("aop_ord", "ord")))
        return self._typed("events", snapshot.key_events).join(said, "ke_id", "left")

    def kers(self) -> DataFrame:
        """Relationships with titles of both ends, their pathways and completeness."""
        titles = self.events()
        rows = self._typed("kers", snapshot.relationships)
        for end in ("upstream", "downstream"):
            rows = rows.join(titles.select(F.col("ke_id").alias(end), F.col("title").alias(f"{end}_title")), end, "left")
        owned = self.aop_kers().groupBy("ker_id").agg(F.array_sort(F.collect_set("aop_id")).alias("aop_ids"))
        rows = rows.join(owned, "ker_id", "left")
        return rows.withColumn("percent", scoring.ker_completion(rows)["percent"])

    def aops(self) -> DataFrame:
        rows = self._typed("aops", snapshot.aops)
        return rows.withColumn("score", scoring.aop_completion(rows))

    def edges(self) -> DataFrame:
        return self.kers().select("ker_id", "upstream", "downstream").join(self.aop_kers().select("ker_id", "aop_id"), "ker_id")

    def ranked_events(self) -> DataFrame:
        """Events with completeness, pathway statuses and the integration score."""
        rows = self.events()
        status = graph.status_rollup(self.membership(), self.aops().select("aop_id", F.col("oecd_status").alias("status"), F.col("wiki_license").alias("license")), ENDORSED, OPEN_LICENSE)
        rows = rows.withColumn("percent", scoring.event_completion(rows)["percent"]).join(status, "ke_id", "left")
        flag = lambda c: F.coalesce(F.col(c), F.lit(False))
        return scoring.integration_rank(rows, F.col("percent"), flag("in_oecd_aop_program"), flag("any_oecd_endorsed"), F.col("only_open_for_adoption"), F.col("measurement_method"), F.col("aop_count"))

    def texts(self, kind: str, fields: list[str] | None = None) -> DataFrame:
        """entity, entity_id, field and cleaned text of one kind of entity."""
        rows = getattr(self, kind)()
        cells = [F.struct(F.lit(f).alias("field"), clean_html(F.col(f)).alias("text")) for f in fields or TEXT_FIELDS[kind] if f in rows.columns]
        return rows.select(F.lit(kind).alias("entity"), F.col(KEYS[kind]).cast("string").alias("entity_id"), F.inline(F.array(*cells)))

    def word_index(self, kind: str, texts: DataFrame) -> DataFrame:
        """The words of one kind of entity with their places, kept for the date."""
        return self._table(f"words_{kind}", lambda: term_index.term_index(texts))

    def labels(self) -> DataFrame:
        ends = F.concat_ws(" -> ", F.coalesce("upstream_title", F.lit("?")), F.coalesce("downstream_title", F.lit("?")))
        label = {"aops": F.col("title"), "events": F.col("title"), "kers": ends}
        parts = [getattr(self, k)().select(F.lit(k).alias("entity"), F.col(KEYS[k]).cast("string").alias("entity_id"), label[k].alias("label")) for k in KEYS]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def citations(self) -> DataFrame:
        """Structured citations of all references texts, one row each."""
        rows = self._table("references", lambda: snapshot.references(self.spark, self.xml, self.ids()))
        listed = rows.select("entity", "entity_id", F.explode(citations.paragraphs(F.col("references"))).alias("raw_citation"))
        parts = grammar.reference_entry("raw_citation")
        return listed.withColumn("p", parts).select("entity", "entity_id", "raw_citation", "p.*")

    def save(self, df: DataFrame, name: str, order: list | None = None, report: bool = False) -> str:
        """CSV under ``outputs``, written range by range; a ``report`` of a few rows is one file."""
        path = f"{self.root}/outputs/{name}-{self.day}"
        shown = [F.col(f"`{c}`").cast("string") if t.startswith(("bool", "int", "big", "dou", "str", "lon", "dec")) else json_documents.json_cell(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes]
        sinks.write_csv(df.select(*shown), path, order, one_file=report)
        return path

    def report(self, df: DataFrame, name: str) -> str:
        return self.save(df, name, report=True)

    def save_workbook(self, rows: DataFrame, name: str) -> str:
        path = f"{self.root}/outputs/{name}-{self.day}.xlsx"
        os.makedirs(os.path.dirname(spreadsheet.local_path(path)), exist_ok=True)
        spreadsheet.write_workbook(rows, path)
        return path

    def save_json(self, df: DataFrame, name: str) -> str:
        path = f"{self.root}/outputs/{name}-{self.day}.json"
        json_documents.write_json(df, path)
        return path


def _split(text: str | None) -> list[str]:
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def event_rankings(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    ranked = kb.ranked_events()
    stats = ranked.agg(F.count("*").alias("total_events"), scoring.average_percent(F.col("percent")).alias("average_percent"), F.count_if("has_method").alias("with_methods"), F.count_if(F.coalesce("only_open_for_adoption", F.lit(False))).alias("only_open_for_adoption"))
    rows = ranked.orderBy(F.desc("integration_score"), F.col("ke_id").try_cast("long"))
    return [kb.save(sinks.exported(rows, sinks.FIELD_SETS["event_summary"]), "event_rankings"), kb.report(sinks.unpivoted(stats), "event_rankings_summary")]


def ker_analytics(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    return [kb.report(sinks.unpivoted(scoring.ker_statistics(kb.kers())), "ker_analytics")]


def kers_for_events(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    if bool(args.ke_ids) == bool(args.ke_terms):
        raise SystemExit("give either --ke-ids or --ke-terms")
    wanted = graph.events_by_title(kb.events(), _split(args.ke_terms)).select("ke_id") if args.ke_terms else kb.spark.createDataFrame([(i,) for i in _split(args.ke_ids)], "ke_id string")
    found = graph.kers_containing(kb.kers().select("ker_id", "upstream", "downstream"), wanted)
    titled = found.join(kb.labels().filter("entity = 'kers'").select(F.col("entity_id").alias("ker_id"), "label"), "ker_id", "left")
    titled.orderBy(F.col("ker_id").try_cast("long")).show(args.limit, truncate=60)
    return [kb.save(titled, "ker_lookup"), kb.save(graph.role_counts(kb.kers().join(found.select("ker_id").distinct(), "ker_id", "left_semi")), "ker_lookup_summary")]


def search_within_aops(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    ids = kb.spark.createDataFrame([(i,) for i in _split(args.aop_ids)], "aop_id string")
    aops, chosen = kb.aops(), []
    if args.aop_ids:
        chosen.append(("aop_id", ids.join(aops.select("aop_id"), "aop_id", "left_semi")))
    if args.aop_title_terms:
        chosen.append(("aop_title", graph.events_by_title(aops, _split(args.aop_title_terms)).select("aop_id")))
    if args.ke_title_terms:
        chosen.append(("ke_title", graph.aops_containing(kb.membership(), graph.events_by_title(kb.events(), _split(args.ke_title_terms))).select("aop_id")))
    if not chosen:
        raise SystemExit("give --aop-ids, --aop-title-terms or --ke-title-terms")
    groups = parse_term_groups(args.term_group)
    asked = scope.asked_terms(args.term, groups)
    if not asked:
        raise SystemExit("give --term or --term-group")
    selected = graph.selected_aops(chosen)
    owned = scope.owners(selected, kb.membership(), kb.aop_kers())
    texts = kb.texts("aops").unionByName(kb.texts("events")).unionByName(kb.texts("kers"))
    hits = scope.scope_hits(texts, owned, kb.labels(), asked).cache()
    counts = scope.scope_term_counts(hits, asked)
    order = ["section", "term", "kind", "number", "entity_id", "place", "field"]
    saved = [kb.save(scope.match_rows(hits), "within_aop_matches"), kb.save(counts, "within_aop_counts"), kb.save(scope.report_lines(hits, counts).orderBy(*order).select("line"), "within_aop_report"), kb.save(selected, "within_aop_scope")]
    if groups:
        saved.append(kb.save(scope.co_occurring_records(scope.group_records(hits, groups), groups), "within_aop_co_occurrences"))
    if args.aop_ids:
        saved.append(kb.save(graph.missing_ids(ids, aops, "aop_id"), "within_aop_missing"))
    return saved


def concordance(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    texts = kb.texts("kers", CONCORDANCE_FIELDS)
    for name, passages in CONCORDANCE_DROPPED.items():
        texts = search.dropping_content(texts, name, passages)
    known = kb.kers().select(F.col("ker_id").cast("string").alias("ker_id"), F.col("upstream_title").alias("upstream_ke"), F.col("downstream_title").alias("downstream_ke"), F.col("aop_ids").alias("aops"))
    return [kb.save(sinks.exported(search.concordance(texts, CONCORDANCE_TERMS, known), sinks.FIELD_SETS["concordance_ker"]), "concordance")]


def harmonize_evidence(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    kers = kb.kers()
    blocks = kers.select("ker_id", F.inline(F.array(*[F.struct(F.lit(b).alias("field"), F.col(b).alias("html")) for b in snapshot.EVIDENCE_BLOCKS])))
    cells = html_tables.html_cells(blocks, ["ker_id", "field"], "html").cache()
    headers = harmonize.matched_headers(cells, kers.select("ker_id", "upstream_title", "downstream_title")).cache()
    tables = harmonize.harmonized_cells(cells, kers.select("ker_id", "upstream_title", "downstream_title")).cache()
    summary = sinks.unpivoted(harmonize.harmonization_summary(headers))
    saved = [kb.save(headers, "evidence_headers"), kb.save(tables.drop("col_ix"), "harmonized_evidence"), kb.report(summary, "evidence_summary")]
    if args.workbook:
        ends = kers.select("ker_id", "upstream", "upstream_title", "downstream", "downstream_title")
        aops = kb.aops().select("aop_id", "title", F.col("oecd_status").alias("status"))
        chosen = _split(args.aop_ids)
        saved.append(kb.save_workbook(sheets.evidence_workbook(tables, headers, ends, kb.aop_kers(), aops, summary, chosen, args.links), "harmonized_evidence"))
        for aop in chosen:  # a workbook for each pathway asked for
            own = kb.aop_kers().filter(F.col("aop_id") == aop).select("ker_id").distinct()
            saved.append(kb.save_workbook(sheets.relation_sheets(tables.join(own, "ker_id", "left_semi"), ends, args.links), f"harmonized_evidence_aop_{aop}"))
    return saved


def events_to_aops(kb: Knowledge, args: argparse.Namespace, config: search_config.EventSearch) -> list[str]:
    """Pathways by their events' titles, with all events of the pathways found."""
    matched = graph.events_by_title(kb.events(), config.terms)
    aops = kb.aops().select("aop_id", "title", F.col("oecd_status").alias("status"))
    found = search_config.events_to_aops(kb.events(), kb.membership(), aops, config).cache()
    members = graph.events_with_provenance(kb.membership(), found, kb.events())
    events = members.groupBy("ke_id").agg(F.first("title").alias("title"), F.array_sort(F.collect_set("aop_id")).alias("found_in_aops"))
    sources = kb.membership().join(matched.select("ke_id"), "ke_id", "left_semi").groupBy("aop_id").agg(F.array_sort(F.collect_set("ke_id")).alias("source_events"))
    summary = graph.event_to_aop_summary(matched, graph.aops_containing(kb.membership(), matched), aops, config.excluded_title_terms, config.statuses)
    named = found.join(sources, "aop_id", "left")
    name = args.config
    return [
        kb.save(matched.select("ke_id", "title", "matched_terms"), f"{name}_events"), kb.save(named, f"{name}_aops"), kb.save(events, f"{name}_aop_events"),
        kb.report(sinks.unpivoted(summary), f"{name}_summary"), kb.save_json(named, f"{name}_aops"),
    ]


def search_with_config(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    """A registered search: by texts of entities (with a comparison of events found by text and through pathways, where both are searched), or from events to pathways."""
    if args.module:
        importlib.import_module(args.module)
    config = search_config.REGISTRY.get(args.config)
    if config is None:
        raise SystemExit(f"no search {args.config!r}; there are {', '.join(sorted(search_config.REGISTRY)) or 'none'}")
    if isinstance(config, search_config.EventSearch):
        return events_to_aops(kb, args, config)
    saved, found = [], {}
    for kind in config.entities:
        texts = kb.texts(kind).drop("entity")
        hits = search_config.run_search(texts, config.for_kind(kind), kb.word_index(kind, texts) if args.index else None)
        if args.co_occurrence_only and config.co_occurrences:
            hits = hits.filter("co_occurrences is not null")
        found[kind] = hits.cache()
        name = f"{config.name}_{kind}"
        saved.append(kb.save(found[kind], sinks.results_name(name, kb.day, args.co_occurrence_only, not config.fields)))
        saved.append(kb.save_json(json_documents.search_document(found[kind], config.name, kb.day, args.co_occurrence_only), f"{name}_results"))
    if {"events", "aops"} <= set(found):
        members = kb.membership().select(F.col("aop_id").cast("string").alias("aop_id"), F.col("ke_id").cast("string").alias("ke_id"))
        through = members.join(found["aops"].select(F.col("entity_id").alias("aop_id")), "aop_id", "left_semi").select("ke_id")
        both = graph.combined_hits(found["events"].select(F.col("entity_id").alias("ke_id")), through, "ke_id").cache()
        counts = both.agg(F.count_if(F.col("text_match") & F.col("aop_match")).alias("events_in_both"), F.count_if(~F.col("aop_match")).alias("events_text_only"), F.count_if(~F.col("text_match")).alias("events_aop_only"))
        saved += [kb.save(both, f"{config.name}_combined_events"), kb.report(sinks.unpivoted(counts), f"{config.name}_comparison")]
    return saved


def pair_mies_and_aos(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    matched = graph.events_by_title(kb.events(), _split(args.terms))
    found = graph.aops_containing(kb.membership(), matched)
    aops = kb.aops().select("aop_id", F.col("title").alias("aop_title"), "oecd_status")
    pairs = graph.pair_rows(kb.membership(), found, aops, kb.events(), matched, kb.edges()).cache()
    pairs.show(args.limit, truncate=60)
    summary = graph.pair_summary(pairs.select("aop_id", F.nullif("mie_id", F.lit("")).alias("mie_id"), F.nullif("ao_id", F.lit("")).alias("ao_id")))
    numeric = [F.coalesce(F.col(c).try_cast("long"), F.lit(1 << 62)) for c in ("aop_id", "mie_id", "ao_id")]
    return [kb.save(pairs, "mie_ao_pairs", numeric), kb.save(sinks.markdown_lines(pairs), "mie_ao_table"), kb.report(sinks.unpivoted(summary), "mie_ao_summary"), kb.save(graph.kers_in_aops(kb.edges(), found), "mie_ao_kers")]


def export_groups(kb: Knowledge, tables: dict[str, DataFrame], groups: list[str], kinds: list[str]) -> list[str]:
    """Tables of some groups under their field sets as csv, as json, and as one workbook with a sheet for each (xlsx)."""
    if unknown := sorted({*groups} - {*workbook.EXPORTS}) + sorted({*kinds} - {"csv", "json", "xlsx"}):
        raise SystemExit(f"no group or kind of export {', '.join(unknown)}; groups: {', '.join(workbook.EXPORTS)}; kinds: csv, json, xlsx")
    shown = {name: sinks.exported(tables[name], sinks.FIELD_SETS[fields]) for group in groups for name, fields in workbook.EXPORTS[group].items()}
    saved = [kb.save(df, f"export_{name}") for name, df in shown.items()] if "csv" in kinds else []
    saved += [kb.save_json(df, f"export_{name}") for name, df in shown.items()] if "json" in kinds else []
    if "xlsx" in kinds:
        rows = [spreadsheet.table_rows(df, name, at, [F.col(f"`{c}`") for c in df.columns]) for at, (name, df) in enumerate(shown.items())]
        saved.append(kb.save_workbook(reduce(DataFrame.unionByName, rows), "curated"))
    return saved


def collect_sheets(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    """Curated sheets as CSV files in one folder (harmonization.csv, assays.csv, chemicals.csv, target_families.csv) or as a workbook.

    Pairs of pathways meant to be one are checked, families without curated events matched and, with
    decisions, bridged to assays.
    """
    read = lambda name: kb.spark.read.option("header", True).csv(f"{args.sheets}/{name}.csv")
    if args.sheets.endswith(".xlsx"):
        held = workbook.refined_sheets(lambda sheet, skip: spreadsheet.read_sheet(kb.spark, args.sheets, sheet, skip=skip))
    else:
        held = {name: read(name) for name in ("harmonization", "assays", "chemicals", "target_families")}
    sheet = held["harmonization"].withColumn("row_ix", F.col("row_ix").cast("long"))
    events = workbook.harmonized_events(sheet, kept=("target_family", "references")).cache()
    enriched = workbook.enriched_events(events, kb.events(), kb.aops()).cache()
    assays, families = held["assays"], held["target_families"]
    mapped = workbook.map_target_families(families.select("target_family").distinct(), events, assays)
    vocabulary = kb.events().select("ke_id", "title", F.col("ke_id").try_cast("long").alias("ord"))
    matched = fuzzy.enriched_families(mapped, vocabulary).cache()
    pairs = kb.spark.read.option("header", True).csv(args.pairs) if args.pairs else kb.spark.createDataFrame(workbook.COMBINED_PAIRS, "pair string, mie string, one string, two string")
    saved = [
        kb.save(sinks.exported(enriched.withColumnsRenamed({"row_ix": "row_index", "title": "harmonized_event"}), sinks.FIELD_SETS["curated_event"]), "curated_events"),
        kb.save(workbook.extraction_summary(enriched), "extraction_summary"),
        kb.save(sinks.exported(workbook.harmonized_summary(enriched), sinks.FIELD_SETS["harmonized_summary"]), "harmonized_summary"),
        kb.save(workbook.harmonized_titles(events), "event_titles"),
        kb.save(workbook.merged_titles(workbook.harmonized_aops(events)), "merged_titles"),
        kb.save(workbook.pair_checks(workbook.harmonized_aops(events), pairs), "pair_checks"),
        *[kb.save(workbook.assays_by(assays, by), f"assays_by_{by}") for by in ("aeid", "aop_ids", "ke_descriptions")],
        kb.save(workbook.aeid_conflicts(workbook.assays_by(assays, "aeid")), "aeid_conflicts"),
        kb.save(workbook.family_sets(families, assays, events), "target_family_sets"),
        kb.save(sheets.ranked_families(matched), "target_families", ["place"]),
        kb.report(sinks.unpivoted(fuzzy.match_metrics(matched)), "target_family_metrics"),
        kb.save(workbook.normalized_chemicals(held["chemicals"].withColumn("row_ix", F.col("row_ix").cast("long"))), "chemicals"),
    ]
    if args.export:
        chemicals = workbook.normalized_chemicals(held["chemicals"].withColumn("row_ix", F.col("row_ix").cast("long")))
        chemicals = chemicals if "chemical" in chemicals.columns else chemicals.withColumn("chemical", F.lit(None).cast("string"))
        tables = workbook.export_tables(enriched, assays, workbook.family_sets(families, assays, events), mapped, chemicals)
        saved += export_groups(kb, tables, _split(args.groups) or list(workbook.EXPORTS), _split(args.export))
    if args.decisions:
        decided = kb.spark.read.option("header", True).csv(args.decisions).withColumnRenamed("term", "target_family").withColumn("human_verified", F.col("human_verified").cast("boolean"))
        reviewed = graph.placed(fuzzy.reviewed(matched, decided, 0.0, "target_family"), [F.col("target_family")], "ord")
        ways = reviewed.withColumnsRenamed({"matched_term": "event", "suggested_match": "suggested_event"})
        saved += [kb.save(reviewed.drop("ord"), "target_families_reviewed"), kb.save(workbook.bridged_events(ways, mapped.select("target_family", "assays")), "bridged_events")]
    return saved


def review_matches(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    """Matches and decisions as CSV files: term, match_score; term, human_verified, suggested_match."""
    read = lambda path: kb.spark.read.option("header", True).csv(path)
    matches = read(args.matches).withColumn("match_score", F.col("match_score").cast("double"))
    done = fuzzy.reviewed(matches, read(args.decisions).withColumn("human_verified", F.col("human_verified").cast("boolean")), args.threshold)
    return [kb.save(done, "reviewed_matches"), kb.report(sinks.unpivoted(fuzzy.review_summary(done)), "review_summary")]


def _some_events(kb: Knowledge, args: argparse.Namespace) -> DataFrame:
    events = kb.events()
    return events.filter(F.col("ke_id").isin(*_split(args.ke_ids))) if args.ke_ids else events


def align_levels(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    """Definitions as CSV: level, definition."""
    definitions = {r["level"]: r["definition"] for r in kb.spark.read.option("header", True).csv(args.definitions).collect()}
    found = evidence.level_findings(_some_events(kb, args), definitions, cell="cell_term").withColumn("check", F.lit("level"))
    return [kb.save(found, "level_alignment"), kb.save(review.check_summary(found), "level_alignment_summary")]


def review_events(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    module, _, name = args.judge.partition(":")
    events = _some_events(kb, args)
    if args.limit:
        events = events.orderBy(F.col("ke_id").try_cast("long")).limit(args.limit)
    judge = getattr(importlib.import_module(module), name)
    definitions = {r["level"]: r["definition"] for r in kb.spark.read.option("header", True).csv(args.definitions).collect()} if args.definitions else {}
    found = review.resumed_review(events, judge, definitions, f"{kb.root}/cache/verdicts").cache()
    return [kb.save(found, "event_review"), kb.report(sinks.unpivoted(review.severity_summary(found)), "event_review_summary")]


def search_references(kb: Knowledge, args: argparse.Namespace) -> list[str]:
    """``--across field=one|two`` (all must hold) and ``--terms`` with ``--field`` and ``--least``."""
    searches = [{"across": parse_term_groups(args.across)}] if args.across else []
    if args.terms:
        searches.append({"terms": _split(args.terms), "field": args.field} | ({"least": args.least} if args.least else {}))
    if not searches:
        raise SystemExit("give --across or --terms")
    found = references.indexed_citations(references.reference_search(kb.citations(), searches))
    return [kb.save(found, "reference_search"), kb.save(references.search_totals(found), "reference_search_summary")]


COMMANDS = {
    "collect-event-integration-rankings": (event_rankings, []),
    "collect-ker-analytics": (ker_analytics, []),
    "find-kers-for-events": (kers_for_events, [("--ke-ids", {}), ("--ke-terms", {}), ("--limit", {"type": int, "default": 25})]),
    "search-within-aops": (search_within_aops, [("--term", {"action": "append", "default": []}), ("--term-group", {"action": "append", "default": []}), ("--aop-ids", {}), ("--aop-title-terms", {}), ("--ke-title-terms", {})]),
    "search-kers-for-concordance-text": (concordance, []),
    "harmonize-ker-evidence": (harmonize_evidence, [("--workbook", {"action": "store_true"}), ("--aop-ids", {}), ("--links", {"default": "https://kb.example"})]),
    "search-with-config": (search_with_config, [("--config", {"required": True}), ("--module", {}), ("--co-occurrence-only", {"action": "store_true"}), ("--index", {"action": "store_true"})]),
    "pair-mies-and-aos": (pair_mies_and_aos, [("--terms", {"required": True}), ("--limit", {"type": int, "default": 25})]),
    "collect-harmonized-sheets": (collect_sheets, [("--sheets", {"required": True}), ("--pairs", {}), ("--decisions", {}), ("--export", {"help": "csv, json, xlsx"}), ("--groups", {"help": "of exports; all"})]),
    "manually-review-matches": (review_matches, [("--matches", {"required": True}), ("--decisions", {"required": True}), ("--threshold", {"type": float, "default": 0.0})]),
    "event-content-internal-alignment": (align_levels, [("--definitions", {"required": True}), ("--ke-ids", {})]),
    "event-level-review": (review_events, [("--judge", {"required": True}), ("--definitions", {}), ("--ke-ids", {}), ("--limit", {"type": int})]),
    "search-references": (search_references, [("--across", {"action": "append", "default": []}), ("--terms", {}), ("--field", {"default": "all"}), ("--least", {"type": int})]),
}


def data_dir(said: str | None) -> str:
    """The folder of snapshot, cache and outputs: said on the command line, else ``PATHLOOM_DATA``, else the working folder."""
    return said or os.environ.get("PATHLOOM_DATA") or os.getcwd()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pathloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--data-dir")
    top.add_argument("--snapshot", help="XML export, default DIR/snapshot.xml")
    top.add_argument("--date", help="date of the snapshot (YYYY-MM-DD), default today")
    top.add_argument("--force", action="store_true", help="read the XML again")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (function, options) in COMMANDS.items():
        one = commands.add_parser(name, help=function.__doc__)
        for flag, how in options:
            one.add_argument(flag, **how)
    return top


def run(spark: SparkSession, arguments: list[str]) -> list[str]:
    """Run one command; the folders it wrote."""
    args = parser().parse_args(arguments)
    kb = Knowledge(spark, data_dir(args.data_dir), args.snapshot, args.date, args.force)
    return COMMANDS[args.command][0](kb, args)
