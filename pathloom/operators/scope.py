"""Search within chosen pathways: what belongs to them, what is found there, which groups of terms meet.

``texts``: entity (aops, events, kers), entity_id, field, text.  A record is an (entity, entity_id);
ids are told apart by entity, so a pathway and an event with one number are two records.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_term, split_case_flag
from .graph import any_of
from .search import term_hits

#: How kinds of entity are named in reports, in the order of a report.
SHOWN = {"aops": "AOP", "events": "KE", "kers": "KER"}
KINDS = list(SHOWN)


def owners(selected: DataFrame, membership: DataFrame, aop_kers: DataFrame) -> DataFrame:
    """entity, entity_id and the sorted ``aop_ids`` of the selected pathways it belongs to (a pathway belongs to itself)."""
    chosen = selected.select("aop_id").distinct()
    part = lambda df, kind, key: df.join(chosen, "aop_id").select(F.lit(kind).alias("entity"), F.col(key).cast("string").alias("entity_id"), "aop_id")
    rows = part(chosen, "aops", "aop_id").unionByName(part(membership, "events", "ke_id")).unionByName(part(aop_kers, "kers", "ker_id"))
    return rows.groupBy("entity", "entity_id").agg(F.array_sort(F.collect_set("aop_id")).alias("aop_ids"))


def scope_counts(owned: DataFrame, known: DataFrame) -> DataFrame:
    """For each kind of entity, how many records are in scope and how many are mentioned but not ``known`` (entity, entity_id)."""
    there = known.select("entity", "entity_id").distinct().withColumn("known", F.lit(True))
    return owned.join(there, ["entity", "entity_id"], "left").groupBy("entity").agg(F.count("known").alias("in_scope"), (F.count("*") - F.count("known")).alias("missing"))


def asked_terms(terms: list[str], groups: dict[str, list[str]] | None = None) -> dict[str, bool]:
    """Terms in order, those of groups last, and whether their case counts; asked both ways is an error."""
    found: dict[str, bool] = {}
    for spelled in [*terms, *[t for ts in (groups or {}).values() for t in ts]]:
        term, exact = split_case_flag(spelled)
        if found.setdefault(term, exact) != exact:
            raise ValueError(f"{term!r} is asked for with and without its case")
    return found


def scope_hits(texts: DataFrame, owned: DataFrame, labels: DataFrame, asked: dict[str, bool]) -> DataFrame:
    """term_ord, term, entity, entity_id, label, aop_ids, field, snippet of every field in scope that has a term.

    A term whose case counts is looked for in the snippet of its first occurrence alone.
    """
    inside = texts.join(owned.select("entity", "entity_id"), ["entity", "entity_id"], "left_semi")
    hits = term_hits(inside.select(F.struct("entity", "entity_id").alias("entity_id"), "field", "text"), list(asked))
    wrong = any_of([(F.col("term") == t) & ~has_term(F.col("snippet"), t, case_sensitive=True) for t, exact in asked.items() if exact])
    hits = hits.filter(~wrong).select("term_ord", "term", "entity_id.*", "field", "snippet")
    return hits.join(owned, ["entity", "entity_id"]).join(labels, ["entity", "entity_id"], "left")


def scope_term_counts(hits: DataFrame, asked: dict[str, bool]) -> DataFrame:
    """term, entity and the number of fields found, zeros included."""
    every = hits.sparkSession.createDataFrame([(t, k) for t in asked for k in KINDS], "term string, entity string")
    counted = hits.groupBy("term", "entity").agg(F.count("*").alias("fields"))
    return F.broadcast(every).join(counted, ["term", "entity"], "left").na.fill(0, ["fields"])


def match_rows(hits: DataFrame) -> DataFrame:
    """One row for each snippet, as exported: term, entity, id, label, aop_ids, field, snippet."""
    shown = F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair])
    return hits.filter("snippet is not null").select("term", shown[F.col("entity")].alias("entity"), F.col("entity_id").alias("id"), "label", F.array_join(F.transform("aop_ids", lambda x: x.cast("string")), ", ").alias("aop_ids"), "field", "snippet")


def group_records(hits: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """grp, entity, entity_id, label, aop_ids, the terms found (in the group's order) and the fields, for every record a group is found in."""
    spelled = [(g, split_case_flag(t)[0], i) for g, ts in groups.items() for i, t in enumerate(ts)]
    spelled = hits.sparkSession.createDataFrame(spelled, "grp string, term string, place int")
    met = hits.join(F.broadcast(spelled), "term").groupBy("grp", "entity", "entity_id").agg(
        F.first("label").alias("label"), F.first("aop_ids").alias("aop_ids"), F.array_sort(F.collect_set(F.struct("place", "term"))).alias("t"), F.array_sort(F.collect_set("field")).alias("fields")
    )
    return met.select("grp", "entity", "entity_id", "label", "aop_ids", F.transform("t", lambda x: x["term"]).alias("terms"), "fields")


def group_counts(records: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Records of every group, zeros included."""
    every = records.sparkSession.createDataFrame([(g,) for g in groups], "grp string")
    return every.join(records.groupBy("grp").agg(F.count("*").alias("records")), "grp", "left").na.fill(0, ["records"])


def co_occurring_records(records: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """group_a, group_b and the records both are found in, with the terms and fields of each."""
    held = records.groupBy("entity", "entity_id").agg(F.first("label").alias("label"), F.first("aop_ids").alias("aop_ids"), *[F.max(F.when(F.col("grp") == g, F.struct("terms", "fields"))).alias(f"g{i}") for i, g in enumerate(groups)])
    pairs = [F.when(F.col(f"g{i}").isNotNull() & F.col(f"g{j}").isNotNull(), F.struct(F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), *[F.col(f"g{k}")[c].alias(f"{c}_{side}") for c in ("terms", "fields") for k, side in ((i, "a"), (j, "b"))])) for (i, a), (j, b) in combinations(enumerate(groups), 2)]
    none = F.lit(None).cast("struct<group_a: string, group_b: string, terms_a: array<string>, terms_b: array<string>, fields_a: array<string>, fields_b: array<string>>")
    met = held.select("entity", "entity_id", "label", "aop_ids", F.inline(F.array_compact(F.array(none, *pairs))))
    return met.select("group_a", "group_b", "entity", "entity_id", "label", "aop_ids", "terms_a", "fields_a", "terms_b", "fields_b")


def tally(counts: DataFrame) -> DataFrame:
    """term and what it was found in, such as ``3 AOP fields, 1 KE field``; kinds with none are left out."""
    said = {k: F.max(F.when((F.col("entity") == k) & (F.col("fields") > 0), F.concat(F.col("fields").cast("string"), F.lit(f" {shown} field"), F.when(F.col("fields") != 1, "s").otherwise("")))) for k, shown in SHOWN.items()}
    return counts.groupBy("term").agg(F.concat_ws(", ", *said.values()).alias("tally"))


def report_lines(hits: DataFrame, counts: DataFrame) -> DataFrame:
    """A Markdown report of what was found, as lines with the keys that order them.

    A heading for each term found, a line for each record, its fields and quotes below; terms
    that are nowhere come last.  Rows stay rows: the report is written, not gathered.
    """
    shown = F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair])
    told = tally(counts).filter("tally <> ''")
    order = lambda section, kind, number, entity, place, text: [F.lit(section).alias("section"), F.col("term"), kind.alias("kind"), number.alias("number"), entity.alias("entity_id"), F.lit(place).alias("place"), text]
    none, nothing = F.lit(-1), F.lit("")
    heads = told.select(*order(0, none, none.cast("long"), nothing, 0, F.concat(F.lit("### '"), "term", F.lit("' — "), "tally").alias("line")), nothing.alias("field"))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("entity")).cast("int")
    number = F.coalesce(F.col("entity_id").try_cast("long"), F.lit(0).cast("long"))
    aops = F.array_join(F.transform("aop_ids", lambda x: F.concat(F.lit("AOP "), x.cast("string"))), ", ")
    records = hits.select("term", "entity", "entity_id", "label", "aop_ids").distinct()
    records = records.select(*order(0, kind, number, F.col("entity_id"), 0, F.concat(F.lit("- **"), shown[F.col("entity")], F.lit(" "), "entity_id", F.lit("** "), F.coalesce("label", nothing), F.lit(" ("), aops, F.lit(")")).alias("line")), nothing.alias("field"))
    quotes = hits.filter("snippet is not null").select(*order(0, kind, number, F.col("entity_id"), 1, F.concat(F.lit("  - `"), "field", F.lit("`: > "), "snippet").alias("line")), "field")
    absent = counts.groupBy("term").agg(F.sum("fields").alias("n")).filter("n = 0").select(*order(1, none, none.cast("long"), nothing, 0, F.concat(F.lit("- '"), "term", F.lit("' was not found")).alias("line")), nothing.alias("field"))
    return heads.unionByName(records).unionByName(quotes).unionByName(absent)
