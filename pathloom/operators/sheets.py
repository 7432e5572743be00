"""Sheets of a workbook on harmonized evidence, as rows: a summary, pathways in order, headers, relationships, a sheet for each.

Everything is decided here by joins, aggregates and places; ``sources.spreadsheet`` writes the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import placed
from .harmonize import harmonizable_fields

# Headings and names of sheets.
PATHWAY_HEADS = ("AOP ID", "AOP Title", "Selected for Workbook?", "OECD Status", "Count Harmonizable KERs", "KER IDs")
RELATION_HEADS = ("KER ID", "Upstream KE", "Downstream KE")
ROW_HEADS = ("KER ID", "Field Type", "Table Index")
NOTHING = "N/A"


def pathway_order(members: DataFrame, harmonizable: DataFrame, aops: DataFrame, selected: list[str]) -> DataFrame:
    """Pathways that hold harmonizable relationships: place, aop_id, title, selected, status, n_kers, ker_ids; most relationships first, then by number.

    ``members``: aop_id, ker_id; ``harmonizable``: ker_id; ``aops``: aop_id, title, status.
    """
    ids = F.array_sort(F.collect_set(F.struct(F.col("ker_id").try_cast("long").alias("number"), F.col("ker_id").cast("string").alias("id"))))
    held = members.select("aop_id", "ker_id").join(harmonizable.select("ker_id").distinct(), "ker_id", "left_semi").groupBy("aop_id").agg(ids.alias("ids"))
    rows = held.join(aops.select("aop_id", "title", "status"), "aop_id", "left").select(
        F.col("aop_id").cast("string").alias("aop_id"), F.coalesce("title", F.lit(NOTHING)).alias("title"), F.when(F.col("aop_id").cast("string").isin(*selected), "Y").otherwise("").alias("selected"),
        F.coalesce("status", F.lit(NOTHING)).alias("status"), F.size("ids").alias("n_kers"), F.array_join(F.transform("ids", lambda x: x["id"]), ", ").alias("ker_ids"),
    )
    return placed(rows, [F.desc("n_kers"), F.asc_nulls_last(F.col("aop_id").try_cast("long")), F.col("aop_id")])


def ranked_families(matches: DataFrame) -> DataFrame:
    """Target families with their ``place`` by falling match score; those without a match last, equals by name."""
    return placed(matches, [F.desc(F.coalesce("match_score", F.lit(0.0))), F.col("target_family")])


def _rows(df: DataFrame, place: int, sheet: str | Column, row_ix: Column, values: Column, links: Column | None = None, head: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    named = sheet if isinstance(sheet, Column) else F.lit(sheet)
    at = F.lit(place) if isinstance(place, int) else place
    return df.select(at.cast("int").alias("place"), named.alias("sheet"), row_ix.cast("int").alias("row_ix"), values.alias("values"), (none if links is None else links).alias("links"), (F.lit(False) if head is None else head).alias("head"))


def _headed(df: DataFrame, place: int, sheet: str, heads: tuple[str, ...]) -> DataFrame:
    return _rows(df.sparkSession.range(1), place, sheet, F.lit(0), F.array(*map(F.lit, heads)), head=F.lit(True))


def relation_sheets(cells: DataFrame, kers: DataFrame, links: str, first_place: int = 0) -> DataFrame:
    """A sheet for each relationship with harmonized cells (``harmonize.harmonized_cells``): its link, its two events, a blank row, its table rows.

    Columns come in the order in which they are first met.  ``kers``: ker_id, upstream, upstream_title, downstream, downstream_title.
    """
    met = F.struct("field", "table_ix", "row_ix", "col_ix", "name")
    columns = cells.groupBy("ker_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(met)), lambda x: x["name"])).alias("columns"))
    rows = cells.groupBy("ker_id", "field", "table_ix", "row_ix").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("held"))
    number = F.row_number().over(Window.partitionBy("ker_id").orderBy("field", "table_ix", "row_ix"))
    body = rows.withColumn("number", number).join(columns, "ker_id")
    key, sheet = F.col("ker_id").cast("string"), F.concat(F.lit("KER_"), F.col("ker_id").cast("string"))
    place = F.lit(first_place) + F.coalesce(F.col("ker_id").try_cast("int"), F.lit(0))
    data = F.concat(F.array(key, F.col("field"), F.col("table_ix").cast("string")), F.transform("columns", lambda c: F.element_at("held", c)))
    filled = _rows(body, place, sheet, F.col("number") + 4, data)
    heads = _rows(columns, place, sheet, F.lit(4), F.concat(F.array(*map(F.lit, ROW_HEADS)), "columns"), head=F.lit(True))
    known = columns.select("ker_id").join(kers, "ker_id", "left")
    linked = lambda kind, of: F.concat(F.lit(f"{links}/{kind}/"), of.cast("string"))
    title = _rows(known, place, sheet, F.lit(0), F.array(F.concat(F.lit("KER "), key)), F.array(F.concat(linked("relationships", F.col("ker_id")), F.lit("#link_support"))))
    ends = [
        _rows(known, place, sheet, F.lit(at), F.array(F.lit(f"{side.title()} KE:"), F.coalesce(f"{side}_title", F.lit(NOTHING))), F.array(F.lit(None).cast("string"), linked("events", F.col(side))))
        for at, side in ((1, "upstream"), (2, "downstream"))
    ]
    return reduce(DataFrame.unionByName, [title, *ends, heads, filled])


def evidence_workbook(cells: DataFrame, headers: DataFrame, kers: DataFrame, members: DataFrame, aops: DataFrame, summary: DataFrame, selected: list[str], links: str) -> DataFrame:
    """All sheets of the workbook on harmonized evidence as rows (place, sheet, row_ix, values, links, head).

    ``headers``: ker_id, field, header, harmonized; ``summary``: metric, value.
    """
    harmonizable = harmonizable_fields(headers).select("ker_id").distinct()
    told = placed(summary, [F.col("metric")])
    sheets = [_headed(cells, 0, "Summary", ("", "Value")), _rows(told, 0, "Summary", F.col("place"), F.array("metric", "value"))]
    ordered = pathway_order(members, harmonizable, aops, selected)
    shown = F.array(F.concat(F.lit("AOP "), "aop_id"), "title", "selected", "status", F.col("n_kers").cast("string"), "ker_ids")
    sheets += [_headed(cells, 1, "AOPs_with_harmonizable_KERs", PATHWAY_HEADS), _rows(ordered, 1, "AOPs_with_harmonizable_KERs", F.col("place"), shown, F.array(F.concat(F.lit(f"{links}/aops/"), "aop_id")))]
    for place, name, found in ((2, "harmonized_headers", F.col("harmonized").isNotNull()), (3, "unmatched_headers", F.col("harmonized").isNull())):
        listed = placed(headers.filter(found).select("header").distinct(), [F.col("header")])
        sheets += [_headed(cells, place, name, (name,)), _rows(listed, place, name, F.col("place"), F.array("header"))]
    numbered = placed(harmonizable.join(kers, "ker_id", "left"), [F.asc_nulls_last(F.col("ker_id").try_cast("long")), F.col("ker_id")])
    ends = [F.coalesce(f"{side}_title", F.lit(NOTHING)) for side in ("upstream", "downstream")]
    address = F.array(F.concat(F.lit(f"{links}/relationships/"), F.col("ker_id").cast("string"), F.lit("#link_support")))
    sheets += [_headed(cells, 4, "harmonizable_kers", RELATION_HEADS), _rows(numbered, 4, "harmonizable_kers", F.col("place"), F.array(F.concat(F.lit("KER "), F.col("ker_id").cast("string")), *ends), address)]
    return reduce(DataFrame.unionByName, [*sheets, relation_sheets(cells, kers, links, 5)])
