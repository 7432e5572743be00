"""An XML snapshot of the knowledge base as typed tables, and dated Parquet copies of it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_APPLICABILITY = "`taxonomy` array<struct<`_taxonomy-id`:string>>, `sex` array<struct<`sex`:string>>, `life-stage` array<struct<`life-stage`:string>>"
_EVIDENCE = "`biological-plausibility` string, `emperical-support-linkage` string, `uncertainties-or-inconsistencies` string, `value` string"
#: Declared schemas by row tag: inference would turn single children into structs.
SCHEMAS = {
    "key-event": f"""`_id` string, `title` string, `short-name` string, `biological-organization-level` string, `description` string, `measurement-methodology` string,
        `evidence-supporting-taxonomic-applicability` string, `references` string, `organ-term` struct<`source`:string,`name`:string>, `cell-term` struct<`source`:string,`name`:string>,
        `biological-events` struct<`biological-event`:array<struct<`_process-id`:string,`_object-id`:string,`_action-id`:string>>>,
        `applicability` struct<{_APPLICABILITY.replace("` ", "`:")}>""",
    "key-event-relationship": f"""`_id` string, `title` struct<`upstream-id`:string,`downstream-id`:string>, `description` string, `references` string,
        `weight-of-evidence` struct<{_EVIDENCE.replace("` ", "`:")}>, `known-modulating-factors` string, `applicability` struct<{_APPLICABILITY.replace("` ", "`:")}>,
        `quantitative-understanding` struct<`description`:string,`response-response-relationship`:string,`time-scale`:string,`feedforward-feedback-loops`:string,`evidence-collection-strategy`:string>,
        `evidence-supporting-taxonomic-applicability` string""",
    "aop": f"""`_id` string, `title` string, `short-name` string, `abstract` string, `authors` string, `point-of-contact` string, `coaches` struct<`coach`:array<string>>,
        `handbook-version` string, `background` string, `development-strategy` string, `potential-applications` string, `references` string, `applicability` struct<{_APPLICABILITY.replace("` ", "`:")}>,
        `overall-assessment` struct<`description`:string,`applicability`:string,`key-event-essentiality-summary`:string,`weight-of-evidence-summary`:string,`quantitative-considerations`:string,`known-modulating-factors`:string>,
        `aop-stressors` struct<`aop-stressor`:array<struct<`_stressor-id`:string>>>, `status` struct<`wiki-license`:string,`oecd-status`:string>,
        `key-events` struct<`key-event`:array<struct<`_key-event-id`:string>>>,
        `molecular-initiating-event` array<struct<`_key-event-id`:string>>, `adverse-outcome` array<struct<`_key-event-id`:string,`examples`:string>>,
        `key-event-relationships` struct<`relationship`:array<struct<`_id`:string,`adjacency`:string>>>""",
    "aop-reference": "`_id` string, `_aop-wiki-id` string",
    "key-event-reference": "`_id` string, `_aop-wiki-id` string",
    "key-event-relationship-reference": "`_id` string, `_aop-wiki-id` string",
    "stressor-reference": "`_id` string, `_aop-wiki-id` string",
    "taxonomy": "`_id` string, `source` string, `source-id` string, `name` string",
    "biological-process": "`_id` string, `source` string, `source-id` string, `name` string",
    "biological-object": "`_id` string, `source` string, `source-id` string, `name` string",
    "biological-action": "`_id` string, `source` string, `source-id` string, `name` string",
}


#: Fields of a relationship that may hold evidence tables.
EVIDENCE_BLOCKS = ("weight_of_evidence", "empirical_support", "biological_plausibility", "quantitative_understanding")


def elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Rows of one tag that are elements of their own (nested mentions have no id); a broken file is an error."""
    return spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(SCHEMAS[tag]).load(path).filter("`_id` is not null")


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """(entity, xml_id, wiki_id) of all four kinds of entity."""
    kinds = {"AOP": "aop-reference", "KE": "key-event-reference", "KER": "key-event-relationship-reference", "Stressor": "stressor-reference"}
    parts = [elements(spark, path, tag).select(F.lit(k).alias("entity"), F.col("_id").alias("xml_id"), F.col("`_aop-wiki-id`").alias("wiki_id")) for k, tag in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _named(rows: DataFrame, ids: DataFrame, entity: str, column: str, name: str) -> DataFrame:
    own = ids.filter(F.col("entity") == entity).select(F.col("xml_id").alias(column), F.col("wiki_id").alias(name))
    return rows.join(own, column).drop(column)


def membership(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """aop_id, ke_id, role, ord (key events first, then initiating events, then adverse outcomes), examples (of adverse outcomes), aop_ord (the pathway's place in the export)."""
    aops = elements(spark, path, "aop").withColumn("aop_ord", F.monotonically_increasing_id())
    examples = lambda role: F.col("e.examples") if role == "AO" else F.lit(None).cast("string")
    lists = (("KE", "`key-events`.`key-event`", 0), ("MIE", "`molecular-initiating-event`", 1_000_000), ("AO", "`adverse-outcome`", 2_000_000))
    parts = [aops.select(F.col("_id").alias("aop_xml"), F.lit(role).alias("role"), "aop_ord", F.posexplode(column).alias("at", "e")).select("aop_xml", "role", (F.col("at") + base).alias("ord"), examples(role).alias("examples"), "aop_ord", F.col("e.`_key-event-id`").alias("ke_xml")) for role, column, base in lists]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _named(_named(rows, ids, "AOP", "aop_xml", "aop_id"), ids, "KE", "ke_xml", "ke_id")


def _terms(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``rows`` with sex, life stage and taxonomy terms of their applicability, without blanks or unknown ids."""
    taxa = elements(spark, path, "taxonomy").select(F.col("_id").alias("tax"), F.col("name").alias("taxon"))
    trimmed = lambda column, name: F.filter(F.transform(column, lambda x: F.trim(x[name])), lambda x: x != "")
    known = rows.select("_id", F.explode("applicability.taxonomy").alias("t")).select("_id", F.col("t.`_taxonomy-id`").alias("tax")).join(taxa, "tax").groupBy("_id").agg(F.array_sort(F.collect_set("taxon")).alias("taxonomy_terms"))
    return rows.join(known, "_id", "left").withColumns({"sex_terms": trimmed(F.col("applicability.sex"), "sex"), "life_stage_terms": trimmed(F.col("applicability.`life-stage`"), "life-stage")})


def event_components(spark: SparkSession, path: str) -> DataFrame:
    """Each event's components (``_id`` of the event): structs of process, object and action with source and term, in order."""
    rows = elements(spark, path, "key-event").select("_id", F.posexplode("`biological-events`.`biological-event`").alias("at", "e"))
    for kind in ("process", "object", "action"):
        part = elements(spark, path, f"biological-{kind}").select(F.col("_id").alias(f"{kind}_id"), F.struct("source", F.col("`source-id`").alias("source_id"), F.col("name").alias("term")).alias(f"biological_{kind}"))
        rows = rows.withColumn(f"{kind}_id", F.col(f"e.`_{kind}-id`")).join(part, f"{kind}_id", "left")
    one = F.struct("at", "biological_process", "biological_object", "biological_action")
    listed = rows.groupBy("_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return listed.select("_id", F.transform("c", lambda c: F.struct(*[c[f"biological_{k}"].alias(f"biological_{k}") for k in ("process", "object", "action")])).alias("ecs"))


def key_events(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Typed key events; terms without blanks or unknown ids, components with their terms."""
    rows = _terms(elements(spark, path, "key-event"), spark, path).join(event_components(spark, path), "_id", "left")
    out = rows.select(
        F.col("_id").alias("ke_xml"), "title", F.col("`short-name`").alias("short_name"), F.col("`biological-organization-level`").alias("level_of_biological_organization"), "description",
        F.col("`measurement-methodology`").alias("measurement_method"), F.col("`evidence-supporting-taxonomic-applicability`").alias("doa_free_text"), "references",
        F.col("`organ-term`.name").alias("organ_term"), F.col("`cell-term`.name").alias("cell_term"), "ecs", "sex_terms", "life_stage_terms", "taxonomy_terms",
    )
    return _named(out, ids, "KE", "ke_xml", "ke_id")


def aops(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Typed pathways: texts (blank where missing), status and license, handbook version, applicability, stressors, distinct events and relationships."""
    text = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    whole = "`overall-assessment`"
    rows = _terms(elements(spark, path, "aop"), spark, path).select(
        F.col("_id").alias("aop_xml"), text("title", "title"), text("`short-name`", "short_name"), text("abstract", "abstract"), text("authors", "authors"), text("`point-of-contact`", "point_of_contact"),
        F.filter(F.transform("coaches.coach", lambda x: F.trim(x)), lambda x: x != "").alias("coaches"), F.col("`handbook-version`").try_cast("double").alias("handbook_version"), text("background", "background"),
        text("`development-strategy`", "development_strategy"), F.col("sex_terms").alias("sex_applicability"), F.col("life_stage_terms").alias("life_stage_applicability"), F.col("taxonomy_terms").alias("taxonomy_applicability"),
        text(f"{whole}.description", "overall_assessment_description"), text(f"{whole}.applicability", "doa_free_text"), text(f"{whole}.`key-event-essentiality-summary`", "ke_essentiality"), text(f"{whole}.`weight-of-evidence-summary`", "woe_evidence"),
        text(f"{whole}.`quantitative-considerations`", "quantitative_considerations"), text(f"{whole}.`known-modulating-factors`", "known_modulating_factors"), text("`potential-applications`", "potential_applications"), "references",
        F.col("status.`oecd-status`").alias("oecd_status"), F.col("status.`wiki-license`").alias("wiki_license"),
    )
    named = _named(rows, ids, "AOP", "aop_xml", "aop_id")
    stressors = elements(spark, path, "aop").select(F.col("_id").alias("aop_xml"), F.explode("`aop-stressors`.`aop-stressor`").alias("s")).select("aop_xml", F.col("s.`_stressor-id`").alias("st_xml"))
    stressors = _named(_named(stressors, ids, "AOP", "aop_xml", "aop_id"), ids, "Stressor", "st_xml", "stressor_id").groupBy("aop_id").agg(F.array_sort(F.collect_set("stressor_id")).alias("stressors"))
    events = membership(spark, path, ids).groupBy("aop_id").agg(F.array_sort(F.collect_set("ke_id")).alias("event_ids"))
    kers = aop_relationships(spark, path, ids).groupBy("aop_id").agg(F.array_sort(F.collect_set("ker_id")).alias("kers"))
    joined = named.join(stressors, "aop_id", "left").join(events, "aop_id", "left").join(kers, "aop_id", "left")
    sizes = {f"num_{n}": F.coalesce(F.size(c), F.lit(0)) for n, c in (("events", "event_ids"), ("kers", "kers"), ("stressors", "stressors"))}
    return joined.withColumns({n: F.greatest(c, F.lit(0)) for n, c in sizes.items()})


def references(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """entity (aops, events, kers), entity_id and the references text of each that has one."""
    parts = []
    for entity, tag, kind in (("aops", "aop", "AOP"), ("events", "key-event", "KE"), ("kers", "key-event-relationship", "KER")):
        rows = elements(spark, path, tag).select(F.lit(entity).alias("entity"), F.col("_id").alias("xml"), "references")
        parts.append(_named(rows, ids, kind, "xml", "entity_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("references is not null")


def unmapped(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(entity, xml_id) that entities or mentions use and the id map lacks."""
    used = [elements(spark, path, tag).select(F.lit(kind).alias("entity"), F.col("_id").alias("xml_id")) for kind, tag in (("AOP", "aop"), ("KE", "key-event"), ("KER", "key-event-relationship"))]
    ends = elements(spark, path, "key-event-relationship").select(F.lit("KE").alias("entity"), F.explode(F.array("title.`upstream-id`", "title.`downstream-id`")).alias("xml_id"))
    mentions = elements(spark, path, "aop").select(F.lit("KER").alias("entity"), F.explode(F.transform("`key-event-relationships`.relationship", lambda r: r["_id"])).alias("xml_id"))
    rows = reduce(DataFrame.unionByName, [*used, ends, mentions]).filter("xml_id is not null").distinct()
    return rows.join(ids, ["entity", "xml_id"], "left_anti")


def checked(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The id map, if it has every kind of entity and every id in use; otherwise an error that names some."""
    kinds = {r["entity"] for r in ids.select("entity").distinct().collect()}
    if missing := sorted({"AOP", "KE", "KER", "Stressor"} - kinds):
        raise ValueError(f"the id map has no {', '.join(missing)}")
    if unknown := unmapped(spark, path, ids).limit(10).collect():
        raise KeyError(", ".join(f"{r['entity']} {r['xml_id']}" for r in unknown))
    return ids


def relationships(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Typed relationships: both ends (null where unknown), texts, evidence blocks, terms, whether any evidence holds a table."""
    quant, woe = "`quantitative-understanding`", "`weight-of-evidence`"
    rows = _terms(elements(spark, path, "key-event-relationship"), spark, path).select(
        F.col("_id").alias("ker_xml"), F.col("title.`upstream-id`").alias("u"), F.col("title.`downstream-id`").alias("d"), "description", "references", F.col("`known-modulating-factors`").alias("modulating_factors"),
        F.col("`evidence-supporting-taxonomic-applicability`").alias("doa_free_text"), F.col(f"{woe}.value").alias("weight_of_evidence"), F.col(f"{woe}.`emperical-support-linkage`").alias("empirical_support"),
        F.col(f"{woe}.`biological-plausibility`").alias("biological_plausibility"), F.col(f"{woe}.`uncertainties-or-inconsistencies`").alias("uncertainties"), F.col(f"{quant}.description").alias("quantitative_understanding"),
        F.col(f"{quant}.`response-response-relationship`").alias("response_relationship"), F.col(f"{quant}.`time-scale`").alias("time_scale"), F.col(f"{quant}.`feedforward-feedback-loops`").alias("known_loops"),
        F.col(f"{quant}.`evidence-collection-strategy`").alias("evidence_collection_strategy"), "sex_terms", "life_stage_terms", "taxonomy_terms",
    )
    tabled = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("<table")) for c in EVIDENCE_BLOCKS]
    rows = rows.withColumn("has_any_tables", reduce(or_, tabled))
    ends = ids.filter("entity = 'KE'")
    rows = rows.join(ends.select(F.col("xml_id").alias("u"), F.col("wiki_id").alias("upstream")), "u", "left").join(ends.select(F.col("xml_id").alias("d"), F.col("wiki_id").alias("downstream")), "d", "left")
    return _named(rows.drop("u", "d"), ids, "KER", "ker_xml", "ker_id")


def aop_relationships(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """aop_id, ker_id, adjacency, ord; unknown ids are left out."""
    rows = elements(spark, path, "aop").select(F.col("_id").alias("aop_xml"), F.posexplode("`key-event-relationships`.relationship").alias("ord", "r"))
    rows = rows.select("aop_xml", "ord", F.col("r.`_id`").alias("ker_xml"), F.col("r.adjacency").alias("adjacency"))
    return _named(_named(rows, ids, "AOP", "aop_xml", "aop_id"), ids, "KER", "ker_xml", "ker_id")


def validated(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Row counts; an empty table is an error."""
    counts = {name: df.count() for name, df in tables.items()}
    if empty := [n for n, k in counts.items() if k == 0]:
        raise ValueError(f"the snapshot has no {', '.join(sorted(empty))}")
    return counts


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _note(root: str, name: str, date: str) -> str:
    return f"{root}/_committed/{date}/{name}.json"


def committed(spark: SparkSession, root: str, name: str, date: str) -> dict | None:
    """What is noted of a table that was written whole: ``folder`` and ``rows``; None if it wasn't, or the note is torn."""
    files, place = _files(spark, _note(root, name, date))
    if not files.exists(place):
        return None
    try:
        found = json.loads("\n".join(r[0] for r in spark.read.text(_note(root, name, date)).collect()))
    except (ValueError, Py4JJavaError, PySparkException):  # a note that can't be read is none
        return None
    there, folder = _files(spark, f"{found['folder']}/_SUCCESS")
    return found if there.exists(folder) else None


def cached(spark: SparkSession, root: str, name: str, date: str, build: Callable[[], DataFrame], refresh: bool = False, required: bool = False) -> DataFrame:
    """The table of one snapshot date: read if it was written whole, else built.

    A table is written into a folder of its own, its rows counted in the same pass; a note of both
    makes it visible.  What a failed write leaves is never read, and a refresh replaces the
    former folder only when the new one is noted.  A ``required`` table without rows is an error.
    """
    known = committed(spark, root, name, date)
    if known is None or refresh:
        folder, seen = f"{root}/{name}/snapshot_date={date}/v-{uuid.uuid4().hex}", Observation()
        build().observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
        rows = seen.get["rows"]
        if required and not rows:
            files, place = _files(spark, folder)
            files.delete(place, True)
            raise ValueError(f"the snapshot of {date} has no {name}")
        files, place = _files(spark, _note(root, name, date))
        out = files.create(place, True)
        out.write(bytearray(json.dumps({"folder": folder, "rows": rows}).encode()))
        out.close()
        if known is not None:
            files, place = _files(spark, known["folder"])
            files.delete(place, True)
        known = {"folder": folder}
    return spark.read.parquet(known["folder"])


def checked_file(spark: SparkSession, path: str) -> str:
    """``path``, if it holds an export: the section of ids must be there."""
    section = "`aop-reference` array<struct<`_id`:string>>"
    if spark.read.format("xml").option("rowTag", "vendor-specific").schema(section).load(path).limit(1).count() == 0:
        raise ValueError(f"{path} is no export: it has no section vendor-specific")
    return path
