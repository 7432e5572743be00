"""Queries of curated sheets, scores, headers and reports, each with the DuckDB SQL it must agree with.

Sheets: orders as headers (``AOP n``), their lines as events (``KE n``); the title is the part's
name, or one of the marks for excluded and missing titles.  Assays: parts; chemicals: suppliers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import evidence, fuzzy, scoring
from ..operators import graph, harmonize, review, search, sheets, workbook
from ..sources import json_documents, sinks, spreadsheet
from ..sources.shared import shared_dir
from . import queries as base
from .queries import _I, _K, _ORDER, LINE_ORDER, ORACLE_SQL, _registered, key_events, read, relationships
from .result_queries import _T, kers_with_titles

_TITLE = "CASE p_partkey % 5 WHEN 0 THEN 'E' WHEN 1 THEN 'nan' WHEN 2 THEN '' ELSE p_name END"


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, row_ix, header, title, target_family, references."""

    # Lines are numbered before the titles join them: the order of an order's lines is dealt without texts.
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", n.alias("n"))
    lines = lines.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_partkey"), "l_partkey", "left")
    events = lines.select((F.col("l_orderkey") % 97).alias("sheet"), (F.col("l_orderkey") * 1000 + F.col("n")).alias("row_ix"), F.concat(F.lit("KE "), F.col("l_partkey")).alias("header"), F.expr(_TITLE).alias("title"), F.col("p_brand").alias("target_family"), F.when(F.col("l_partkey") % 3 == 0, "nan").otherwise(F.col("p_type")).alias("references"))
    none = F.lit(None).cast("string")
    heads = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).alias("sheet"), (F.col("o_orderkey") * 1000).alias("row_ix"), F.concat(F.lit("AOP "), F.col("o_orderkey")).alias("header"), none.alias("title"), none.alias("target_family"), none.alias("references"))
    return heads.unionByName(events)


def sheet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbook.harmonized_events(sheet(spark, sf_dir), kept=("target_family", "references"))


_W = f"""l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS n, {_TITLE} AS title, p_brand, CASE WHEN l_partkey % 3 = 0 THEN 'nan' ELSE p_type END AS refs, p_partkey FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
v AS (SELECT l_orderkey % 97 AS sheet, l_orderkey * 1000 + n AS row_ix, n - 1 AS event_index, l_orderkey::VARCHAR AS aop_id, l_partkey::VARCHAR AS event_id, title, p_brand AS target_family, refs, p_partkey FROM l JOIN orders ON o_orderkey = l_orderkey QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY n DESC) = 1)"""


@_registered(f"WITH {_W} SELECT sheet, row_ix, event_index::INTEGER AS event_index, aop_id, event_id, title FROM v")
def sheet_harmonized_events(spark, sf_dir):
    return workbook.harmonized_events(sheet(spark, sf_dir))


@_registered(f"WITH {_W}, t AS (SELECT event_id, CASE WHEN title IN ('E', 'nan') OR title IS NULL THEN 'DROPPED' ELSE title END AS title FROM v) SELECT event_id, array_to_string(list(DISTINCT title ORDER BY title), '|') AS titles, count(DISTINCT title) > 1 AS conflict FROM t GROUP BY event_id")
def sheet_event_titles(spark, sf_dir):
    return workbook.harmonized_titles(sheet_events(spark, sf_dir)).withColumn("titles", F.array_join("titles", "|"))


@_registered(f"WITH {_W} SELECT aop_id, row_ix, title AS harmonized_event, event_id AS original_event_id FROM v WHERE title NOT IN ('', 'E', 'nan')")
def sheet_harmonized_aops(spark, sf_dir):
    return workbook.harmonized_aops(sheet_events(spark, sf_dir)).select("aop_id", "row_ix", F.col("title").alias("harmonized_event"), F.col("event_id").alias("original_event_id"))


@_registered(f"WITH {_W} SELECT aop_id, title, count(DISTINCT event_id) AS n_events FROM v WHERE title NOT IN ('', 'E', 'nan') GROUP BY ALL HAVING n_events > 1")
def sheet_merged_titles(spark, sf_dir):
    return workbook.merged_titles(workbook.harmonized_aops(sheet_events(spark, sf_dir)))


_VP = f"""{_W}, pr AS (SELECT o_orderkey AS pair, 'red widget' AS mie, o_orderkey::VARCHAR AS one, (o_orderkey + 1)::VARCHAR AS two FROM orders WHERE o_orderkey % 2 = 0),
sd AS (SELECT pair, mie, one AS aop_id, two AS other FROM pr UNION ALL SELECT pair, mie, two, one FROM pr), hv AS (SELECT v.*, pair, mie, other, lower(trim(title)) AS low FROM v JOIN sd USING (aop_id) WHERE title NOT IN ('', 'E', 'nan')),
sz AS (SELECT pair, aop_id, other, mie, count(*) AS n, count(DISTINCT low) AS titles, bool_or(low = mie) AS has_mie FROM hv GROUP BY ALL), fc AS (SELECT a.*, b.n AS n_other, b.titles AS titles_other FROM sz a JOIN sz b ON a.pair = b.pair AND a.other = b.aop_id),
ex AS (SELECT hv.pair, hv.aop_id, hv.title, hv.row_ix, row_number() OVER (PARTITION BY hv.pair, hv.aop_id ORDER BY hv.row_ix::VARCHAR) AS place, n - n_other AS most FROM hv JOIN fc ON fc.pair = hv.pair AND fc.aop_id = hv.aop_id AND n > n_other WHERE NOT EXISTS (FROM hv o WHERE o.pair = hv.pair AND o.aop_id = hv.other AND o.low = hv.low))"""


@_registered(f"WITH {_VP} SELECT 'merged' AS validation_type, pair, aop_id, title, NULL::BIGINT AS row_ix FROM hv GROUP BY pair, aop_id, title HAVING count(*) > 1 UNION ALL SELECT 'no_mie', pair, aop_id, mie, NULL FROM fc WHERE NOT has_mie UNION ALL SELECT 'count_mismatch', pair, aop_id, NULL, NULL FROM fc WHERE titles <> titles_other UNION ALL SELECT 'extra', pair, aop_id, title, row_ix FROM ex WHERE place <= most")
def sheet_pair_checks(spark, sf_dir):
    pairs = read(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("pair"), F.lit("red widget").alias("mie"), F.col("o_orderkey").cast("string").alias("one"), (F.col("o_orderkey") + 1).cast("string").alias("two"))
    return workbook.pair_checks(workbook.harmonized_aops(sheet_events(spark, sf_dir)), pairs)


def _enriched(spark, sf_dir):
    known = base._event_rows(spark, sf_dir).filter("ke_id % 11 <> 0")
    aops = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("aop_id"))
    return workbook.enriched_events(sheet_events(spark, sf_dir), known, aops)


_EN = f"{_W}, en AS (SELECT v.*, k.p_partkey IS NOT NULL AS event_match, k.p_name AS title_from_wiki, CASE k.p_size % 4 WHEN 0 THEN 'Tissue' WHEN 1 THEN 'Cellular' WHEN 2 THEN 'Organ' WHEN 3 THEN '' END AS lobo FROM v JOIN orders ON o_orderkey::VARCHAR = aop_id AND o_orderstatus <> 'P' LEFT JOIN part k ON k.p_partkey::VARCHAR = event_id AND k.p_partkey % 11 <> 0)"


@_registered(f"WITH {_EN} SELECT aop_id AS \"AOP ID\", event_index::VARCHAR AS \"Event Index\", row_ix::VARCHAR AS \"Row Index\", event_id AS \"Event ID\", coalesce(title_from_wiki, '') AS \"Title from Wiki\", coalesce(title, '') AS \"Harmonized Name\", CASE WHEN event_match THEN 'Yes' ELSE 'No' END AS \"Event Match\", coalesce(refs, '') AS \"References\", coalesce(target_family, '') AS \"Target Family\" FROM en")
def export_curated_events(spark, sf_dir):
    rows = _enriched(spark, sf_dir).withColumnsRenamed({"row_ix": "row_index", "title": "harmonized_event"})
    return sinks.exported(rows, sinks.FIELD_SETS["curated_event"])


@_registered(f"WITH {_EN} SELECT aop_id, count(*) AS total_events, count_if(event_match)::BIGINT AS matched_events, count_if(NOT event_match)::BIGINT AS unmatched_events, count_if(title = 'E')::BIGINT AS excluded_events, count_if(title = 'nan')::BIGINT AS nan_events FROM en GROUP BY aop_id")
def sheet_extraction_summary(spark, sf_dir):
    return workbook.extraction_summary(_enriched(spark, sf_dir))


def _set(expression: str, where: str = "true") -> str:
    return f"coalesce(array_to_string(list(DISTINCT {expression} ORDER BY {expression}) FILTER ({expression} IS NOT NULL AND {expression} <> '' AND {where}), ', '), '')"


@_registered(f"WITH {_EN} SELECT title AS \"Harmonized Title\", count(DISTINCT event_id)::VARCHAR AS \"Total Events\", (count(DISTINCT lobo) FILTER (lobo <> ''))::VARCHAR AS \"LOBO Count\", {_set('lobo')} AS \"LOBOs\", {_set('event_id')} AS \"Event IDs\", {_set('aop_id')} AS \"AOP IDs\", {_set('refs', "refs <> 'nan'")} AS \"References\", {_set('target_family')} AS \"Target Families\" FROM en WHERE title NOT IN ('E', 'nan') GROUP BY title")
def export_harmonized_summary(spark, sf_dir):
    return sinks.exported(workbook.harmonized_summary(_enriched(spark, sf_dir)), sinks.FIELD_SETS["harmonized_summary"])


# Assays, target families and chemicals.

_FAMILY = "CASE p_partkey % 6 WHEN 0 THEN 'GABA  A' WHEN 1 THEN p_brand || ' Receptors' WHEN 2 THEN ' NMDA R' WHEN 3 THEN p_type || ' Channels' WHEN 4 THEN 'GABA A Receptor' END"
_NORMAL = "CASE p_partkey % 6 WHEN 0 THEN 'GABA-A Receptor' WHEN 1 THEN p_brand || ' Receptor' WHEN 2 THEN 'NMDA Receptor' WHEN 3 THEN p_type || ' Channel' WHEN 4 THEN 'GABA-A Receptor' END"
_RELATION = "CASE p_partkey % 4 WHEN 0 THEN 'linked to AOPs ' || p_size || ' and ' || (p_size + 7) WHEN 1 THEN 'MIE the ' || p_name || ' and KE ' || lower(p_type) WHEN 2 THEN 'KE ' || p_name END"


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as assays: two or three to an endpoint id."""
    return read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 3).alias("aeid"), F.concat(F.lit("A"), F.col("p_partkey")).alias("endpoint_name"), F.expr(_FAMILY).alias("target_family"), F.expr(_RELATION).alias("relation"))


_AS = f"y AS (SELECT p_partkey // 3 AS aeid, 'A' || p_partkey AS name, {_NORMAL} AS family, p_partkey, p_size, p_name, p_type FROM part)"
_LISTS = "count(*) AS n_assays, array_to_string(list(name ORDER BY name), ',') AS assays, coalesce(array_to_string(list(DISTINCT family ORDER BY family) FILTER (family IS NOT NULL), ','), '') AS families"


def _shown(df):
    return df.withColumns({c: F.array_join(c, ",") for c in ("assays", "families")})


@_registered(f"SELECT p_partkey, {_FAMILY} AS raw, {_NORMAL} AS family FROM part")
def target_families(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(_FAMILY).alias("raw"))
    return rows.withColumn("family", evidence.target_family(F.col("raw")))


@_registered(f"WITH {_AS} SELECT aeid::VARCHAR AS key, {_LISTS} FROM y GROUP BY aeid")
def assays_by_aeid(spark, sf_dir):
    return _shown(workbook.assays_by(assays(spark, sf_dir), "aeid"))


@_registered(f"WITH {_AS}, z AS (SELECT *, unnest([p_size::VARCHAR, (p_size + 7)::VARCHAR]) AS key FROM y WHERE p_partkey % 4 = 0) SELECT key, {_LISTS} FROM z GROUP BY key")
def assays_by_aop(spark, sf_dir):
    return _shown(workbook.assays_by(assays(spark, sf_dir), "aop_ids"))


@_registered(f"WITH {_AS}, z AS (SELECT *, unnest(CASE p_partkey % 4 WHEN 1 THEN list_distinct([p_name, lower(p_type)]) ELSE [p_name] END) AS key FROM y WHERE p_partkey % 4 IN (1, 2)) SELECT key, {_LISTS} FROM z GROUP BY key")
def assays_by_description(spark, sf_dir):
    return _shown(workbook.assays_by(assays(spark, sf_dir), "ke_descriptions"))


@_registered(f"WITH {_AS}, g AS (SELECT aeid::VARCHAR AS key, count(*) AS a, count(DISTINCT family) AS f FROM y GROUP BY aeid) SELECT key, CASE WHEN a > 1 THEN 'assays' ELSE 'families' END AS several FROM g WHERE a > 1 OR f > 1")
def aeid_conflicts(spark, sf_dir):
    return workbook.aeid_conflicts(workbook.assays_by(assays(spark, sf_dir), "aeid"))


def _family_sources(spark, sf_dir):
    rows = assays(spark, sf_dir).withColumn("n", F.substring("endpoint_name", 2, 9).cast("long"))
    return rows.filter("n % 10 < 5"), rows.filter("n % 10 >= 4 and n % 10 < 8"), rows.filter("n % 10 > 6 or n % 10 = 0")


_FS = f"f AS (SELECT {_NORMAL} AS family, bool_or(p_partkey % 10 < 5) AS s, bool_or(p_partkey % 10 >= 4 AND p_partkey % 10 < 8) AS a, bool_or(p_partkey % 10 > 6 OR p_partkey % 10 = 0) AS h FROM part GROUP BY 1 HAVING family IS NOT NULL)"
_SAID = {"|": "OR", "&": "AND"}
_FAMILY_SQL = " UNION ALL ".join(f"SELECT '{name}' AS category, family FROM f WHERE ({' '.join(_SAID.get(c, c) for c in into)})" + (f" AND NOT ({' '.join(_SAID.get(c, c) for c in out)})" if out else "") for name, (into, out) in workbook.FAMILY_SETS.items())


@_registered(f"WITH {_FS} {_FAMILY_SQL}")
def target_family_sets(spark, sf_dir):
    return workbook.family_sets(*_family_sources(spark, sf_dir))


@_registered(f"WITH {_AS}, e AS (SELECT lower(family) AS k, array_to_string(list(DISTINCT p_name ORDER BY p_name), ',') AS h_events FROM y WHERE p_partkey % 10 < 5 AND family IS NOT NULL GROUP BY 1), a AS (SELECT lower(family) AS k, array_to_string(list(aeid::VARCHAR ORDER BY aeid::VARCHAR), ',') AS assays FROM y WHERE p_partkey % 10 >= 5 AND family IS NOT NULL GROUP BY 1), n AS (SELECT DISTINCT upper(family) AS target_family FROM y WHERE family IS NOT NULL) SELECT target_family, h_events, assays FROM n LEFT JOIN e ON e.k = lower(target_family) LEFT JOIN a ON a.k = lower(target_family) WHERE NOT regexp_matches(target_family, 'GABA')")
def family_events_and_assays(spark, sf_dir):
    rows = assays(spark, sf_dir).withColumn("n", F.substring("endpoint_name", 2, 9).cast("long")).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("title")), "n")
    families = rows.select(F.upper(evidence.target_family(F.col("target_family"))).alias("target_family")).filter("target_family is not null and not contains(target_family, 'GABA')").distinct()
    out = workbook.map_target_families(families, rows.filter("n % 10 < 5"), rows.filter("n % 10 >= 5"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("h_events", "assays")})


@_registered("""WITH r AS (SELECT p_brand AS target_family, min(p_partkey) AS ord, list(DISTINCT p_name ORDER BY p_name) FILTER (p_partkey % 3 = 0) AS h FROM part GROUP BY 1), x AS (SELECT r.*, p_name AS event, p_partkey AS mid, p_size % 2 = 0 AS ok, CASE WHEN p_size % 5 = 0 THEN p_type END AS sug FROM r JOIN part ON p_partkey = ord),
w AS (SELECT target_family, ord, 0 AS rank, 'harmonized_workbook' AS source, unnest(coalesce(h, [])) AS title, NULL AS event_id FROM x UNION ALL SELECT target_family, ord, 1, 'fuzzy_matched', event, mid::VARCHAR FROM x WHERE ok UNION ALL SELECT target_family, ord, 2, 'manual_suggestion', sug, NULL FROM x WHERE sug IS NOT NULL),
f AS (SELECT p_brand AS target_family, list(DISTINCT 'A' || p_size) AS assays FROM part GROUP BY 1), b AS (SELECT title, arg_min({'i': event_id, 's': source}, (ord, rank)) AS f, array_to_string(list_sort(list_distinct(flatten(list(assays)))), ',') AS assays, array_to_string(list(DISTINCT target_family ORDER BY target_family), ',') AS families FROM w JOIN f USING (target_family) GROUP BY title) SELECT title, f.i AS event_id, f.s AS source, assays, families FROM b""")
def events_bridged_to_assays(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    heads = part.groupBy(F.col("p_brand").alias("target_family")).agg(F.min("p_partkey").alias("ord"), F.array_sort(F.collect_set(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")))).alias("h_events"))
    one = part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("event"), F.col("p_partkey").alias("matched_event_id"), (F.col("p_size") % 2 == 0).alias("human_verified"), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).alias("suggested_event"))
    families = part.groupBy(F.col("p_brand").alias("target_family")).agg(F.collect_set(F.concat(F.lit("A"), F.col("p_size"))).alias("assays"))
    return _shown(workbook.bridged_events(heads.join(one, "ord"), families))


_DIRECTION = "CASE s_suppkey % 4 WHEN 0 THEN 'Positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'positive ' END"
_PUBCHEM = "CASE s_suppkey % 5 WHEN 0 THEN ' yes ' WHEN 1 THEN 'no' WHEN 2 THEN 'N' WHEN 3 THEN 'maybe' END"


@_registered(f"WITH c AS (SELECT (s_suppkey % 70)::VARCHAR AS casrn, {_DIRECTION} AS d, {_PUBCHEM} AS p FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 70 ORDER BY s_suppkey DESC) = 1) SELECT casrn, d AS direction_of_effect, coalesce(lower(d) IN ('positive', 'negative'), false) AS expected_direction, CASE WHEN contains(upper(p), 'Y') THEN 'Yes' WHEN upper(trim(p)) IN ('N', 'NO') THEN 'No' ELSE 'Unknown' END AS pubchem_evidence FROM c")
def chemicals_by_casrn(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_ix"), (F.col("s_suppkey") % 70).cast("string").alias("casrn"), F.expr(_DIRECTION).alias("direction_of_effect"), F.expr(_PUBCHEM).alias("pubchem_evidence"), F.col("s_name").alias("literature_citation"))
    return workbook.normalized_chemicals(rows).drop("citation")


# Scores of relationships and pathways.

_TEXTS = {"description": "ut", "modulating_factors": "CASE WHEN length(ut) % 2 = 0 THEN ' ' ELSE ut END", "doa_free_text": "dt", "uncertainties": "CASE WHEN length(dt) % 3 = 0 THEN dt END", "time_scale": "CASE WHEN length(ut) % 5 = 0 THEN '' ELSE 'x' END"}


@_registered(f"WITH {_K}, {_T}, f AS (SELECT ker_id, {', '.join(f"(coalesce(length(trim({x})), 0) > 0)::INT AS f_{n}" for n, x in _TEXTS.items())} FROM k2), g AS (SELECT ker_id, {' + '.join(f'f_{n}' for n in _TEXTS)} + 5 AS raw_score FROM f) SELECT ker_id, raw_score, 17 AS max_score, round(100.0 * raw_score / 17, 2) AS percent FROM g")
def ker_completion(spark, sf_dir):
    rows = kers_with_titles(spark, sf_dir).withColumnsRenamed({"upstream_title": "ut", "downstream_title": "dt"})
    rows = rows.select("ker_id", F.array(F.col("aop_id").cast("string")).alias("aop_ids"), *[F.expr(x).alias(n) for n, x in _TEXTS.items()])
    return rows.select("ker_id", scoring.ker_completion(rows).alias("s")).select("ker_id", "s.raw_score", "s.max_score", "s.percent")


@_registered("""WITH e AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS new, o_orderpriority, o_orderstatus, coalesce(n, 0) AS n FROM orders LEFT JOIN e ON l_orderkey = o_orderkey),
s AS (SELECT o_orderkey AS aop_id, 1 + (o_orderstatus <> 'P')::INT + (o_orderstatus = 'F')::INT + (new AND o_orderstatus = 'O')::INT + (n >= 3)::INT AS raw_score, CASE WHEN new THEN 21 ELSE 19 END AS max_score FROM o) SELECT aop_id, raw_score, max_score, round(100.0 * raw_score / max_score, 2) AS percent FROM s""")
def aop_completion(spark, sf_dir):
    """Title always there; abstract blank HTML for ``P``; background an image for ``F``; the strategy counts under the new handbook only."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    events = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("event_ids"))
    rows = read(spark, sf_dir, "orders").join(events, F.col("l_orderkey") == key, "left").select(
        key.alias("aop_id"), F.col("o_orderpriority").alias("title"), F.when(status == "P", "<p>&nbsp;</p>").otherwise("<p>x</p>").alias("abstract"), F.when(status == "F", '<p><img src="x"/></p>').otherwise("<p> </p>").alias("background"),
        F.when(status == "O", "grown").alias("development_strategy"), F.when(key % 2 == 0, 2.5).otherwise(2.0).alias("handbook_version"), "event_ids",
    )
    return rows.select("aop_id", scoring.aop_completion(rows).alias("s")).select("aop_id", "s.raw_score", "s.max_score", "s.percent")


# Headers of evidence tables.

_HEADER = "CASE l_linenumber WHEN 1 THEN 'KE up' WHEN 2 THEN 'KE down' WHEN 3 THEN 'Ref' WHEN 4 THEN 'Species ' WHEN 5 THEN 'the follicles' WHEN 6 THEN '#####' ELSE 'Dose' END"
_NAME = "CASE l_linenumber WHEN 1 THEN 'Upstream Key Event' WHEN 2 THEN 'Downstream Key Event' WHEN 3 THEN 'References' WHEN 4 THEN 'Species' WHEN 5 THEN 'Upstream Key Event' WHEN 7 THEN 'Dose' END"


def _cells(spark, sf_dir):
    """A table for each order: a column for each kind of line, a row for each of its suppliers' last digit."""
    # Dealt by order, which all that follows groups by; the line's number tells the header.
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey").cast("string")).alias("value"))
    return rows.select(F.col("l_orderkey").alias("ker_id"), F.lit("empirical_support").alias("field"), F.lit(0).alias("table_ix"), F.lit(0).alias("row_ix"), F.col("l_linenumber").alias("col_ix"), F.expr(_HEADER).alias("header"), "value")


def _titled(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ker_id"), F.lit("ovarian follicle loss").alias("upstream_title"), F.lit("9999999").alias("downstream_title"))


_CE = f"c AS (SELECT l_orderkey AS ker_id, l_linenumber AS n, {_HEADER} AS header, {_NAME} AS harmonized, min(l_partkey::VARCHAR) AS value FROM lineitem GROUP BY ALL), ok AS (SELECT ker_id FROM c GROUP BY 1 HAVING bool_or(harmonized = 'Upstream Key Event') AND bool_or(n = 2) AND bool_or(n = 3))"


@_registered(f"WITH {_CE} SELECT ker_id, 'empirical_support' AS field, header, harmonized FROM c")
def matched_headers(spark, sf_dir):
    return harmonize.matched_headers(_cells(spark, sf_dir), _titled(spark, sf_dir))


@_registered(f"WITH {_CE} SELECT ker_id, 'empirical_support' AS field, 0 AS table_ix, 0 AS row_ix, coalesce(harmonized, header) AS name, arg_max(value, n) AS value FROM c SEMI JOIN ok USING (ker_id) GROUP BY ALL")
def harmonized_tables(spark, sf_dir):
    return harmonize.harmonized_cells(_cells(spark, sf_dir), _titled(spark, sf_dir)).drop("col_ix")


@_registered(f"WITH {_CE}, h AS (SELECT o_custkey AS aop_id, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders JOIN ok ON ker_id = o_orderkey GROUP BY 1) SELECT row_number() OVER (ORDER BY len(ids) DESC, aop_id) AS place, aop_id::VARCHAR AS aop_id, c_name AS title, CASE WHEN aop_id IN (1, 7) THEN 'Y' ELSE '' END AS selected, c_mktsegment AS status, len(ids)::INTEGER AS n_kers, array_to_string(ids, ', ') AS ker_ids FROM h JOIN customer ON c_custkey = aop_id")
def pathway_sheet(spark, sf_dir):
    """Customers as pathways, their orders as relationships: those with harmonizable ones in the order of their sheet."""
    harmonizable = harmonize.harmonizable_fields(harmonize.matched_headers(_cells(spark, sf_dir), _titled(spark, sf_dir))).select("ker_id")
    members = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("aop_id"), F.col("o_orderkey").alias("ker_id"))
    aops = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("aop_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("status"))
    return sheets.pathway_order(members, harmonizable, aops, ["1", "7"])


_LIKE = "CASE WHEN n % 3 = 0 THEN 'Observed ' || p_name || ' up' WHEN n % 3 = 1 THEN p_name || ' level' ELSE 'ke: ' || p_name END"


@_registered()
def headers_by_likeness(spark, sf_dir):
    """Headers that only their likeness to a title of the relationship's events tells: names of parts with a word more."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ker_id"), (F.col("p_partkey") % 3).alias("n"), "p_name", "p_type")
    cells = parts.select("ker_id", F.lit("weight_of_evidence").alias("field"), F.expr(_LIKE).alias("header"))
    titles = parts.select("ker_id", F.when(F.col("ker_id") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("upstream_title"), F.concat_ws(" ", "p_name", F.lit("change")).alias("downstream_title"))
    return harmonize.matched_headers(cells, titles)


@_registered("SELECT row_number() OVER (ORDER BY coalesce(CASE WHEN p_size % 4 > 0 THEN p_size / 50.0 END, 0) DESC, p_partkey::VARCHAR) AS place, p_partkey::VARCHAR AS target_family, CASE WHEN p_size % 4 > 0 THEN p_size / 50.0 END AS match_score FROM part")
def families_by_score(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("target_family"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") / 50.0).alias("match_score"))
    return sheets.ranked_families(rows)


_SHEET = "s AS (SELECT n_nationkey, n_name, s_suppkey, s_name, s_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey)::INTEGER AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


@_registered(f"WITH {_SHEET} SELECT n_name AS sheet, r AS row_ix, 0 AS col_ix, s_suppkey::VARCHAR AS value FROM s UNION ALL SELECT n_name, r, 1, s_name FROM s UNION ALL SELECT n_name, r, 2, s_acctbal::DECIMAL(12, 2)::VARCHAR FROM s UNION ALL SELECT DISTINCT n_name, 0, c, h FROM s, (VALUES (0, 'Key'), (1, 'Name'), (2, 'Balance')) t(c, h)")
def workbook_cells(spark, sf_dir):
    """Suppliers as a workbook, a sheet for each nation: written, read again, cell by cell."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("sheet"))
    number = F.row_number().over(Window.partitionBy("place").orderBy("s_suppkey"))
    held = read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("place")).withColumn("row_ix", number)
    body = held.select("place", "sheet", "row_ix", F.array(F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("decimal(12,2)").cast("string")).alias("values"))
    heads = held.select("place", "sheet").distinct().select("place", "sheet", F.lit(0).alias("row_ix"), F.array(F.lit("Key"), F.lit("Name"), F.lit("Balance")).alias("values"))
    path = f"{shared_dir(spark)}/suppliers-{uuid.uuid4().hex}.xlsx"
    spreadsheet.write_workbook(heads.unionByName(body), path)
    return spreadsheet.read_cells(spark, path)


@_registered(f"WITH {_CE} SELECT count(DISTINCT ker_id) AS kers, (SELECT count(*) FROM ok) AS harmonizable_kers, count(DISTINCT CASE WHEN harmonized IS NOT NULL THEN header END) AS harmonized_headers, count(DISTINCT CASE WHEN harmonized IS NULL THEN header END) AS other_headers FROM c")
def header_summary(spark, sf_dir):
    return harmonize.harmonization_summary(harmonize.matched_headers(_cells(spark, sf_dir), _titled(spark, sf_dir)))


# Reviews, orders and reports.

@_registered("WITH m AS (SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_size / 50.0 END AS score FROM part), d AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size % 2 = 0 END AS v, CASE WHEN p_partkey % 6 = 0 THEN p_name WHEN p_partkey % 6 = 1 THEN '' END AS s FROM part WHERE p_partkey % 4 <> 0) SELECT count(*) AS total, count(v) AS reviewed, count(*) - count(v) AS skipped, count_if(v)::BIGINT AS accepted, count_if(NOT v)::BIGINT AS rejected, count_if(coalesce(s, '') <> '')::BIGINT AS suggested FROM m LEFT JOIN d USING (p_partkey)")
def match_review_summary(spark, sf_dir):
    return fuzzy.review_summary(_reviewed(spark, sf_dir))


def _reviewed(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    matches = part.select(F.col("p_partkey").alias("term"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") / 50.0).alias("match_score"))
    decisions = part.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("term"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") % 2 == 0).alias("human_verified"), F.when(F.col("p_partkey") % 6 == 0, F.col("p_name")).when(F.col("p_partkey") % 6 == 1, "").alias("suggested_match"))
    return fuzzy.reviewed(matches, decisions, 0.5)


@_registered("SELECT p_partkey AS term, CASE WHEN p_size % 4 > 0 THEN p_size / 50.0 END AS match_score, coalesce(p_size % 4 > 0 AND p_size / 50.0 < 0.5, false) AS needs_review FROM part")
def matches_to_review(spark, sf_dir):
    return _reviewed(spark, sf_dir).select("term", "match_score", "needs_review")


@_registered("WITH m AS (SELECT CASE WHEN p_size % 4 > 0 THEN p_size / 50.0 END AS s FROM part) SELECT count(*) AS total, count(s) AS matched, count(*) - count(s) AS unmatched, 100.0 * count(s) / greatest(count(*), 1) AS match_rate, coalesce(avg(s), 0) AS average_score FROM m")
def match_metrics(spark, sf_dir):
    return fuzzy.match_metrics(read(spark, sf_dir, "part").select(F.when(F.col("p_size") % 4 > 0, F.col("p_size") / 50.0).alias("match_score")))


@_registered(f"WITH {_I} SELECT ke_id, bounded + aops AS integration_score, row_number() OVER (ORDER BY bounded + aops DESC, ke_id) AS place FROM b")
def integration_places(spark, sf_dir):
    ranked = base._ranked(spark, sf_dir).select("ke_id", "integration_score")
    return graph.placed(ranked, [F.desc("integration_score"), F.col("ke_id")])


@_registered("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS by_number, row_number() OVER (ORDER BY o_orderkey::VARCHAR DESC) AS by_text FROM orders")
def id_orders(spark, sf_dir):
    """Ids as numbers ascending, and as text descending: the two orders of exports."""
    ids = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    numbered = graph.placed(ids, [F.col("id")], "by_number")
    return numbered.join(graph.placed(ids, [F.desc(F.col("id").cast("string"))], "by_text"), "id")


@_registered("WITH v AS (SELECT o_orderpriority AS p, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1) SELECT p AS source, n AS variants, row_number() OVER (ORDER BY n DESC, p) AS place FROM v")
def sources_by_variants(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count_distinct("o_custkey").alias("variants"))
    return graph.placed(rows, [F.desc("variants"), F.col("source")])


@_registered(f"WITH {_I}, st AS (SELECT round(avg(percent), 2) AS a, count(*) AS n, count_if(has_method)::BIGINT AS m FROM b) SELECT 'total_events' AS metric, n::VARCHAR AS value FROM st UNION ALL SELECT 'average_percent', printf('%.2f', a) FROM st UNION ALL SELECT 'with_methods', m::VARCHAR FROM st")
def statistics_as_rows(spark, sf_dir):
    stats = base.event_summary_stats(spark, sf_dir).select("total_events", "average_percent", "with_methods")
    return sinks.unpivoted(stats)


@_registered("SELECT '| ' || c_custkey || ' | ' || replace(c_name, '#', '\\|') || ' | ' || CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_mktsegment END || ' |' AS line FROM customer")
def markdown_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.translate("c_name", "#", "|").alias("c_name"), F.when(F.col("c_nationkey") % 3 != 0, F.concat(F.col("c_mktsegment"), F.lit("\n"))).alias("seg"))
    return sinks.markdown_lines(rows)


@_registered(r"WITH t AS (SELECT p_partkey AS entity_id, replace(p_name, 'red ', '') AS text FROM part) SELECT entity_id, 'title' AS field, 'red' AS term FROM t WHERE regexp_matches(text, '\bred\b') UNION ALL SELECT entity_id, 'title', 'widget' FROM t WHERE regexp_matches(text, '\bwidget\b')")
def search_without_passages(spark, sf_dir):
    texts = key_events(spark, sf_dir).select(F.col("ke_id").alias("entity_id"), F.lit("title").alias("field"), F.col("title").alias("text"))
    return search.term_matches(search.dropping_content(texts, "title", ["red "]), ["red", "widget"]).drop("term_ord")


@_registered("SELECT p_partkey AS ke_id FROM part ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) ON l_partkey = p_partkey WHERE p_size > 40")
def events_in_no_pathway(spark, sf_dir):
    wanted = read(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("ke_id"))
    return graph.missing_ids(wanted, read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("ke_id")), "ke_id")


@_registered(f"WITH {_K} SELECT count(*) AS kers, count(DISTINCT aop_id) AS aops, count_if(upstream = downstream)::BIGINT AS self_loops FROM k")
def relationship_totals(spark, sf_dir):
    rows = relationships(spark, sf_dir)
    return rows.agg(F.count("*").alias("kers"), F.count_distinct("aop_id").alias("aops"), F.count_if(F.col("upstream") == F.col("downstream")).alias("self_loops"))




_NESTED = "entity_id bigint, title string, flags struct<new: boolean, score: double>, lines array<struct<n: int, part: bigint>>, tags array<string>"


@_registered("""WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS parts, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1)
SELECT o_orderkey AS entity_id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority ELSE '' END AS title, o_orderkey % 2 = 0 AS new, coalesce(n, 0)::INTEGER AS n_lines, coalesce(parts, 0) AS parts, coalesce('["' || array_to_string(flags, '","') || '"]', '') AS tags FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def json_round_trip(spark, sf_dir):
    """Orders as nested JSON documents with sets and empty cells: written, read again with a declared schema."""
    line = F.struct(F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").cast("bigint").alias("part"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"), F.collect_set("l_returnflag").alias("tags"))
    flags = F.struct((F.col("o_orderkey") % 2 == 0).alias("new"), F.lit(0.5).alias("score"))
    rows = read(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    title = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority"))
    path = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}.json"
    json_documents.write_json(rows.select(F.col("o_orderkey").alias("entity_id"), title.alias("title"), flags.alias("flags"), "lines", "tags"), path, sets=["tags"])
    back = json_documents.read_json(spark, path, _NESTED)
    parts = F.aggregate(F.coalesce("lines", F.array().cast("array<struct<n:int,part:bigint>>")), F.lit(0).cast("bigint"), lambda a, x: a + x["part"])
    return back.select("entity_id", json_documents.json_cell(F.col("title"), "string").alias("title"), "flags.new", F.greatest(F.size("lines"), F.lit(0)).alias("n_lines"), parts.alias("parts"), json_documents.json_cell(F.col("tags"), "array<string>").alias("tags"))


@_registered(f"WITH {_K}, {_T} SELECT ker_id FROM k2 WHERE NOT coalesce(ut = dt, false)")
def kers_without_tables(spark, sf_dir):
    rows = kers_with_titles(spark, sf_dir)
    return scoring.with_tables(rows.withColumn("has_any_tables", F.col("upstream_title") == F.col("downstream_title")), tables=False).select("ker_id")


def _judged(spark, sf_dir):
    """Parts as events with a level and a description, some without."""
    level, told = F.when(F.col("p_size") % 7 > 0, F.col("p_type")), F.when(F.col("p_size") % 5 > 0, F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ke_id"), level.alias("level_of_biological_organization"), told.alias("description"))


def _length_judge():
    """A judge by rule: it goes by the length of the description."""

    def ask(ke_id: str, level: str, text: str) -> dict:
        if len(text) % 11 == 10:
            raise ValueError("no answer")
        return {"assigned_level_fits": len(text) % 3 > 0, "best_fit_level": "Tissue" if len(text) % 2 else "cannot tell", "spans_multiple_levels": len(text) % 4 == 1}

    return ask


@_registered("""WITH x AS (SELECT p_partkey::VARCHAR AS ke_id, CASE WHEN p_size % 7 > 0 THEN p_type END AS level, CASE WHEN p_size % 5 > 0 THEN p_name ELSE '' END AS text FROM part), v AS (SELECT *, length(text) AS n FROM x)
SELECT * FROM (SELECT ke_id, CASE WHEN text = '' OR level IS NULL THEN 'unchecked' WHEN n % 11 = 10 THEN 'error' WHEN n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN 'note' ELSE 'flag' END WHEN n % 4 = 1 THEN 'flag' END AS severity,
CASE WHEN text = '' THEN 'no description' WHEN level IS NULL THEN 'no level is assigned' WHEN n % 11 = 10 THEN 'ValueError: no answer' WHEN n % 3 = 0 AND n % 2 = 0 THEN 'the description does not tell whether ' || level || ' fits' WHEN n % 3 = 0 THEN 'the description reads as Tissue, not ' || level ELSE level || ' fits, but the description spans several levels' END AS message,
CASE WHEN text <> '' AND level IS NOT NULL AND n % 11 <> 10 AND n % 2 = 1 AND (n % 3 = 0 OR n % 4 = 1) THEN 'Tissue' END AS best_fit_level FROM v) WHERE severity IS NOT NULL""")
def reviewed_levels(spark, sf_dir):
    """Parts as events, reviewed with a table of verdicts: the second run asks nothing and finds the same."""
    events = _judged(spark, sf_dir)
    path, levels = f"{shared_dir(spark)}/verdicts-{uuid.uuid4().hex}", {"ECONOMY": "cheap", "SMALL": "little"}
    review.resumed_review(events, _length_judge, levels, path)
    return review.resumed_review(events, _length_judge, levels, path).drop("description_truncated")


def _exported(columns: str, source: str):
    """A query of one exported table: its field set over the table, its SQL over that of the table."""
    return _registered(f"WITH source AS ({ORACLE_SQL[source]}) SELECT {columns} FROM source")


_LISTED = "replace(assays, ',', ', ') AS \"Assays\", replace(families, ',', ', ') AS \"Target Families\""


def _assays_exported(spark, sf_dir, by: str, name: str, fields: str):
    rows = workbook.assays_by(assays(spark, sf_dir), by).select(F.col("key").alias(name), "assays", F.col("families").alias("target_families"))
    return sinks.exported(rows, sinks.FIELD_SETS[fields])


@_exported(f"key AS \"AEID\", {_LISTED}", "assays_by_aeid")
def export_assays_by_aeid(spark, sf_dir):
    return _assays_exported(spark, sf_dir, "aeid", "aeid", "assays_by_aeid")


@_exported(f"key AS \"AOP ID\", {_LISTED}", "assays_by_aop")
def export_assays_by_aop(spark, sf_dir):
    return _assays_exported(spark, sf_dir, "aop_ids", "aop_id", "aop_id_mapping")


@_exported(f"key AS \"KE Description\", {_LISTED}", "assays_by_description")
def export_assays_by_description(spark, sf_dir):
    return _assays_exported(spark, sf_dir, "ke_descriptions", "ke_description", "ke_description_mapping")


@_registered(f"WITH s AS ({ORACLE_SQL['target_family_sets']}) SELECT category AS \"Category\", array_to_string(list(DISTINCT family ORDER BY family), ', ') AS \"Target Families\" FROM s GROUP BY category")
def export_target_family_sets(spark, sf_dir):
    found = workbook.family_sets(*_family_sources(spark, sf_dir)).groupBy("category").agg(F.array_sort(F.collect_set("family")).alias("target_families"))
    return sinks.exported(found, sinks.FIELD_SETS["target_families_summary"])


@_registered(f"WITH v AS ({ORACLE_SQL['sheet_harmonized_events']}) SELECT DISTINCT coalesce(event_id, '') AS \"Event ID\", coalesce(title, '') AS \"Harmonized Event\" FROM v")
def export_event_to_harmonized(spark, sf_dir):
    found = workbook.harmonized_events(sheet(spark, sf_dir)).select("event_id", F.col("title").alias("harmonized_event")).distinct()
    return sinks.exported(found, sinks.FIELD_SETS["event_to_harmonized"])


@_registered(f"WITH v AS ({ORACLE_SQL['sheet_harmonized_events']}) SELECT coalesce(aop_id, '') AS \"AOP ID\", row_ix::VARCHAR AS \"Row Index\", coalesce(title, '') AS \"Harmonized Event\", coalesce(event_id, '') AS \"Original Event ID\" FROM v")
def export_aop_to_harmonized(spark, sf_dir):
    found = workbook.harmonized_events(sheet(spark, sf_dir)).select("aop_id", F.col("row_ix").alias("row_index"), F.col("title").alias("harmonized_event"), F.col("event_id").alias("original_event_id"))
    return sinks.exported(found, sinks.FIELD_SETS["aop_to_harmonized"])


_COUNTED = ", ".join(f"count_if(severity = '{kind}')::BIGINT AS {kind}" for kind in ("flag", "note", "unchecked", "error"))


@_registered(f"WITH f AS ({ORACLE_SQL['reviewed_levels']}) SELECT {_COUNTED} FROM f")
def findings_by_severity(spark, sf_dir):
    return review.severity_summary(review.reviewed_events(_judged(spark, sf_dir), _length_judge))


@_registered(f"WITH f AS ({ORACLE_SQL['reviewed_levels']}) SELECT 'level ' || coalesce(p_type, '') AS \"check\", {_COUNTED} FROM f JOIN part ON p_partkey::VARCHAR = ke_id GROUP BY 1")
def findings_by_check(spark, sf_dir):
    """Findings of the review by the kind of part."""
    kinds = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ke_id"), F.concat(F.lit("level "), F.coalesce("p_type", F.lit(""))).alias("check"))
    return review.check_summary(review.reviewed_events(_judged(spark, sf_dir), _length_judge).join(kinds, "ke_id"))
