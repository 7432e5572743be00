"""Queries of exports, scoped searches and references, each with the DuckDB SQL it must agree with.

Texts: titles and types of parts (events), priorities of orders (pathways), a sentence from the
titles at both ends of a relationship.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, references, scoring
from ..operators import graph, scope, search
from ..sources import sinks
from . import queries as base
from .queries import _A, _C0, _E, _I, _K, _M, _S, _registered, key_events, membership, read, relationships

TERMS = ["widget", "cs:ECONOMY", "cs:economy", "urgent", "zebra"]
SCOPED = ["widget", "cs:ECONOMY", "urgent", "cs:Promo", "zebra"]
GROUPS = {"shape": ["widget", "gizmo"], "finish": ["red", "steel"], "grade": ["cs:PROMO", "urgent"]}
_ASKED = ["widget", "ECONOMY", "urgent", "Promo", "zebra", "gizmo", "red", "steel", "PROMO"]
_EXACT = {"ECONOMY", "Promo", "PROMO"}


def kers_with_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships with the titles of both ends; an end that isn't there has none."""
    titles = key_events(spark, sf_dir)
    rows = relationships(spark, sf_dir)
    for end in ("upstream", "downstream"):
        rows = rows.join(titles.select(F.col("ke_id").alias(end), F.col("title").alias(f"{end}_title")), end, "left")
    return rows


def ker_label(up, down):
    return F.concat_ws(" -> ", F.coalesce(up, F.lit("?")), F.coalesce(down, F.lit("?")))


def entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, entity_id, field, text of pathways, events and relationships."""
    rows = lambda df, kind, key, **fields: df.select(F.lit(kind).alias("entity"), F.col(key).cast("string").alias("entity_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in fields.items()])))
    aops = rows(read(spark, sf_dir, "orders"), "aops", "o_orderkey", title=F.col("o_orderpriority"))
    events = rows(read(spark, sf_dir, "part"), "events", "p_partkey", title=F.col("p_name"), measurement_method=F.col("p_type"))
    kers = rows(kers_with_titles(spark, sf_dir), "kers", "ker_id", description=F.concat_ws(" leads to ", "upstream_title", "downstream_title"))
    return aops.unionByName(events).unionByName(kers)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, entity_id, label: titles, and both ends of a relationship."""
    aops = read(spark, sf_dir, "orders").select(F.lit("aops").alias("entity"), F.col("o_orderkey").cast("string").alias("entity_id"), F.col("o_orderpriority").alias("label"))
    events = key_events(spark, sf_dir).select(F.lit("events").alias("entity"), F.col("ke_id").cast("string").alias("entity_id"), F.col("title").alias("label"))
    kers = kers_with_titles(spark, sf_dir).select(F.lit("kers").alias("entity"), F.col("ker_id").alias("entity_id"), ker_label(F.col("upstream_title"), F.col("downstream_title")).alias("label"))
    return aops.unionByName(events).unionByName(kers)


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("aop_id"))


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.owners(selected(spark, sf_dir), membership(spark, sf_dir), relationships(spark, sf_dir))


_T = "k2 AS (SELECT k.*, u.p_name AS ut, d.p_name AS dt FROM k LEFT JOIN part u ON u.p_partkey = upstream LEFT JOIN part d ON d.p_partkey = downstream)"
_X = f"""{_K}, {_T}, x AS (SELECT 'aops' AS entity, o_orderkey::VARCHAR AS entity_id, 'title' AS field, o_orderpriority AS text, o_orderpriority AS label FROM orders
UNION ALL SELECT 'events', p_partkey::VARCHAR, 'title', p_name, p_name FROM part UNION ALL SELECT 'events', p_partkey::VARCHAR, 'measurement_method', p_type, p_name FROM part
UNION ALL SELECT 'kers', ker_id, 'description', concat_ws(' leads to ', ut, dt), coalesce(ut, '?') || ' -> ' || coalesce(dt, '?') FROM k2)"""
_O = """sel AS (SELECT o_orderkey AS aop_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
o0 AS (SELECT 'aops' AS entity, aop_id::VARCHAR AS entity_id, aop_id FROM sel UNION SELECT 'events', l_partkey::VARCHAR, l_orderkey FROM lineitem JOIN sel ON aop_id = l_orderkey UNION SELECT 'kers', ker_id, k.aop_id FROM k JOIN sel USING (aop_id)),
o AS (SELECT entity, entity_id, list(aop_id ORDER BY aop_id) AS aop_ids FROM o0 GROUP BY ALL)"""
_HITS = f"{_X}, {_O}, w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {t in _EXACT})" for i, t in enumerate(_ASKED)) + r") v(term_ord, term, exact)), h AS (SELECT term_ord, term, x.*, aop_ids FROM x JOIN o USING (entity, entity_id), w WHERE regexp_matches(lower(text), '\b' || lower(term) || '\b') AND (NOT exact OR regexp_matches(text, '\b' || term || '\b')))"


def _scope_hits(spark, sf_dir):
    asked = scope.asked_terms(SCOPED, GROUPS)
    return scope.scope_hits(entity_texts(spark, sf_dir), owned(spark, sf_dir), labels(spark, sf_dir), asked), asked


@_registered(f"WITH {_X}, {_O}, n AS (SELECT DISTINCT entity, entity_id, true AS known FROM x) SELECT entity, count(known) AS in_scope, count(*) - count(known) AS missing FROM o LEFT JOIN n USING (entity, entity_id) GROUP BY entity")
def within_aop_scope(spark, sf_dir):
    return scope.scope_counts(owned(spark, sf_dir), entity_texts(spark, sf_dir))


@_registered(f"WITH {_K}, {_O} SELECT entity, entity_id, array_to_string(aop_ids, ',') AS aop_ids FROM o")
def within_aop_owners(spark, sf_dir):
    return owned(spark, sf_dir).withColumn("aop_ids", F.array_join(F.transform("aop_ids", lambda x: x.cast("string")), ","))


@_registered(f"WITH {_HITS}, e(entity) AS (VALUES ('aops'), ('events'), ('kers')) SELECT w.term, e.entity, count(h.term) AS fields FROM w CROSS JOIN e LEFT JOIN h ON h.term = w.term AND h.entity = e.entity GROUP BY ALL")
def within_aop_term_counts(spark, sf_dir):
    hits, asked = _scope_hits(spark, sf_dir)
    return scope.scope_term_counts(hits, asked)


@_registered(f"WITH {_HITS} SELECT term, CASE entity WHEN 'aops' THEN 'AOP' WHEN 'events' THEN 'KE' ELSE 'KER' END AS entity, entity_id AS id, label, array_to_string(aop_ids, ', ') AS aop_ids, field, text AS snippet FROM h")
def within_aop_matches(spark, sf_dir):
    return scope.match_rows(_scope_hits(spark, sf_dir)[0])


_GR = "g AS (SELECT * FROM (VALUES ('shape', 'widget', 0), ('shape', 'gizmo', 1), ('finish', 'red', 0), ('finish', 'steel', 1), ('grade', 'PROMO', 0), ('grade', 'urgent', 1)) v(grp, term, place)), r AS (SELECT grp, entity, entity_id, min(label) AS label, array_to_string(list(DISTINCT term ORDER BY term), ',') AS terms, array_to_string(list(DISTINCT field ORDER BY field), ',') AS fields FROM h JOIN g USING (term) GROUP BY grp, entity, entity_id)"


def _group_records(spark, sf_dir):
    return scope.group_records(_scope_hits(spark, sf_dir)[0], GROUPS)


@_registered(f"WITH {_HITS}, {_GR} SELECT n.grp, count(r.grp) AS records FROM (SELECT DISTINCT grp FROM g) n LEFT JOIN r USING (grp) GROUP BY n.grp")
def within_aop_group_counts(spark, sf_dir):
    return scope.group_counts(_group_records(spark, sf_dir), GROUPS)


@_registered(f"WITH {_HITS}, {_GR}, p(group_a, group_b) AS (VALUES ('shape', 'finish'), ('shape', 'grade'), ('finish', 'grade')) SELECT group_a, group_b, a.entity, a.entity_id, a.label, a.terms AS terms_a, b.terms AS terms_b, a.fields AS fields_a, b.fields AS fields_b FROM p JOIN r a ON a.grp = group_a JOIN r b ON b.grp = group_b AND b.entity = a.entity AND b.entity_id = a.entity_id")
def within_aop_co_occurrences(spark, sf_dir):
    met = scope.co_occurring_records(_group_records(spark, sf_dir), GROUPS)
    joined = {c: F.array_join(F.array_sort(c), ",") for c in ("terms_a", "terms_b", "fields_a", "fields_b")}
    return met.drop("aop_ids").withColumns(joined)


_TALLY = f"""{_HITS}, e(entity, shown, n) AS (VALUES ('aops', 'AOP', 1), ('events', 'KE', 2), ('kers', 'KER', 3)), c AS (SELECT w.term, e.shown, e.n, count(h.term) AS f FROM w CROSS JOIN e LEFT JOIN h ON h.term = w.term AND h.entity = e.entity GROUP BY ALL),
y AS (SELECT term, string_agg(f || ' ' || shown || ' field' || CASE WHEN f = 1 THEN '' ELSE 's' END, ', ' ORDER BY n) FILTER (f > 0) AS tally FROM c GROUP BY term),
a AS (SELECT DISTINCT term, entity, entity_id, label, aop_ids FROM h)"""


@_registered(f"""WITH {_TALLY} SELECT 0 AS section, term, -1 AS kind, '' AS entity_id, 0 AS place, '### ''' || term || ''' — ' || tally AS line, '' AS field FROM y WHERE tally IS NOT NULL
UNION ALL SELECT 1, term, -1, '', 0, '- ''' || term || ''' was not found', '' FROM y WHERE tally IS NULL
UNION ALL SELECT 0, term, n, entity_id, 0, '- **' || shown || ' ' || entity_id || '** ' || label || ' (' || array_to_string(list_transform(aop_ids, lambda i: 'AOP ' || i), ', ') || ')', '' FROM a JOIN e USING (entity)
UNION ALL SELECT 0, term, n, entity_id, 1, '  - `' || field || '`: > ' || text, field FROM h JOIN e USING (entity)""")
def within_aop_report(spark, sf_dir):
    hits, asked = _scope_hits(spark, sf_dir)
    return scope.report_lines(hits, scope.scope_term_counts(hits, asked)).drop("number")


# Exports of found entities.

_PT = r"""q AS (SELECT p_partkey, list_filter([CASE WHEN regexp_matches(lower(p_name), '\bwidget\b') THEN 'widget' END, CASE WHEN regexp_matches(lower(p_name), '\bsteel\b') THEN 'steel' END], lambda x: x IS NOT NULL) AS a, list_filter([CASE WHEN lower(p_type) = 'promo' THEN 'promo' END], lambda x: x IS NOT NULL) AS b, p_name, p_size FROM part),
z AS (SELECT p_partkey AS ke_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS terms, concat_ws('|', CASE WHEN len(b) > 0 THEN 'measurement_method' END, CASE WHEN len(a) > 0 THEN 'title' END) AS fields, least(len(a), 1) + least(len(b), 1) AS snippets, p_name FROM q WHERE len(a) + len(b) > 0)"""


def _event_hits(spark, sf_dir):
    texts = entity_texts(spark, sf_dir).filter("entity = 'events'")
    return search.entity_hits(texts, ["widget", "steel", "promo"], "title").withColumn("entity_id", F.col("entity_id").cast("long"))


def _ranked_events(spark, sf_dir):
    keep = ["ke_id", "title", "percent", "integration_score", "has_method", "aop_count", "any_oecd_endorsed", "in_oecd_aop_program", "only_open_for_adoption"]
    return base._ranked(spark, sf_dir).select(*keep)


@_registered(f"WITH {_I} SELECT ke_id::VARCHAR AS \"Event ID\", p_name AS \"Title\", (bounded + aops)::VARCHAR AS \"Integration Score\", printf('%.2f', percent) AS \"Completion %\", aops::VARCHAR AS \"AOP Count\", CASE WHEN has_method THEN 'Yes' ELSE 'No' END AS \"Has Method\", CASE WHEN endo THEN 'Yes' ELSE 'No' END AS \"OECD Endorsed\", CASE WHEN prog THEN 'Yes' ELSE 'No' END AS \"In OECD Program\", CASE WHEN only_open THEN 'Yes' ELSE 'No' END AS \"Only Open for Adoption\" FROM b JOIN part ON p_partkey = ke_id")
def export_event_summary(spark, sf_dir):
    return sinks.exported(_ranked_events(spark, sf_dir), sinks.FIELD_SETS["event_summary"])


@_registered(f"WITH {_PT}, {_I} SELECT z.ke_id::VARCHAR AS entity_id, p_name AS title, replace(terms, '|', ', ') AS terms_found, replace(fields, '|', ', ') AS matched_fields, snippets::VARCHAR AS snippet_count, CASE WHEN has_method THEN 'Yes' ELSE 'No' END AS has_method, (bounded + aops)::VARCHAR AS integration_score, aops::VARCHAR AS aop_count, printf('%.2f', percent) AS completion_percent FROM z JOIN b USING (ke_id)")
def export_search_events(spark, sf_dir):
    found = search.result_rows(_event_hits(spark, sf_dir), _ranked_events(spark, sf_dir).withColumnRenamed("ke_id", "entity_id").withColumnRenamed("percent", "completion_percent"))
    return sinks.exported(found, sinks.FIELD_SETS["search_results_event"])


_AOPS = r"""d AS (SELECT DISTINCT l_orderkey AS aop_id, l_partkey FROM lineitem), u AS (SELECT o_orderkey AS aop_id, o_orderpriority AS title, regexp_matches(lower(o_orderpriority), '\burgent\b') AS t1, regexp_matches(lower(o_orderpriority), '\bhigh\b') AS t2, o_orderstatus AS abstract FROM orders)"""


@_registered(r"WITH u AS (SELECT c_custkey AS id, lower(c_mktsegment) AS s, lower(c_name) AS n, c_name, c_mktsegment FROM customer), f AS (SELECT *, s = 'machinery' AS m, s = 'furniture' AS fu, regexp_matches(n, '\bcustomer\b') AS cu FROM u) SELECT row_number() OVER (ORDER BY (m OR fu) DESC, (m OR fu)::INT + cu::INT DESC, id) AS place, id::VARCHAR AS entity_id, c_name AS title, ((m OR fu)::INT + cu::INT)::VARCHAR AS snippet_count, CASE WHEN m OR fu THEN 'Yes' ELSE 'No' END AS has_priority_term_match, concat_ws(', ', CASE WHEN cu THEN 'customer' END, CASE WHEN fu THEN 'furniture' END, CASE WHEN m THEN 'machinery' END) AS terms_found, concat_ws(', ', CASE WHEN m OR fu THEN 'abstract' END, CASE WHEN cu THEN 'title' END) AS matched_fields FROM f WHERE m OR fu OR cu")
def export_search_aops(spark, sf_dir):
    """Customers as pathways: name as title, segment as abstract; hits in the abstract first, then by snippets."""
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("abstract"))
    texts = people.select("entity_id", F.inline(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("abstract").alias("field"), F.col("abstract").alias("text")))))
    found = search.result_rows(search.entity_hits(texts, ["machinery", "furniture", "customer"], "abstract"), people)
    shown = [f for f in sinks.FIELD_SETS["search_results_aop"] if f.path in ("entity_id", "title", "snippet_count", "has_priority_term_match", "terms_found", "matched_fields")]
    placed = graph.placed(found, [F.desc("has_priority_term_match"), F.desc("snippet_count"), F.col("entity_id")])
    return sinks.exported(placed, [sinks.Field("place", "place"), *shown]).withColumn("place", F.col("place").cast("long"))


@_registered(rf"WITH {_K}, {_T}, z AS (SELECT ker_id, coalesce(ut, '?') || ' -> ' || coalesce(dt, '?') AS title, concat_ws(' leads to ', ut, dt) AS text FROM k2) SELECT ker_id AS entity_id, title, concat_ws(', ', CASE WHEN regexp_matches(text, '\bsteel\b') THEN 'steel' END, CASE WHEN regexp_matches(text, '\bwidget\b') THEN 'widget' END) AS terms_found, 'description' AS matched_fields, '1' AS snippet_count, 'No' AS has_any_tables, '0.00' AS completion_percent FROM z WHERE regexp_matches(text, '\b(steel|widget)\b')")
def export_search_kers(spark, sf_dir):
    hits = search.entity_hits(entity_texts(spark, sf_dir).filter("entity = 'kers'"), ["widget", "steel"])
    known = kers_with_titles(spark, sf_dir).select(F.col("ker_id").alias("entity_id"), ker_label(F.col("upstream_title"), F.col("downstream_title")).alias("title"), F.lit(False).alias("has_any_tables"), F.lit(0.0).alias("completion_percent"))
    return sinks.exported(search.result_rows(hits, known), sinks.FIELD_SETS["search_results_ker"])


@_registered(f"""WITH {_PT}, {_I}, {_M}, {_E}, {_A}, y AS (SELECT DISTINCT ke_id FROM m SEMI JOIN a USING (aop_id)), j AS (SELECT coalesce(z.ke_id, y.ke_id) AS ke_id, z.ke_id IS NOT NULL AS s, y.ke_id IS NOT NULL AS t, terms, fields, snippets FROM z FULL JOIN y USING (ke_id))
SELECT j.ke_id::VARCHAR AS entity_id, coalesce(part.p_name, 'N/A') AS title, CASE WHEN s THEN 'Yes' ELSE 'No' END AS "Found in Event Search", CASE WHEN t THEN 'Yes' ELSE 'No' END AS "Found Through AOPs", replace(coalesce(terms, ''), '|', ', ') AS terms_found, replace(coalesce(fields, ''), '|', ', ') AS matched_fields, coalesce(snippets, 0)::VARCHAR AS snippet_count, CASE WHEN has_method THEN 'Yes' ELSE 'No' END AS has_method, coalesce(bounded + aops, 0)::VARCHAR AS integration_score, coalesce(aops, 0)::VARCHAR AS aop_count, printf('%.2f', coalesce(percent, 0)) AS completion_percent FROM j LEFT JOIN b USING (ke_id) LEFT JOIN part ON p_partkey = j.ke_id""")
def combined_event_rows(spark, sf_dir):
    through = graph.events_with_provenance(membership(spark, sf_dir), base.matched_aops(spark, sf_dir), key_events(spark, sf_dir)).select(F.col("ke_id").alias("entity_id")).distinct()
    known = _ranked_events(spark, sf_dir).withColumnRenamed("ke_id", "entity_id").withColumnRenamed("percent", "completion_percent")
    return sinks.exported(search.combined_rows(_event_hits(spark, sf_dir), through, known), sinks.FIELD_SETS["search_results_event_with_flags"])


@_registered(rf"WITH {_K}, {_T}, z AS (SELECT ker_id, aop_id, coalesce(ut, 'N/A') AS u, coalesce(dt, 'N/A') AS d, concat_ws(' leads to ', ut, dt) AS text FROM k2) SELECT ker_id AS \"KER ID\", u AS \"Upstream KE\", d AS \"Downstream KE\", aop_id::VARCHAR AS \"AOPs\", concat_ws(', ', CASE WHEN regexp_matches(text, '\bleads to\b') THEN 'leads to' END, CASE WHEN regexp_matches(text, '\bsteel\b') THEN 'steel' END) AS \"Search Terms Found\", 'description' AS \"Field Searched\", text AS \"Snippet\" FROM z WHERE regexp_matches(text, '\b(steel)\b|\bleads to\b')".replace('\\"', '"'))
def concordance_rows(spark, sf_dir):
    kers = kers_with_titles(spark, sf_dir)
    owned_by = kers.groupBy("ker_id").agg(F.first("upstream_title").alias("upstream_ke"), F.first("downstream_title").alias("downstream_ke"), F.array_sort(F.collect_set("aop_id")).alias("aops"))
    return sinks.exported(search.concordance(entity_texts(spark, sf_dir).filter("entity = 'kers'"), ["steel", "leads to"], owned_by), sinks.FIELD_SETS["concordance_ker"])


# Lookups over the graph.

@_registered(f"WITH {_K} SELECT aop_id, array_to_string(list(ker_id ORDER BY ker_id), ',') AS ker_ids FROM k GROUP BY aop_id")
def aop_to_kers(spark, sf_dir):
    return graph.aop_to_kers(relationships(spark, sf_dir)).withColumn("ker_ids", F.array_join("ker_ids", ","))


@_registered(f"WITH {_E} SELECT term, count(*) AS events FROM (SELECT 'widget' AS term FROM e WHERE regexp_matches(title, '\\bwidget\\b') UNION ALL SELECT 'gizmo' FROM e WHERE regexp_matches(title, '\\bgizmo\\b')) GROUP BY term")
def events_by_term(spark, sf_dir):
    return graph.events_by_term(base.matched_events(spark, sf_dir))


@_registered(f"WITH {_M}, {_E}, {_A}, j AS (SELECT a.*, o_orderstatus AS status, o_orderpriority AS title FROM a JOIN orders ON o_orderkey = aop_id), f AS (SELECT * FROM j WHERE NOT regexp_matches(lower(title), '\\burgent\\b')) SELECT (SELECT count(*) FROM e) AS matched_events, (SELECT count(*) FROM a) AS matched_aops, (SELECT count(*) FROM f) AS after_title_exclusion, (SELECT count(*) FROM f WHERE status IN ('F', 'P')) AS after_status_filter")
def event_to_aop_summary(spark, sf_dir):
    aops = base.aops(spark, sf_dir).withColumnRenamed("license", "title")
    return graph.event_to_aop_summary(base.matched_events(spark, sf_dir), base.matched_aops(spark, sf_dir), aops, ["urgent"], ["F", "P"])


@_registered(f"WITH {_K}, {_T}, z AS (SELECT ker_id, ut = dt AS tabled, 100.0 * (length(ut) % 7) / 7 AS s FROM k2) SELECT count(*) AS total_kers, count_if(coalesce(tabled, false))::BIGINT AS kers_with_tables, count_if(NOT coalesce(tabled, false))::BIGINT AS kers_without_tables, coalesce(round(avg(round(s, 2)), 2), 0) AS average_percent, coalesce(round(avg(round(s, 2)) FILTER (coalesce(tabled, false)), 2), 0) AS average_percent_with_tables, coalesce(round(avg(round(s, 2)) FILTER (NOT coalesce(tabled, false)), 2), 0) AS average_percent_without_tables FROM z")
def ker_analytics(spark, sf_dir):
    kers = kers_with_titles(spark, sf_dir).select("ker_id", (F.col("upstream_title") == F.col("downstream_title")).alias("has_any_tables"), F.round(100.0 * (F.length("upstream_title") % 7) / 7, 2).alias("percent"))
    return scoring.ker_statistics(kers)


@_registered(f"WITH {_K}, {_T} SELECT 'kers' AS entity, ker_id AS entity_id, coalesce(ut, '?') || ' -> ' || coalesce(dt, '?') AS label FROM k2 UNION ALL SELECT 'events', p_partkey::VARCHAR, p_name FROM part UNION ALL SELECT 'aops', o_orderkey::VARCHAR, o_orderpriority FROM orders")
def entity_labels(spark, sf_dir):
    return labels(spark, sf_dir)


_PAIR_SQL = f"""{_M}, {_E}, {_A}, {_K}, s AS (SELECT DISTINCT aop_id, ke_id, role FROM m WHERE role <> 'KE'), n AS (SELECT aop_id, count(DISTINCT ke_id) AS num_events FROM m GROUP BY aop_id), nk AS (SELECT aop_id, count(*) AS num_kers FROM k GROUP BY aop_id)"""


@_registered(f"WITH {_PAIR_SQL} SELECT a.aop_id, o_orderpriority AS aop_title, o_orderstatus AS oecd_status, coalesce(x.ke_id::VARCHAR, '') AS mie_id, CASE WHEN x.ke_id IS NULL THEN '' ELSE coalesce(px.p_name, 'Unknown') END AS mie_title, x.ke_id IS NOT NULL AND ex.ke_id IS NOT NULL AS mie_matched, coalesce(y.ke_id::VARCHAR, '') AS ao_id, CASE WHEN y.ke_id IS NULL THEN '' ELSE coalesce(py.p_name, 'Unknown') END AS ao_title, y.ke_id IS NOT NULL AND ey.ke_id IS NOT NULL AS ao_matched, num_events, coalesce(num_kers, 0) AS num_kers FROM a JOIN orders ON o_orderkey = a.aop_id LEFT JOIN s x ON x.aop_id = a.aop_id AND x.role = 'MIE' LEFT JOIN s y ON y.aop_id = a.aop_id AND y.role = 'AO' LEFT JOIN part px ON px.p_partkey = x.ke_id LEFT JOIN part py ON py.p_partkey = y.ke_id LEFT JOIN e ex ON ex.ke_id = x.ke_id LEFT JOIN e ey ON ey.ke_id = y.ke_id LEFT JOIN n ON n.aop_id = a.aop_id LEFT JOIN nk ON nk.aop_id = a.aop_id")
def mie_ao_pair_rows(spark, sf_dir):
    aops = base.aops(spark, sf_dir).select("aop_id", F.col("license").alias("aop_title"), F.col("status").alias("oecd_status"))
    return graph.pair_rows(membership(spark, sf_dir), base.matched_aops(spark, sf_dir), aops, key_events(spark, sf_dir), base.matched_events(spark, sf_dir), relationships(spark, sf_dir))


@_registered("SELECT page_id, 'https://kb.example/aops/' || page_id || CASE WHEN page_id % 3 = 0 THEN '#' || split_part(url, '/', 3) ELSE '' END AS link, printf('%02d:%02d:%06.3f', page_id // 3600, page_id % 3600 // 60, (page_id % 60) + 0.25) AS elapsed FROM pages")
def links_and_times(spark, sf_dir):
    anchor = F.when(F.col("page_id") % 3 == 0, F.split_part("url", F.lit("/"), F.lit(3)))
    return read(spark, sf_dir, "pages").select("page_id", sinks.entity_link(F.lit("https://kb.example"), "aops", F.col("page_id"), anchor).alias("link"), sinks.elapsed(F.col("page_id") + 0.25).alias("elapsed"))


# References.

_CITED = """CASE c_custkey % 7 WHEN 0 THEN 'Smith et al. ' || (1990 + c_nationkey) WHEN 1 THEN 'ATSDR - Agency for Toxic Substances (' || (1990 + c_nationkey) || '). Profile of ' || lower(c_mktsegment) || '. Atlanta'
WHEN 2 THEN 'Poisoning & Drug Overdose, 3rd edition, p. ' || c_custkey || ', 1994' WHEN 3 THEN 'Hazardous Substances Data Bank; https://hsdb.example/' || c_custkey WHEN 4 THEN 'Das R et al. Illness related to ' || lower(c_mktsegment) || '. MMWR 2006;55(17)'
WHEN 5 THEN 'Zhai et al 2022; Jones et al 20' || (10 + c_nationkey) ELSE ' ' END"""
_YEAR = "(1990 + c_nationkey)"


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records that cite something, by rule."""
    return read(spark, sf_dir, "customer").select(F.lit("aops").alias("entity"), F.col("c_custkey").alias("entity_id"), F.expr(_CITED.replace("||", "||")).alias("raw"))


_PARTS = f"z AS (SELECT c_custkey, {_CITED} AS raw FROM customer), s AS (SELECT c_custkey, trim(unnest(CASE WHEN c_custkey % 7 = 5 THEN string_split(raw, ';') ELSE [raw] END)) AS raw FROM z), c AS (SELECT * FROM s WHERE raw <> '')"
_KIND = "CASE WHEN regexp_matches(raw, '^[A-Z][a-z]+\\s+et\\s+al\\.?\\s+\\d{4}$') THEN 'author_year_short' WHEN contains(lower(raw), 'atsdr') THEN 'agency_report' WHEN contains(lower(raw), 'edition') THEN 'book' WHEN regexp_matches(raw, '^[A-Z][a-z]+\\s+[A-Z]?\\s*et\\s+al') THEN 'journal_article' ELSE 'other' END"
_SOURCE = "CASE WHEN raw LIKE 'Poisoning%' THEN 'Poisoning and Drug Overdose' WHEN raw LIKE 'Hazardous%' THEN 'Hazardous Substances Data Bank' WHEN raw LIKE 'Das R%' THEN regexp_extract(raw, 'al\\. (.*)\\. MMWR', 1) WHEN raw LIKE 'ATSDR%' THEN regexp_extract(raw, '\\)\\. ([^.]+)', 1) ELSE regexp_extract(raw, '^([A-Z][a-z]+ et al)', 1) END"


@_registered(f"WITH {_PARTS} SELECT c_custkey AS entity_id, raw FROM c")
def citations_split(spark, sf_dir):
    return references.split_citations(cited(spark, sf_dir), "raw").select("entity_id", "raw")


@_registered(f"WITH {_PARTS} SELECT {_KIND} AS kind, count(*) AS citations, count(DISTINCT raw) AS variants FROM c GROUP BY ALL")
def citation_types(spark, sf_dir):
    return references.citation_types(references.split_citations(cited(spark, sf_dir), "raw"), "raw")


@_registered(f"WITH {_PARTS} SELECT {_SOURCE} AS source, count(*) AS citations, count(DISTINCT raw) AS variants FROM c GROUP BY ALL")
def citation_sources(spark, sf_dir):
    return references.citation_sources(references.split_citations(cited(spark, sf_dir), "raw"), "raw")


@_registered(f"WITH z AS (SELECT {_CITED} AS raw FROM customer), c AS (SELECT trim(raw) AS raw FROM z WHERE trim(raw) <> ''), g AS (SELECT CASE WHEN raw LIKE 'Zhai%' THEN 'Zhai' ELSE {_SOURCE} END AS source, count(*) AS n FROM c GROUP BY ALL) SELECT (SELECT count(*) FROM z) AS total_raw, (SELECT count(*) FROM c) AS total_citations, count(*) AS unique_sources, count_if(n > 1)::BIGINT AS sources_with_variants FROM g")
def citation_totals(spark, sf_dir):
    return references.citation_totals(cited(spark, sf_dir).withColumn("raw", F.regexp_replace("raw", "; Jones et al 20..", "")), "raw")


_AUTHORS = "regexp_extract(raw, '^([A-Z][a-z]+ et al)\\.? \\d', 1)"


@_registered(f"WITH {_PARTS} SELECT raw, count(*) AS citations, nullif(list_last(regexp_extract_all(raw, '\\b(?:19|20)\\d\\d\\b')), '') AS year, nullif(regexp_extract(raw, 'https?://\\S+'), '') AS url, nullif({_AUTHORS}, '') AS authors, CASE WHEN NOT regexp_matches(raw, '^[A-Z][a-z]+ et al') THEN {_SOURCE} END AS title, CASE WHEN raw LIKE 'ATSDR%' THEN trim(split_part(raw, '(', 1)) END AS organization, {_KIND} AS kind FROM c GROUP BY ALL")
def citation_records(spark, sf_dir):
    return references.citation_records(references.split_citations(cited(spark, sf_dir), "raw"), "raw")


_SEGMENT = "lower(c_mktsegment)"
_ENTRY = f"""CASE c_custkey % 4 WHEN 0 THEN 'OECD (' || {_YEAR} || '), Test No. ' || c_custkey || ': Assay of ' || {_SEGMENT} || ', OECD Publishing, Paris. DOI: 10.1787/' || c_custkey
WHEN 1 THEN 'Lee, Kay and Ray, Bob (' || {_YEAR} || '). Effects of ' || {_SEGMENT} || ' on cells Toxicol Lett, 12. https://papers.example/' || c_custkey
WHEN 2 THEN 'Kemp ' || {_YEAR} || ' "The history of ' || {_SEGMENT} || '" Journal of Old Trades, 3.' ELSE 'Entry #' || c_custkey % 100 END"""
_ENTRY_PARTS = """SELECT c_custkey AS entity_id, CASE WHEN k = 3 THEN 'N/A' ELSE y::VARCHAR END AS year, CASE WHEN k = 0 THEN '10.1787/' || c_custkey END AS doi, CASE WHEN k = 1 THEN 'https://papers.example/' || c_custkey ELSE '' END AS urls,
CASE k WHEN 0 THEN 'OECD' WHEN 1 THEN 'Lee|Kay|Ray|Bob' WHEN 2 THEN 'Kemp' ELSE '' END AS authors, CASE k WHEN 0 THEN 'Assay of ' || s WHEN 1 THEN 'Effects of ' || s || ' on cells' WHEN 2 THEN 'The history of ' || s ELSE '' END AS title,
CASE k WHEN 0 THEN 'OECD Publishing' WHEN 2 THEN 'Old Trades' ELSE '' END AS journal, CASE k WHEN 0 THEN 'Publishing, Paris' WHEN 3 THEN 'Entry #' || c_custkey % 100 END AS rest"""


@_registered(f"WITH c AS (SELECT c_custkey, c_custkey % 4 AS k, {_SEGMENT} AS s, {_YEAR} AS y FROM customer) {_ENTRY_PARTS} FROM c")
def structured_entries(spark, sf_dir):
    """Customers as entries of a reference section, by rule, read by the grammar."""
    read_ = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_custkey").alias("k"), grammar.reference_entry(F.expr(_ENTRY)).alias("e"))
    rest = F.when(F.col("k") % 4 == 0, F.regexp_replace("e.other_info", r"^\W+|\W+$", "")).when(F.col("k") % 4 == 3, F.col("e.other_info"))
    return read_.select("entity_id", "e.year", "e.doi", F.array_join("e.urls", "|").alias("urls"), F.array_join("e.authors", "|").alias("authors"), "e.title", "e.journal", rest.alias("rest"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as structured citations."""
    rows = read(spark, sf_dir, "customer")
    return rows.select(
        F.when(F.col("c_custkey") % 2 == 0, "aops").otherwise("events").alias("entity"), (F.col("c_custkey") / 2).cast("long").alias("entity_id"),
        F.concat_ws(" ", "c_name", "c_mktsegment").alias("raw_citation"), F.expr(f"string({_YEAR})").alias("year"), F.array("c_name", F.concat(F.lit("Nation "), F.col("c_nationkey"))).alias("authors"),
        F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.concat(F.lit("Short-term study of "), F.lower("c_mktsegment"))).alias("title"), F.col("c_mktsegment").alias("journal"),
    )


_CIT = f"c AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'aops' ELSE 'events' END AS entity, c_custkey // 2 AS entity_id, c_name || ' ' || c_mktsegment AS raw_citation, {_YEAR}::VARCHAR AS year, c_name AS a1, 'Nation ' || c_nationkey AS a2, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE 'Short-term study of ' || lower(c_mktsegment) END AS title, c_mktsegment AS journal FROM customer)"
_ACROSS = "year IN ('1995', '2001') AND contains(lower(a2), 'nation 1') AND contains(lower(journal), 'mach')"
_ACROSS_SAID = "CASE WHEN contains(year, '1995') THEN '1995' ELSE '2001' END || ' + nation 1 + mach'"


@_registered(f"WITH {_CIT} SELECT entity, entity_id, raw_citation, {_ACROSS_SAID} AS matched FROM c WHERE {_ACROSS}")
def references_across_fields(spark, sf_dir):
    return references.across_fields(structured(spark, sf_dir), {"publication_year": ["1995", "2001"], "author": ["nation 1"], "journal": ["mach"]}).select("entity", "entity_id", "raw_citation", "matched")


@_registered(f"WITH {_CIT}, t AS (SELECT *, lower(raw_citation || ' ' || a1 || ' ' || a2 || ' ' || title || ' ' || journal) AS low FROM c), f AS (SELECT *, concat_ws(' + ', CASE WHEN contains(low, 'nation 2') THEN 'Nation 2' END, CASE WHEN contains(low, 'machinery') THEN 'machinery' END, CASE WHEN contains(low, 'study') THEN 'study' END) AS matched FROM t) SELECT entity, entity_id, raw_citation, matched FROM f WHERE contains(matched, ' + ')")
def references_by_combination(spark, sf_dir):
    return references.by_combination(structured(spark, sf_dir), ["Nation 2", "machinery", "study"]).select("entity", "entity_id", "raw_citation", "matched")


_FLEX = "low AS (SELECT *, replace(lower(CASE WHEN length(title) < 5 THEN title || ' ' || raw_citation ELSE title END), '-', ' ') AS low FROM c)"
_FLEX_WORDS = "(" + " + ".join(f"contains(low, '{w}')::INT" for w in "fish short term machinery study".split()) + ") >= 4"


@_registered(f"WITH {_CIT}, {_FLEX}, f AS (SELECT *, CASE WHEN {_FLEX_WORDS} THEN 'Fish short-term machinery study' WHEN contains(low, 'customer#000000000') THEN 'customer#000000000' END AS matched FROM low) SELECT entity, entity_id, raw_citation, matched FROM f WHERE matched IS NOT NULL")
def references_by_field(spark, sf_dir):
    return references.by_field(structured(spark, sf_dir), ["Fish short-term machinery study", "customer#000000000"], "title").select("entity", "entity_id", "raw_citation", "matched")


@_registered(f"WITH {_CIT}, {_FLEX}, f AS (SELECT entity, entity_id, raw_citation, concat_ws('; ', CASE WHEN {_ACROSS} THEN {_ACROSS_SAID} END, CASE WHEN contains(low, 'study of machinery') THEN 'study of machinery' END) AS matched FROM low), h AS (SELECT * FROM f WHERE matched <> '') SELECT entity, entity_id, row_number() OVER (PARTITION BY entity, entity_id ORDER BY raw_citation)::INTEGER AS citation_index, raw_citation, matched FROM h")
def reference_search(spark, sf_dir):
    searches = [{"across": {"year": ["1995", "2001"], "authors": ["nation 1"], "journal": ["mach"]}}, {"terms": ["study of machinery"], "field": "title"}]
    return references.indexed_citations(references.reference_search(structured(spark, sf_dir), searches))
