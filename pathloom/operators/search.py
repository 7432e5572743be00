"""Search of text fields: hits with snippets, counts with zeros, co-occurrence, exclusions, scopes.

``texts`` is a long table: entity_id, field, text (cleaned once).  Terms are configuration, so
each becomes a literal pattern in the plan; the text is scanned once for all of them.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_position, has_lower_term, has_term, sentence_around, split_case_flag, term_length, without_overlaps
from .graph import any_of


def read_once(texts: DataFrame) -> DataFrame:
    """``entity_id``, ``field``, ``text`` and its lower case ``low``, made once a row however many terms look at them.

    What makes the text is otherwise repeated for each term in each filter pushed below it;
    nothing is pushed below a generator.
    """
    texts = texts.select("entity_id", "field", F.explode(F.array("text")).alias("text")).filter("text is not null")
    return texts.select("entity_id", "field", "text", F.explode(F.array(F.lower("text"))).alias("low"))


def term_matches(texts: DataFrame, terms: list[str]) -> DataFrame:
    """A row for each (entity, field, term) found, with the term's place in the list."""
    found = [F.when(has_lower_term(F.col("low"), t), F.struct(F.lit(i).alias("term_ord"), F.lit(t).alias("term"))) for i, t in enumerate(terms)]
    return read_once(texts).select("entity_id", "field", F.inline(F.array_compact(F.array(*found))))


def term_hits(texts: DataFrame, terms: list[str]) -> DataFrame:
    """As ``term_matches``, with the ``snippet`` around the term's first occurrence."""
    found = [F.struct(F.lit(i).alias("term_ord"), F.lit(t).alias("term"), first_position(F.col("low"), t).alias("at"), F.lit(term_length(t)).alias("size")) for i, t in enumerate(terms)]
    hits = read_once(texts).select("entity_id", "field", "text", F.inline(F.filter(F.array(*found), lambda h: h["at"] > 0)))
    return hits.select("entity_id", "field", "term_ord", "term", sentence_around(F.col("text"), F.col("at"), F.col("size")).alias("snippet"))


def with_terms(texts: DataFrame, terms: list[str]) -> DataFrame:
    """Texts (``entity_id``, ``field``) that have any of the terms."""
    return read_once(texts).filter(any_of([has_lower_term(F.col("low"), t) for t in terms])).select("entity_id", "field")


def listed_terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "term_ord int, term string")


def term_counts(texts: DataFrame, terms: list[str]) -> DataFrame:
    """Field hits and distinct entities of every term, zeros included."""
    counted = term_matches(texts, terms).groupBy("term").agg(F.count("*").alias("field_hits"), F.count_distinct("entity_id").alias("entities"))
    every = listed_terms(texts.sparkSession, terms).select("term")
    return every.join(counted, "term", "left").select("term", F.coalesce("field_hits", F.lit(0)).alias("field_hits"), F.coalesce("entities", F.lit(0)).alias("entities"))


def entity_hits(texts: DataFrame, terms: list[str], priority_field: str | None = None) -> DataFrame:
    """One row for each entity with hits: terms in order, snippets without overlaps, whether the priority field has a hit."""
    hits = term_hits(texts, terms)
    fields = hits.groupBy("entity_id", "field").agg(F.array_sort(F.collect_list(F.struct("term_ord", "term", "snippet"))).alias("found"))
    fields = fields.select("entity_id", "field", F.transform("found", lambda x: x["term"]).alias("terms"), without_overlaps(F.transform("found", lambda x: x["snippet"])).alias("snippets"))
    return fields.groupBy("entity_id").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))), "|").alias("terms_found"),
        F.array_join(F.array_sort(F.collect_set("field")), "|").alias("matched_fields"),
        F.sum(F.size("snippets")).alias("snippet_count"),
        F.bool_or(F.col("field") == F.lit(priority_field)).alias("has_priority_term_match") if priority_field else F.lit(False).alias("has_priority_term_match"),
    )


def co_occurrences(texts: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """A row for each (entity, field, pair) where both terms are in the same field."""
    has = lambda t: has_lower_term(F.col("low"), t)
    both = [F.when(has(a) & has(b), F.struct(F.lit(a).alias("term_a"), F.lit(b).alias("term_b"))) for a, b in pairs]
    return read_once(texts).select("entity_id", "field", F.inline(F.array_compact(F.array(*both))))


def co_occurrence_summary(texts: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Instances and distinct entities of every pair, zeros included."""
    counted = co_occurrences(texts, pairs).groupBy("term_a", "term_b").agg(F.count("*").alias("instances"), F.count_distinct("entity_id").alias("entities"))
    every = texts.sparkSession.createDataFrame(pairs, "term_a string, term_b string")
    return every.join(counted, ["term_a", "term_b"], "left").na.fill(0, ["instances", "entities"])


def excluding(hits: DataFrame, texts: DataFrame, terms: list[str], fields: list[str] | None = None) -> DataFrame:
    """Hits of entities that have none of the terms in the given fields (all fields if not said)."""
    scope = texts if fields is None else texts.filter(F.col("field").isin(*fields))
    return hits.join(with_terms(scope, terms).select("entity_id").distinct(), "entity_id", "left_anti")


def dropping_content(texts: DataFrame, field: str, passages: list[str]) -> DataFrame:
    """Texts without literal passages in one field, taken out before a search."""
    text = reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), passages, F.col("text"))
    return texts.withColumn("text", F.when(F.col("field") == field, text).otherwise(F.col("text")))


def scoped_search(texts: DataFrame, scope: DataFrame, terms: list[str]) -> DataFrame:
    """Hits within a scope of entities; a term with ``cs:`` counts only where its snippet has that case."""
    flagged: dict[str, bool] = {}
    for term, exact in map(split_case_flag, terms):
        if flagged.setdefault(term.lower(), exact) != exact:
            raise ValueError(f"{term!r} is asked for with and without its case")
    inside = texts.join(scope.select("entity_id").distinct(), "entity_id", "left_semi")
    cased = [t for t, exact in map(split_case_flag, terms) if exact]
    hits = term_hits(inside, [split_case_flag(t)[0] for t in terms])
    wrong = any_of([(F.col("term") == t) & ~has_term(F.col("snippet"), t, case_sensitive=True) for t in cased])
    return hits.filter(~wrong).drop("term_ord")


def group_matches(hits: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(entity, group) for each group with a spelling among an entity's hits."""
    spelled = hits.sparkSession.createDataFrame([(t, g) for g, ts in groups.items() for t in ts], "term string, grp string")
    return hits.select("entity_id", "term").join(F.broadcast(spelled), "term").select("entity_id", "grp").distinct()


def group_pairs(hits: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Number of entities in which two groups both occur, for every pair of groups, zeros included."""
    names = sorted(groups)
    flags = group_matches(hits, groups).groupBy("entity_id").agg(F.collect_set("grp").alias("found"))
    pairs = list(combinations(names, 2))
    both = [F.when(F.array_contains("found", a) & F.array_contains("found", b), F.struct(F.lit(a).alias("group_a"), F.lit(b).alias("group_b"))) for a, b in pairs]
    counted = flags.select(F.explode(F.array_compact(F.array(*both))).alias("p")).groupBy("p.group_a", "p.group_b").agg(F.count("*").alias("entities"))
    every = hits.sparkSession.createDataFrame(pairs, "group_a string, group_b string")
    return every.join(counted, ["group_a", "group_b"], "left").na.fill(0, ["entities"])


def _listed(hits: DataFrame) -> DataFrame:
    return hits.withColumns({c: F.split(c, r"\|") for c in ("terms_found", "matched_fields")})


def result_rows(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Found entities (``entity_hits``) with what is known of them by ``entity_id``, as exports take them."""
    return _listed(hits).join(known, "entity_id", "left").withColumn("title", F.coalesce("title", F.lit("N/A")))


def combined_rows(hits: DataFrame, through: DataFrame, known: DataFrame) -> DataFrame:
    """Events found by text, or ``through`` matched pathways (entity_id), or both, with a flag for each way."""
    both = _listed(hits).withColumn("by_text", F.lit(True)).join(through.withColumn("by_aops", F.lit(True)), "entity_id", "full_outer")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    flagged = both.withColumn("found_in_event_search", yes("by_text")).withColumn("found_through_aops", yes("by_aops")).drop("by_text", "by_aops")
    return flagged.join(known, "entity_id", "left").withColumn("title", F.coalesce("title", F.lit("N/A")))


def concordance(texts: DataFrame, terms: list[str], kers: DataFrame) -> DataFrame:
    """A row for each relationship, field and snippet, with all terms found in the relationship, its two ends and its pathways.

    ``kers``: ker_id, upstream_ke, downstream_ke, aops.  Of snippets in one field those that hold another are left out.
    """
    hits = term_hits(texts, terms)
    found = hits.groupBy("entity_id").agg(F.array_sort(F.collect_set("term")).alias("terms_found"))
    fields = hits.groupBy("entity_id", "field").agg(F.array_sort(F.collect_list(F.struct("term_ord", "snippet"))).alias("s"))
    rows = fields.select("entity_id", "field", F.explode(without_overlaps(F.transform("s", lambda x: x["snippet"]))).alias("snippet")).join(found, "entity_id")
    return rows.withColumnRenamed("entity_id", "ker_id").join(kers, "ker_id", "left")
