"""Lookups over the pathway graph: membership with roles, relationships, pairs of outer events.

Tables: membership (aop_id, ke_id, role, ord), ker (ker_id, aop_id, upstream, downstream),
key_event (ke_id, title).  All operators are joins and grouped aggregates; none gathers a
whole neighbourhood except where its result is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_term
from ..sources.shared import written

MIE, AO, KE = "MIE", "AO", "KE"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def events_by_title(events: DataFrame, terms: list[str], title: str = "title") -> DataFrame:
    """Events whose title has a term, with ``matched_terms`` in the terms' order."""
    if not terms:
        raise ValueError("at least one term is needed")
    matched = F.array_compact(F.array(*[F.when(has_term(F.col(title), t), F.lit(t)) for t in terms]))
    return events.withColumn("matched_terms", matched).filter(F.size("matched_terms") > 0)


def without_title_terms(rows: DataFrame, terms: list[str], title: str = "title") -> DataFrame:
    """Rows whose title has none of the terms."""
    return rows.filter(~any_of([has_term(F.col(title), t) for t in terms])) if terms else rows


def aops_containing(membership: DataFrame, event_ids: DataFrame) -> DataFrame:
    """Pathways with any of the events: distinct numbers of matching and of all events."""
    wanted = event_ids.select("ke_id").distinct().withColumn("hit", F.lit(1))
    rows = membership.select("aop_id", "ke_id").distinct().join(wanted, "ke_id", "left")
    counted = rows.groupBy("aop_id").agg(F.count("hit").alias("num_matching_events"), F.count("*").alias("total_events"))
    return counted.filter("num_matching_events > 0")


def resolve_roles(membership: DataFrame) -> DataFrame:
    """One role for each (pathway, event): the last specific one by ``ord``; KE only where there is none."""
    specific = F.max_by("role", F.when(F.col("role") != KE, F.col("ord")))
    return membership.groupBy("aop_id", "ke_id").agg(F.coalesce(specific, F.lit(KE)).alias("role"))


# Names of roles as records of events give them.
ROLE_NAMES = {"MolecularInitiatingEvent": MIE, "AdverseOutcome": AO, "KeyEvent": KE, MIE: MIE, AO: AO, KE: KE}


def with_recorded_roles(membership: DataFrame, recorded: DataFrame) -> DataFrame:
    """Memberships without a role take the one that their event's record gives for that pathway (aop_id, ke_id, role by any of ``ROLE_NAMES``), else KE."""
    known = F.coalesce(*[F.when(F.col("role") == said, F.lit(role)) for said, role in ROLE_NAMES.items()])
    told = recorded.select("aop_id", "ke_id", known.alias("recorded")).filter("recorded is not null").groupBy("aop_id", "ke_id").agg(F.min("recorded").alias("recorded"))
    return membership.join(told, ["aop_id", "ke_id"], "left").withColumn("role", F.coalesce("role", "recorded", F.lit(KE))).drop("recorded")


def regulatory_relevance(membership: DataFrame) -> DataFrame:
    """For each event what the last pathway that says something of it as an adverse outcome says (``examples``, by ``ord``); events without have no row."""
    said = membership.filter((F.col("role") == AO) & F.col("examples").isNotNull())
    return said.groupBy("ke_id").agg(F.max_by("examples", "ord").alias("regulatory_relevance"))


def role_flags(membership: DataFrame) -> DataFrame:
    """For each event: in how many pathways it has each role, and whether it has several."""
    roles = resolve_roles(membership)
    counts = roles.groupBy("ke_id").agg(*[F.count_if(F.col("role") == r).alias(f"n_{r.lower()}") for r in (MIE, AO, KE)], F.count_distinct("role").alias("n_roles"))
    return counts.select("*", (F.col("n_mie") > 0).alias("serves_as_mie"), (F.col("n_ao") > 0).alias("serves_as_ao"))


def endpoints(kers: DataFrame) -> DataFrame:
    """A row for each end of each relationship: ``ker_id``, ``ke_id``, ``role``; blank ends have none."""
    ends = F.array(F.struct(F.col("upstream").alias("ke_id"), F.lit("upstream").alias("role")), F.struct(F.col("downstream").alias("ke_id"), F.lit("downstream").alias("role")))
    return kers.select("ker_id", F.explode(ends).alias("e")).select("ker_id", "e.*").filter(F.col("ke_id").isNotNull() & (F.col("ke_id").cast("string") != ""))


def kers_containing(kers: DataFrame, event_ids: DataFrame) -> DataFrame:
    """(relationship, event, role) for the given events; an event at both ends counts as downstream."""
    found = endpoints(kers).join(event_ids.select("ke_id").distinct(), "ke_id")
    return found.groupBy("ker_id", "ke_id").agg(F.when(F.bool_or(F.col("role") == "downstream"), "downstream").otherwise("upstream").alias("role"))


def role_counts(kers: DataFrame) -> DataFrame:
    """How often each event is upstream and downstream."""
    return endpoints(kers).groupBy("ke_id").agg(F.count_if(F.col("role") == "upstream").alias("n_upstream"), F.count_if(F.col("role") == "downstream").alias("n_downstream"))


def kers_in_aops(kers: DataFrame, aop_ids: DataFrame) -> DataFrame:
    """Relationships of the given pathways."""
    return kers.join(aop_ids.select("aop_id").distinct(), "aop_id", "left_semi")


def events_with_provenance(membership: DataFrame, aop_ids: DataFrame, events: DataFrame) -> DataFrame:
    """Events of the given pathways with their titles (``Unknown`` without one), a row for each membership."""
    rows = membership.join(aop_ids.select("aop_id").distinct(), "aop_id", "left_semi")
    return rows.join(events.select("ke_id", "title"), "ke_id", "left").select("aop_id", "ke_id", F.coalesce("title", F.lit("Unknown")).alias("title"))


def mie_ao_pairs(membership: DataFrame, aop_ids: DataFrame) -> DataFrame:
    """Every initiating event with every adverse outcome of a pathway; null where a pathway lacks a side.

    The pairs are the result here; they are made within a pathway, by a join on it.
    """
    scope = aop_ids.select("aop_id").distinct()
    sides = membership.filter(F.col("role").isin(MIE, AO)).select("aop_id", "ke_id", "role").distinct()
    side = lambda role, name: scope.join(sides.filter(F.col("role") == role).select("aop_id", F.col("ke_id").alias(name)), "aop_id", "left")
    return side(MIE, "mie_id").join(side(AO, "ao_id"), "aop_id")


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Pairs, pathways, distinct events of either side, pathways without one."""
    lacks = lambda c: F.count_distinct(F.when(F.col(c).isNull(), F.col("aop_id")))
    return pairs.agg(
        F.count("*").alias("n_pairs"), F.count_distinct("aop_id").alias("n_aops"), F.count_distinct("mie_id").alias("n_mies"), F.count_distinct("ao_id").alias("n_aos"),
        lacks("mie_id").alias("aops_without_mie"), lacks("ao_id").alias("aops_without_ao"),
    )


def status_rollup(membership: DataFrame, aops: DataFrame, endorsed: str, open_license: str) -> DataFrame:
    """Statuses and licenses of an event's pathways: any endorsed, in the programme at all, only open for adoption."""
    rows = membership.select("aop_id", "ke_id").distinct().join(aops.select("aop_id", "status", "license"), "aop_id")
    known = F.col("status").isNotNull() & (F.col("status") != "")
    return rows.groupBy("ke_id").agg(
        F.count("*").alias("aop_count"),
        F.bool_or(F.coalesce(F.col("status") == endorsed, F.lit(False))).alias("any_oecd_endorsed"),
        F.bool_or(known).alias("in_oecd_aop_program"),
        F.coalesce(F.bool_and(F.col("license") == open_license), F.lit(False)).alias("only_open_for_adoption"),
        F.array_join(F.array_sort(F.collect_set("license")), "|").alias("licenses"),
    )


def selected_aops(selectors: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of selections (reason, table with aop_id) with the reasons in order."""
    rows = [s.select("aop_id").distinct().select("aop_id", F.lit(i).alias("ord"), F.lit(reason).alias("reason")) for i, (reason, s) in enumerate(selectors)]
    every = reduce(DataFrame.unionByName, rows)
    ordered = F.array_sort(F.collect_set(F.struct("ord", "reason")))
    return every.groupBy("aop_id").agg(F.array_join(F.transform(ordered, lambda r: r["reason"]), ",").alias("reasons"))


def missing_ids(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.join(known.select(key), key, "left_anti")


def bridge(first: DataFrame, second: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Two-step association left-key-right, each (left, right) once, with the key by which it came first."""
    rows = first.select(key, left, F.col("ord").alias("o1")).join(second.select(key, right, F.col("ord").alias("o2")), key)
    return rows.groupBy(left, right).agg(F.min_by(key, F.struct("o1", "o2", key)).alias("via"))


def coverage(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """For each key: in which of the sources it is (one aggregate instead of unions, intersections and differences)."""
    rows = reduce(DataFrame.unionByName, [df.select(key, *[F.lit(name == n).alias(f"in_{n}") for n in sources]) for name, df in sources.items()])
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.bool_or(f"in_{n}").alias(f"in_{n}") for n in sources])


def combined_hits(text_hits: DataFrame, member_hits: DataFrame, key: str) -> DataFrame:
    """Full outer union of two hit lists with a flag for each."""
    a, b = text_hits.select(key).distinct().withColumn("a", F.lit(True)), member_hits.select(key).distinct().withColumn("b", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.col("a").isNotNull().alias("text_match"), F.col("b").isNotNull().alias("aop_match"))


def carried_headers(rows: DataFrame, group: str, order: list[str], is_header: Column, value: str) -> DataFrame:
    """Rows under the last header above them (``header``), numbered from 0 under it (``event_index``)."""
    # Both windows go through one order, so rows are dealt and sorted once.
    w = Window.partitionBy(group).orderBy(*order)
    above = w.rowsBetween(Window.unboundedPreceding, 0)
    headed = rows.withColumn("_head", is_header).withColumns({"_n": F.row_number().over(w), "header": F.last(F.when(F.col("_head"), F.col(value)), ignorenulls=True).over(above)})
    under = headed.withColumn("_from", F.max(F.when(F.col("_head"), F.col("_n"))).over(above)).filter(~F.col("_head") & F.col("_from").isNotNull())
    return under.withColumn("event_index", F.col("_n") - F.col("_from") - 1).drop("_head", "_n", "_from")


def aop_to_kers(kers: DataFrame) -> DataFrame:
    """aop_id and its sorted ``ker_ids``; pathways without relationships are left out."""
    return kers.groupBy("aop_id").agg(F.array_sort(F.collect_set("ker_id")).alias("ker_ids"))


def events_by_term(matched: DataFrame) -> DataFrame:
    """Events of every term that has one."""
    return matched.select(F.explode("matched_terms").alias("term")).groupBy("term").agg(F.count("*").alias("events"))


def event_to_aop_summary(matched: DataFrame, found: DataFrame, aops: DataFrame, excluded: list[str], statuses: list[str]) -> DataFrame:
    """Numbers of matched events and pathways, and of pathways left after the title exclusion and the status filter."""
    titled = found.join(aops.select("aop_id", "title", "status"), "aop_id")
    kept = without_title_terms(titled, excluded)
    counted = lambda df, name, condition=None: df.agg((F.count("*") if condition is None else F.count_if(condition)).alias(name))
    left = kept.agg(F.count("*").alias("after_title_exclusion"), (F.count_if(F.col("status").isin(*statuses)) if statuses else F.count("*")).alias("after_status_filter"))
    return counted(matched, "matched_events").crossJoin(counted(found, "matched_aops")).crossJoin(left)


def pair_rows(membership: DataFrame, aop_ids: DataFrame, aops: DataFrame, events: DataFrame, matched: DataFrame, kers: DataFrame) -> DataFrame:
    """Pairs of initiating event and outcome as reported: titles, status, which side was searched for, size of the pathway; a side that isn't declared is blank."""
    pairs = mie_ao_pairs(membership, aop_ids)
    hit = matched.select("ke_id").distinct().withColumn("hit", F.lit(True))
    for side in ("mie", "ao"):
        named = events.select(F.col("ke_id").alias(f"{side}_id"), F.col("title").alias(f"{side}_title")).join(hit.select(F.col("ke_id").alias(f"{side}_id"), F.col("hit").alias(f"{side}_matched")), f"{side}_id", "left")
        pairs = pairs.join(named, f"{side}_id", "left")
        declared = F.col(f"{side}_id").isNotNull()
        pairs = pairs.withColumns({
            f"{side}_title": F.when(declared, F.coalesce(f"{side}_title", F.lit("Unknown"))).otherwise(""),
            f"{side}_matched": declared & F.coalesce(f"{side}_matched", F.lit(False)),
            f"{side}_id": F.coalesce(F.col(f"{side}_id").cast("string"), F.lit("")),
        })
    sizes = membership.groupBy("aop_id").agg(F.count_distinct("ke_id").alias("num_events"))
    edges = kers.groupBy("aop_id").agg(F.count_distinct("ker_id").alias("num_kers"))
    return pairs.join(aops, "aop_id").join(sizes, "aop_id", "left").join(edges, "aop_id", "left").na.fill(0, ["num_events", "num_kers"])


#: ``monotonically_increasing_id`` holds the partition above so many bits and the row within it below.
_ROW_BITS = 33


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in a total order, without one task that holds all.

    Sorted ranges are written once, each row with its range and its number there; the sizes of
    the ranges (a row for each shuffle partition, so fit to be broadcast) are added up over the
    written table.  Counts and rows come from the same ranges, whatever bounds were sampled.
    ``order`` must tell all rows apart; equal rows get places in no particular order.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = written(ranged, "places")
    kept = kept.withColumns({"_range": F.shiftright("_at", _ROW_BITS), "_within": F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1})
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return kept.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_within")).drop("_at", "_range", "_within", "_before")
