"""Fuzzy matching of names by the Ratcliff-Obershelp ratio."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Words that say nothing about which family a name means.
GENERIC_SUFFIXES = frozenset("receptor receptors transporter transporters channel channels enzyme enzymes kinase kinases r activity binding inhibition activation".split())


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def weighted_ratio(a: str, b: str) -> float:
    """Mean of the ratio and that of the names without generic words, where both keep some."""
    bare = [" ".join(w for w in x.lower().split() if w not in GENERIC_SUFFIXES) for x in (a, b)]
    return (ratio(a, b) + SequenceMatcher(None, *bare).ratio()) / 2 if all(bare) else ratio(a, b)


#: Classes of letters (code points modulo 64) and how many of each are counted one by one: a long for each count.
_CLASSES, _COUNTED = 64, 4
#: Titles of a block; every block meets all terms.
TITLE_BLOCK = 20_000
_PROFILE = StructType([StructField("low", StringType()), StructField("size", IntegerType()), StructField("over", IntegerType()), *[StructField(f"c{k}", LongType()) for k in range(_COUNTED)]])


def _profile(low: str) -> tuple:
    counts = Counter(ord(c) % _CLASSES for c in low)
    bits = [sum(1 << c for c, n in counts.items() if n > k) for k in range(_COUNTED)]
    return low, len(low), sum(max(0, n - _COUNTED) for n in counts.values()), *[b - (1 << 64) if b >> 63 else b for b in bits]


def _bare(low: str) -> str:
    return " ".join(w for w in low.split() if w not in GENERIC_SUFFIXES)


@F.pandas_udf(_PROFILE)
def _full_profile(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_profile(t.lower()) for t in texts], columns=_PROFILE.names)


@F.pandas_udf(_PROFILE)
def _bare_profile(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_profile(_bare(t.lower())) for t in texts], columns=_PROFILE.names)


def _length_bound(a: Column, b: Column) -> Column:
    """At most this is the ratio of two texts of such lengths."""
    both = a["size"] + b["size"]
    return F.when(both == 0, 1.0).otherwise(2.0 * F.least(a["size"], b["size"]) / both)


def _letter_bound(a: Column, b: Column) -> Column:
    """At most this is the ratio of two texts with such letters: the letters they share, order aside."""
    shared = sum((F.bit_count(a[f"c{k}"].bitwiseAND(b[f"c{k}"])) for k in range(_COUNTED)), F.least(a["over"], b["over"]))
    both = a["size"] + b["size"]
    return F.when(both == 0, 1.0).otherwise(2.0 * shared / both)


def _bound(kind: Callable[[Column, Column], Column], weighted: bool) -> Column:
    full, bare = kind(F.col("a"), F.col("b")), kind(F.col("bare_a"), F.col("bare_b"))
    return F.when((F.col("bare_a.size") > 0) & (F.col("bare_b.size") > 0), (full + bare) / 2).otherwise(full) if weighted else full


class _Subsequence:
    """Length of the longest common subsequence with one text: no less than what the ratio counts."""

    def __init__(self, text: str) -> None:
        self.size, self.places = len(text), {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def bound(self, other: str) -> float:
        left = (1 << self.size) - 1
        for c in other:
            hit = left & self.places.get(c, 0)
            left = (left + hit) | (left - hit)
        both = self.size + len(other)
        return 2.0 * (self.size - (left & (1 << self.size) - 1).bit_count()) / both if both else 1.0


def close_pairs(terms: DataFrame, titles: DataFrame, threshold: float, weighted: bool = True) -> DataFrame:
    """Pairs of a ``term`` and a ``title`` (``ord``) whose ratio may reach the threshold, by lengths and letters (``bound``).

    Titles are dealt into blocks, and every block meets all terms: a stated set against all rows.
    Only pairs within both bounds become rows.
    """
    one = terms.select("term", _full_profile("term").alias("a"), _bare_profile("term").alias("bare_a"))
    blocks = max(int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-titles.count() // TITLE_BLOCK))
    other = titles.select("title", "ord", _full_profile("title").alias("b"), _bare_profile("title").alias("bare_b"), F.pmod(F.xxhash64("title"), F.lit(blocks)).alias("title_block"))
    asked = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    near = (_bound(_length_bound, weighted) >= threshold) & (_bound(_letter_bound, weighted) >= threshold)
    met = asked.join(other, (F.col("block") == F.col("title_block")) & near)
    return met.select("term", "title", "ord", *[F.col(f"{side}.low").alias(f"{side}_low") for side in ("a", "bare_a", "b", "bare_b")], _bound(_letter_bound, weighted).alias("bound"))


def _best_of(pairs: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Of each term and partition the best title: pairs come by falling bound, so most end at a bound below the best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, best, rows = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if term is None or row["term"] != term[0]:
                    if best is not None:
                        rows.append((term[0], *best))
                    term, best = (row["term"], _Subsequence(row["a_low"]), _Subsequence(row["bare_a_low"])), None
                least = threshold if best is None else best[0]
                if row["bound"] < least:
                    continue
                bare = weighted and row["bare_a_low"] and row["bare_b_low"]
                reach = term[1].bound(row["b_low"])
                if (reach + (term[2].bound(row["bare_b_low"]) if bare else reach)) / 2 < least:
                    continue
                score = SequenceMatcher(None, row["a_low"], row["b_low"]).ratio()
                if bare:
                    score = (score + SequenceMatcher(None, row["bare_a_low"], row["bare_b_low"]).ratio()) / 2
                if score >= threshold and score > 0 and (best is None or (score, -row["ord"]) > (best[0], -best[1])):
                    best = (score, row["ord"], row["title"])
            if rows:
                yield _rows(rows)
                rows = []
        if best is not None:
            yield _rows([(term[0], *best)])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.int64(), pa.string()), strict=True)], ["term", "score", "ord", "title"])

    return pairs.sortWithinPartitions("term", F.desc("bound"), "ord").mapInArrow(run, "term string, score double, ord long, title string")


def best_matches(terms: DataFrame, titles: DataFrame, threshold: float, term: str = "term", weighted: bool = True) -> DataFrame:
    """Each distinct term with its best title (of equals the one that comes first) and score; null below ``threshold``.

    ``titles``: title, ord (a long that tells their order).  The ratio counts letters in common
    blocks, so it is at most what lengths, shared letters and the longest common subsequence
    allow; the first two are checked in the join, the third before the ratio itself.
    """
    asked = terms.select(F.col(term).alias("term")).filter("term is not null").distinct()
    known = titles.filter("title is not null").groupBy("title").agg(F.min("ord").cast("long").alias("ord"))
    found = _best_of(close_pairs(asked, known, threshold, weighted), threshold, weighted)
    best = found.groupBy("term").agg(F.max(F.struct("score", (-F.col("ord")).alias("back"), "title")).alias("best"))
    return asked.join(best, "term", "left").select(F.col("term").alias(term), F.col("best.title").alias("matched_term"), F.col("best.score").alias("match_score"))


def bound_report(terms: DataFrame, titles: DataFrame, threshold: float, weighted: bool = True) -> DataFrame:
    """How many pairs of a term and a title there are, and how many the bound by lengths and letters leaves to be compared."""
    pairs = close_pairs(terms, titles, threshold, weighted).agg(F.count("*").alias("compared"))
    return terms.agg(F.count("term").alias("terms")).crossJoin(titles.agg(F.count("title").alias("titles"))).crossJoin(pairs)  # one row each


def reviewed(matches: DataFrame, decisions: DataFrame, threshold: float, term: str = "term") -> DataFrame:
    """Matches with recorded decisions (``human_verified``, ``suggested_match``); ``needs_review`` where one is asked for."""
    joined = matches.join(decisions.select(term, "human_verified", "suggested_match"), term, "left")
    return joined.withColumn("needs_review", F.col("match_score").isNotNull() & (F.lit(threshold == 0) | (F.col("match_score") < threshold)))


def review_summary(reviewed: DataFrame) -> DataFrame:
    """Matches in all, reviewed (a decision either way), skipped, accepted, rejected, and with a suggestion."""
    verdict = F.col("human_verified")
    return reviewed.agg(
        F.count("*").alias("total"), F.count(verdict).alias("reviewed"), (F.count("*") - F.count(verdict)).alias("skipped"),
        F.count_if(verdict).alias("accepted"), F.count_if(~verdict).alias("rejected"), F.count_if(F.coalesce("suggested_match", F.lit("")) != "").alias("suggested"),
    )


def enriched_families(families: DataFrame, events: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Target families (target_family, h_events) with the best event title for those without curated events.

    ``events``: ke_id, title, ord; of one title the last id counts, of equal scores the title that came first.
    """
    titles = events.groupBy("title").agg(F.min("ord").alias("first"), F.max_by("ke_id", "ord").alias("matched_event_id")).filter("title is not null")
    curated = F.size(F.coalesce("h_events", F.array().cast("array<string>"))) > 0
    found = best_matches(families.filter(~curated), titles.select("title", F.col("first").alias("ord")), threshold, "target_family")
    named = found.join(titles.select(F.col("title").alias("matched_term"), "matched_event_id"), "matched_term", "left")
    return families.withColumn("match_with_h_event", curated).join(named, "target_family", "left")


def match_metrics(matches: DataFrame) -> DataFrame:
    """Totals, matched, unmatched, rate and mean score."""
    n, hit = F.count("*"), F.count("match_score")
    return matches.agg(n.alias("total"), hit.alias("matched"), (n - hit).alias("unmatched"), (100 * hit / F.greatest(n, F.lit(1))).alias("match_rate"), F.coalesce(F.avg("match_score"), F.lit(0.0)).alias("average_score"))
