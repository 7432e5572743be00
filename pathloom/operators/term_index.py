"""A positional index of words, so that a search reads only texts that can hold one of its terms.

The index has a row for each word of each text (``entity_id``, ``field``) with the places at which it
stands.  It is written sorted by word, so a search for some words reads the row groups that hold
them.  A phrase is a join on places: its words at their distance from one start.  What is found so
is a superset of what the pattern of the term finds (signs and blanks between words are not in the
index), so the texts found are scanned as before; results are those of the full scan.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

_WORD = r"(?U)\w+"
#: Tasks that the texts of one word are dealt to: a word of nearly all texts isn't one task's.
SPREAD = 64


def term_words(term: str) -> list[str]:
    """The words of a term, in lower case; none for a term with signs whose kind Python and the pattern may see differently."""
    low = term.lower()
    if any(not c.isascii() and unicodedata.category(c)[0] not in "LZ" for c in low):
        return []
    return re.findall(r"\w+", low)


def _merged(texts: DataFrame) -> DataFrame:
    """entity_id, field, words: the words of each text in order; those of texts under one key (few, if any) one behind the other."""
    words = texts.filter("text is not null").select("entity_id", "field", F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)).alias("words"))
    key = ["entity_id", "field"]
    several = written(texts.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated-keys")
    if several.isEmpty():
        return words
    known = several.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = F.col("entity_id").eqNullSafe(F.col("_entity_id")) & F.col("field").eqNullSafe(F.col("_field"))
    merged = words.join(known, same, "left_semi").groupBy(*key).agg(F.flatten(F.collect_list("words")).alias("words"))
    return words.join(known, same, "left_anti").unionByName(merged)


def text_words(texts: DataFrame) -> DataFrame:
    """word, entity_id, field, places (from 0, in order), n: a row for each different word of each text.

    The words of a text are sorted within its row and cut where the word changes: no row for each
    place is made, and nothing is shuffled.
    """
    spots = F.sort_array(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))))
    rows = _merged(texts).select("entity_id", "field", F.explode(F.array(spots)).alias("spots"))
    new = lambda i: (i == 0) | (F.get("spots", i)["word"] != F.get("spots", i - 1)["word"])
    starts = F.filter(F.sequence(F.lit(0), F.size("spots") - 1), new)
    rows = rows.filter(F.size("spots") > 0).select("entity_id", "field", "spots", F.explode(F.array(starts)).alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("spots")))
    cut = F.arrays_zip(F.col("starts").alias("start"), ends.alias("end"))
    word = lambda c: F.struct(F.get("spots", c["start"])["word"].alias("word"), F.transform(F.slice("spots", c["start"] + 1, c["end"] - c["start"]), lambda s: s["place"]).alias("places"), (c["end"] - c["start"]).alias("n"))
    return rows.select("entity_id", "field", F.inline(F.transform(cut, word))).select("word", "entity_id", "field", "places", "n")


def term_index(texts: DataFrame) -> DataFrame:
    """``text_words``, dealt by word and sorted by it within each file; no sample is drawn first, so texts are cut once."""
    spread = F.pmod(F.xxhash64("entity_id"), F.lit(SPREAD))
    return text_words(texts).repartition("word", spread).sortWithinPartitions("word", "entity_id")


def phrase_places(index: DataFrame, terms: list[str]) -> DataFrame:
    """entity_id, field, term_ord, start: where the words of each term stand one behind the other; terms without a word are left out."""
    rows = [(i, word, offset, len(words)) for i, t in enumerate(terms) for words in [term_words(t)] for offset, word in enumerate(words)]
    asked = index.sparkSession.createDataFrame(rows, "term_ord int, word string, offset int, size int")
    some = index.filter(F.col("word").isin(sorted({r[1] for r in rows}))) if rows else index.filter(F.lit(False))
    # the words of the terms: configuration
    met = some.join(F.broadcast(asked), "word").select("entity_id", "field", "term_ord", "size", "offset", F.explode("places").alias("place"))
    starts = met.groupBy("entity_id", "field", "term_ord", "size", (F.col("place") - F.col("offset")).alias("start")).agg(F.count_distinct("offset").alias("held"))
    return starts.filter(F.col("held") == F.col("size")).select("entity_id", "field", "term_ord", "start")


def texts_to_scan(texts: DataFrame, index: DataFrame, terms: list[str], whole_fields: list[str] | None = None) -> DataFrame:
    """The texts that can hold one of the terms; those of ``whole_fields`` all, and all texts where a term has no word to look up."""
    if any(not term_words(t) for t in terms):
        return texts
    found = phrase_places(index, terms).select("entity_id", "field").distinct()
    kept = texts.join(found, ["entity_id", "field"], "left_semi") if not whole_fields else texts.filter(~F.col("field").isin(whole_fields)).join(found, ["entity_id", "field"], "left_semi")
    return kept if not whole_fields else kept.unionByName(texts.filter(F.col("field").isin(whole_fields)))
