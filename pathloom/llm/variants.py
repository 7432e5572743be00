"""Grouping of spelling variants by a rare-first prefix filter over positional bigrams.

1. Words are counted: runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; of a
   known share of runs (told by a checksum of key and run) one letter is missing.  Each slice of
   texts is counted by itself, then counts are added up.
2. Bigrams are ordered by the number of words that have them, rarest first, then by text; equal
   bigrams of a word by place.  One edit changes at most two bigrams of each of two words, and what
   it leaves keeps its order, so two near words share one of their three first bigrams.
3. These three are joined, with limits on length and place: words of one length have the shared
   bigram at one place, a word that is longer by one has it there or one place on.  So the join is
   an equality of bigram, place and length; letters held by one word only (as bits) must be few
   enough, then the edit distance is checked.
4. A word's form is its most frequent near word, if that is frequent enough; forms of forms are
   followed by doubling.  Counts grow by ``FACTOR`` at each step, so five doublings reach every end.

Shuffles carry words with counts, never texts; bigrams are at most 90 x 90.

Defined cases: null and empty texts have no words; a null key counts as an empty key in the
checksum; repeated rows count as often as they occur; other columns are ignored; texts of any
length are read in pieces that end between runs; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, id_and_text, release_memory, table, written

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: How many times as frequent as a word its form must be; one in so many runs loses a letter.
FACTOR, SHARE = 5, 199
#: Doublings of links whose counts grow by ``FACTOR`` each: 5 ** 28 is beyond any count.
DOUBLINGS = 5
GRAM, PREFIX = 2, 3
#: Characters read at a time; different words that a slice holds before it is passed on.
PIECE, WORDS = 1 << 20, 100_000

_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]
_AS_BLANK = bytes((c + 32 if c < 0x5B else c) if c in set(_LETTERS) else 0x20 for c in range(256))
_BETWEEN = re.compile(r"[^A-Za-zÀ-ÿ]")


def _pieces(text: str, size: int) -> Iterator[str]:
    start = 0
    while start + size < len(text):
        found = _BETWEEN.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def runs_of(text: str) -> Counter:
    """Lower-cased runs (Latin-1 bytes) of a text with their counts."""
    found: Counter = Counter()
    for piece in _pieces(text, PIECE):
        found.update(piece.encode("latin-1", "replace").translate(_AS_BLANK).split())
    return found


def shortened(key: str, run: bytes, share: int) -> bytes:
    """The run, or the run without one letter if its checksum with the key falls to that."""
    h = zlib.crc32(f"{key}:{run.decode('latin-1')}".encode())
    return run if h % share else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            told = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return told

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key = key.as_py() or ""
                for word, n in runs_of(text.as_py() or "").items():
                    held[shortened(key, word, share)] += n
                if len(held) >= WORDS:
                    yield out()
        if held:
            yield out()
        release_memory()

    bounded_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col).select(F.col("id").cast("string"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rare_bigrams(words: DataFrame) -> DataFrame:
    """``word``, ``length`` and three rows of ``gram``, ``place``: the bigrams of it that fewest words have."""
    places = F.sequence(F.lit(1), F.length("word") - GRAM + 1)
    grams = words.select("word", F.explode(F.transform(places, lambda p: F.struct(F.substring(F.col("word"), p, F.lit(GRAM)).alias("gram"), p.alias("place")))).alias("b")).select("word", "b.*")
    known = grams.groupBy("gram").agg(F.count_distinct("word").alias("held"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("held", "gram", "place"))), 1, PREFIX)
    # at most 90 x 90 bigrams
    rare = grams.join(F.broadcast(known), "gram").groupBy("word").agg(first.alias("first"))
    return rare.select("word", F.length("word").alias("length"), F.inline("first")).drop("held")


def _letters(word: Column) -> Column:
    """The letters of a word as bits (code points modulo 64)."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 64).cast("int"))))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of words one inserted, deleted or replaced code point apart, each once, the longer or greater one second."""
    rare = written(rare_bigrams(words).withColumn("letters", _letters(F.col("word"))), "rare-bigrams")
    seek = F.array(*[F.struct((F.col("length") + longer).alias("length"), (F.col("place") + on).alias("place")) for longer, on in ((0, 0), (1, 0), (1, 1))])
    one = rare.select(F.col("word").alias("a"), F.col("letters").alias("letters_a"), F.col("length").alias("length_a"), F.col("gram").alias("gram_a"), F.inline(seek))
    other = rare.select(F.col("word").alias("b"), F.col("letters").alias("letters_b"), F.col("gram").alias("gram_b"), F.col("length").alias("length_b"), F.col("place").alias("place_b"))
    unlike = F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b")))
    once = (F.col("length_a") < F.col("length_b")) | (F.col("a") < F.col("b"))
    same = (F.col("gram_a") == F.col("gram_b")) & (F.col("length") == F.col("length_b")) & (F.col("place") == F.col("place_b"))
    met = one.join(other, same & once & (unlike <= 2) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b").distinct()


def variant_forms(counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of all words (``word``, ``n``) that are long and frequent enough."""
    if least_length < GRAM + PREFIX - 1:
        raise ValueError("shorter words have fewer than three bigrams")
    words = written(counts.filter((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    pairs = written(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.less") >= factor * F.col("n")
    forms = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    forms = written(forms, "forms")
    links = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_forms(word_counts(table(spark, sf_dir, "documents")))
