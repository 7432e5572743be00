"""Removal of repeated word sequences by relative Lempel-Ziv parsing against indexed blocks of reference.

A window is ``LENGTH`` consecutive words of a text; it repeats if the same words start anywhere
else, in the same text or another.  All words of repeating windows go, the first ones included.

1. Every window has an anchor, the run of ``GRAM`` words in it with the least hash (leftmost of
   equals), so equal windows have equal anchors at equal offsets.  Consecutive windows with one
   anchor are a stretch of at most 62 words.  Only stretches whose anchor's gram occurs again
   can hold a repeating window; the gram decides which reference blocks a text must meet.
2. Stretches that are equal as a whole repeat.  Of the others one of each kind is fetched and put
   into the reference block of its gram.  A block is indexed by a suffix array over its words, and
   every stretch that is the only one of its kind is parsed against the block (its own place apart):
   greedily, the longest factor found elsewhere, then the next.  Factors of ``LENGTH`` words or more
   are duplicate spans.  A window that lies across the end of a factor can only repeat if it
   holds no whole factor with the word behind it, so it lies in two neighbours: these windows, if
   the two are long enough together, are looked up in the index.
3. A gram with over ``SPREAD`` different stretches would fill a block.  Its windows are counted by a
   digest of their words instead (a grouped count, whatever the number of rows).
4. The ranges are united for each text and cut out of it.

Whole stretches are compared by 64-bit hashes among those with one gram hash, windows of very
common grams by 128-bit digests, all else word by word.

Defined cases: a null text has no words; texts of fewer than ``LENGTH`` words lose nothing; equal
rows are rows of their own, so each repeats the other; a null key is told apart by its text; words
of a MiB or more are compared by digest when anchors are sought; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_batches, release_memory, written

LENGTH, GRAM = 35, 8
GRAMS = LENGTH - GRAM + 1
#: Bytes of text whose anchors are sought at a time; words from this size on are hashed as their digest.
SLICE, LONG_WORD = 1 << 20, 1 << 20
#: Words of a reference block; different stretches of a gram beyond which its windows are counted one by one.
BLOCK_WORDS, SPREAD = 400_000, 2_000
#: Doublings after which every suffix of a stretch (at most 62 words and its end) is told apart.
DOUBLINGS = 6

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_random = np.random.default_rng(35)
_BYTES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = {n: np.uint64(int(x) * 2 + 1) for n, x in zip((1, 2, 4), _random.integers(1 << 40, 1 << 62, 3), strict=True)}
_ROOT = int(_random.integers(1 << 40, 1 << 62)) * 2 + 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for root in (_ROOT, pow(_ROOT, -1, 1 << 64)):
            out, done, step = np.ones(n, dtype=np.uint64), 1, root
            while done < n:
                take = min(done, n - done)
                out[done : done + take] = out[:take] * np.uint64(step)
                step = step * step & 0xFFFFFFFFFFFFFFFF
                done += take
            _POWERS.append(out)
    return _POWERS[0], _POWERS[1]


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def _sums(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the ranges ``first`` to ``end`` of ``values``."""
    powers, inverse = _powers(max(2 * SLICE + LONG_WORD, len(values) + 1))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * powers[: len(values)])])
    return (total[end] - total[first]) * inverse[first]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text (bytes) begin and end."""
    blank = np.concatenate([[True], _IS_BLANK[raw], [True]])
    return np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])


def _pieces(raw: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """(number of the first word, piece): of a long text, pieces that share ``LENGTH`` - 1 words, so each window is in one."""
    start, words, more = 0, 0, size
    while start + more < len(raw):
        found = _BLANK.search(raw, start + more)
        if found is None:
            break
        piece = raw[start : found.start()]
        parts = piece.rsplit(None, LENGTH - 1)
        if len(parts) < LENGTH:
            more += size
            continue
        yield words, piece
        start, words, more = start + len(parts[0]), words + len(parts[0].split()), size
    yield words, raw[start:]


def _digested(raw: bytes) -> bytes:
    if len(raw) < LONG_WORD:
        return raw
    return re.sub(rb"[^\x20\x09-\x0D]{%d,}" % LONG_WORD, lambda m: b"\x00" + hashlib.blake2b(m[0]).hexdigest().encode(), raw)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the stretches of texts: gram hash, stretch hash, text, first window, windows less one, words before the gram."""
    raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    starts, ends = word_bounds(raw)
    windows = len(starts) - LENGTH + 1
    if windows <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    sizes = np.array([len(t) + 1 for t in texts])
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    word = _spread(_sums(_BYTES[raw], starts, ends) + (ends - starts).astype(np.uint64))
    h = word
    for n in (1, 2, 4):
        h = h[:-n] * _STEPS[n] + h[n:]
    h = _spread(h)
    least = h >> np.uint64(21) << np.uint64(21) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while 2 * n <= GRAMS:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    least = np.minimum(least[:windows], least[GRAMS - n : GRAMS - n + windows])
    gram = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
    within = np.flatnonzero(doc[:windows] == doc[LENGTH - 1 :])
    if not len(within):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    new = np.flatnonzero(np.concatenate([[True], (within[1:] != within[:-1] + 1) | (gram[within[1:]] != gram[within[:-1]])]))
    first, last = within[new], within[np.concatenate([new[1:], [len(within)]]) - 1]
    at = gram[first]
    before, span = at - first, last - first
    stretch = _spread(_sums(word, first, last + LENGTH) + (before * 64 + span).astype(np.uint64))
    begins = np.searchsorted(doc, np.arange(len(texts)))
    return h[at].view(np.int64), stretch.view(np.int64), doc[first], first - begins[doc[first]], span, before


_STRETCHES = "gram long, stretch long, id long, mark int, low int, span int, before int"


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """The stretches of all texts (columns ``id``, ``mark``, ``text``) with the hash of their anchor's gram and their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            gram, stretch, doc, low, span, before = anchors([t for *_, t in held])
            ids, marks, words = (np.array([row[k] for row in held], dtype=np.int64) for k in range(3))
            columns = [gram, stretch, ids[doc], marks[doc].astype(np.int32), (low + words[doc]).astype(np.int32), span.astype(np.int32), before.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "stretch", "id", "mark", "low", "span", "before"])

        for batch in batches:
            for key, mark, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                for words, piece in _pieces(_digested(text.as_py()), SLICE):
                    held.append((key.as_py(), mark.as_py(), words, piece))
                    size += len(piece)
                    if size >= SLICE:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            yield out()
        _POWERS.clear()
        release_memory()

    bounded_batches(docs.sparkSession)
    return docs.select("id", "mark", "text").mapInArrow(run, _STRETCHES)


class ReferenceBlock:
    """Stretches of words one after the other, indexed: how long a match each place has elsewhere in the block."""

    def __init__(self, stretches: list[list[bytes]]) -> None:
        self.sizes = np.array([len(s) for s in stretches], dtype=np.int64)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        flat = np.empty(int(self.sizes.sum()), dtype=object)
        flat[:] = [w for s in stretches for w in s]
        codes, known = pd.factorize(flat)
        ranks = np.empty(len(flat) + len(stretches), dtype=np.int64)
        ends = np.zeros(len(ranks), dtype=bool)
        ends[self.begins + self.sizes] = True
        ranks[~ends], ranks[ends] = codes, len(known) + np.arange(len(stretches))  # every end is a word of its own
        levels = [ranks]
        for k in range(DOUBLINGS):
            low = levels[-1]
            high = np.concatenate([low[1 << k :] + 1, np.zeros(min(1 << k, len(low)), dtype=np.int64)])
            levels.append(np.unique(low * (len(low) + 2) + high, return_inverse=True)[1].ravel())
        order = np.argsort(levels[-1], kind="stable")  # the suffix array
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(a), dtype=np.int64)
        for k in range(DOUBLINGS - 1, -1, -1):
            same = levels[k][np.minimum(a + shared, len(ranks) - 1)] == levels[k][np.minimum(b + shared, len(ranks) - 1)]
            shared += same << k
        beside = np.concatenate([[0], shared, [0]])
        self.longest = np.empty(len(ranks), dtype=np.int64)
        self.longest[order] = np.maximum(beside[:-1], beside[1:])

    def parse(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy factors of some stretches: stretch, where the factor begins in it, its length (a word that is nowhere else: 0)."""
        at, found = np.zeros(len(which), dtype=np.int64), []
        while len(which):
            size = self.longest[self.begins[which] + at]
            found.append((which, at, size))
            at = at + np.maximum(size, 1)
            left = at < self.sizes[which]
            which, at = which[left], at[left]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * 3
        order = np.lexsort([columns[1], columns[0]])
        return columns[0][order], columns[1][order], columns[2][order]

    def duplicate_windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges of windows (stretch, first, last) that some stretches share with another place in the block."""
        owner, at, size = self.parse(which)
        long = size >= LENGTH
        found = [(owner[long], at[long], at[long] + size[long] - LENGTH)]
        # Across the end of a factor: begins behind its first word, ends within the next factor.
        next_ = np.flatnonzero((owner[1:] == owner[:-1]) & (size[:-1] + size[1:] > LENGTH))
        end = at[next_] + size[next_]
        first, last = np.maximum(at[next_] + 1, end - LENGTH + 1), np.minimum(end - 1, end + size[next_ + 1] - LENGTH)
        some = last >= first
        owner, first, n = owner[next_][some], first[some], (last - first + 1)[some]
        place = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(owner, n)
        known = self.longest[self.begins[owner] + place] >= LENGTH
        found.append((owner[known], place[known], place[known]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _parse_block(table: pa.Table) -> pa.Table:
    """Window ranges that repeat, of the stretches of one block that are the only ones of their kind."""
    ids, marks, lows = (table[c].to_numpy() for c in ("id", "mark", "low"))
    block = ReferenceBlock([w.as_py().split() for w in table["words"]])
    owner, first, last = block.duplicate_windows(np.flatnonzero(table["only"].to_numpy(zero_copy_only=False)))
    return pa.table({"id": ids[owner], "mark": marks[owner], "low": (lows[owner] + first).astype(np.int32), "high": (lows[owner] + last).astype(np.int32)})


def _fetched(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """The words of the wanted stretches of texts; of very common grams, a digest of each window instead."""
    out = []
    for key, mark, text, wanted in zip(*(batch.column(k) for k in range(4)), strict=True):
        raw, key, mark = text.as_py(), key.as_py(), mark.as_py()
        starts, ends = word_bounds(np.frombuffer(raw, dtype=np.uint8))
        for w in wanted.as_py():
            low, span = w["low"], w["span"]
            words = raw[starts[low] : ends[low + span + LENGTH - 1]]
            if not w["common"]:
                out.append((key, mark, low, w["gram"], w["only"], words, None))
                continue
            told = words.split()
            for i in range(span + 1):
                digest = hashlib.blake2b(b" ".join(told[i : i + LENGTH]), digest_size=16).digest()
                out.append((key, mark, low + i, w["gram"], w["only"], None, digest))
    if not out:
        return None
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["id", "mark", "low", "gram", "only", "words", "digest"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``own_id``, ``id`` and ``mark`` (which tell rows of different texts apart) and ``text`` (bytes, never null)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("id"), F.hash(text).alias("mark"), text.alias("text"))


def duplicate_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``mark`` (hash of the text), ``low``, ``high``: ranges of first words of windows that repeat; ranges may overlap."""
    rows = _keyed(docs, id_col, text_col).select("id", "mark", "text")
    again = _anchor_rows(rows).groupBy("gram").agg(F.count("*").alias("n"), F.min("stretch").alias("least"), F.max("stretch").alias("most"))
    # Written, so that the join below deals both of its sides and can split a gram that many texts share.
    again = written(again.filter("n > 1").select("gram", (F.col("least") != F.col("most")).alias("differ")), "repeated-grams")
    shared = written(_anchor_rows(rows).join(again, "gram"), "shared-stretches")
    ranged = lambda df: df.select("id", "mark", "low", (F.col("low") + F.col("span")).alias("high"))
    sure = ranged(shared.filter("not differ"))
    other = shared.filter("differ")
    kinds = other.groupBy("gram", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "low", "span")).alias("one"))
    kinds = written(kinds, "kinds-of-stretches")
    sure = sure.unionByName(ranged(other.join(kinds.filter("n > 1").select("gram", "stretch"), ["gram", "stretch"])))

    common = kinds.groupBy("gram").agg(F.count("*").alias("k")).filter(F.col("k") > SPREAD).select("gram", F.lit(True).alias("common"))
    asked = kinds.join(common, "gram", "left").select("one.*", "gram", (F.col("n") == 1).alias("only"), F.coalesce("common", F.lit(False)).alias("common"))
    wanted = asked.groupBy("id", "mark").agg(F.collect_list(F.struct("low", "span", "gram", "only", "common")).alias("wanted"))
    texts = rows.join(wanted, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("id", "mark", "text", "wanted")
    parts = written(arrow_map(texts, _fetched, "id long, mark int, low int, gram long, only boolean, words binary, digest binary"), "stretches")

    words = kinds.agg(F.sum(F.col("one.span") + LENGTH)).first()[0] or 0
    blocks = max(12, -(-words // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("gram"), F.lit(blocks)).alias("block")
    parsed = parts.filter("words is not null").select(block, "id", "mark", "low", "only", "words").groupBy("block").applyInArrow(_parse_block, "id long, mark int, low int, high int")
    counted = parts.filter("digest is not null")
    repeated = written(counted.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "repeated-windows")
    common_ones = counted.filter("only").join(repeated, "digest").select("id", "mark", "low", F.col("low").alias("high"))
    return sure.unionByName(parsed).unionByName(common_ones)


def remove_duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key, ``n_words``, ``n_removed`` and ``kept`` (bytes: the words left, joined by a blank) of every row of ``docs``."""
    rows = _keyed(docs, id_col, text_col)
    ranges = duplicate_ranges(docs, id_col, text_col).groupBy("id", "mark").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    ranges = written(ranges, "duplicate-ranges")
    joined = rows.join(ranges, ["id", "mark"], "left").select("own_id", "text", F.transform("ranges", lambda r: r["low"]).alias("low"), F.transform("ranges", lambda r: r["high"]).alias("high"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [kept_words(t.as_py(), low.as_py(), high.as_py()) for t, low, high in zip(batch.column(1), batch.column(2), batch.column(3), strict=True)]
        total, removed, kept = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    return arrow_map(joined, cut, f"id {kind}, n_words long, n_removed long, kept binary").withColumnRenamed("id", id_col)


def kept_words(text: bytes, low: list[int] | None, high: list[int] | None) -> tuple[int, int, bytes]:
    """Number of words, of removed words, and the words left, given ranges of first words of repeating windows."""
    cuts: list[list[int]] = []
    for a, b in sorted(zip(low or (), high or (), strict=True)):
        if cuts and a <= cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], b + LENGTH)
        else:
            cuts.append([a, b + LENGTH])
    total, start, out, k = 0, 0, [], 0
    while start < len(text):
        found = _BLANK.search(text, start + SLICE) if start + SLICE < len(text) else None
        end = found.start() if found else len(text)
        words = text[start:end].split()
        keep, at = [], 0
        while k < len(cuts) and cuts[k][0] - total < len(words):
            keep += words[at : max(at, cuts[k][0] - total)]
            at = max(at, min(cuts[k][1] - total, len(words)))
            if cuts[k][1] - total > len(words):
                break
            k += 1
        keep += words[at:]
        total += len(words)
        start = end + 1
        if keep:
            out.append(b" ".join(keep))
    return total, sum(b - a for a, b in cuts), b" ".join(out)


#: The same by windows spelled out.
PASSAGES_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word, len(ws) AS n FROM d),
k AS (SELECT r, i, md5(array_to_string(ws[i:i + {LENGTH - 1}], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - {LENGTH} + 2)) AS i FROM d WHERE len(ws) >= {LENGTH})),
g AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
c AS (SELECT w.r, w.i, w.word, count(g.h) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) > 0 AS gone
      FROM w LEFT JOIN k ON k.r = w.r AND k.i = w.i LEFT JOIN g USING (h)),
o AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (r)"""
