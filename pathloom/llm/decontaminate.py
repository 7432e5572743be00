"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit distances.

A document holds an item if some passage of it, of any length, is within
``floor((1 - similarity) * words)`` word edits of it (words: runs of word characters, lower
case; items of fewer than five words must then be there exactly).  Windows of the item's number
of words begin at every word, the last ones cut off by the text's end.  Of a passage within
that distance, the window at its start holds all but as many of the item's words as there are
edits: a dropped or changed word spoils one, an inserted one pushes one out at most.  So a
window is passed over that holds too few words of items of its length, or of each such item
none of its ``floor((1 - similarity) * words) + 1`` rarest words.

The others are embedded by the CGK random walk: step ``j`` copies the word under the pointer,
and a random bit of (step, word) decides whether the pointer moves on; few edits then cost few
differing symbols.  ``REPEATS`` samples of ``SAMPLED`` positions are hash keys, looked up in a
table of the keys of all items of that length: what a window costs does not grow with the
number of items.  Of the pairs found, those that share too few different words go; around
the rest, the passage nearest to the item is found by an edit distance that leaves both ends
free, over as many more words on either side as edits are allowed.  Recall at the very bound
is measured in the tests (0.97 or more); nearer passages are found more often.

Items are broadcast in slices of at most ``SLICE_WORDS`` words, one pass over the documents for
each, so a larger benchmark means more passes and not a larger broadcast.

Defined cases: null and empty documents hold nothing; items that are null, have no words or have
fewer than ``least_words`` match nothing; null keys and repeated rows are reported one for one, once for
each item; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, id_and_text

SAMPLED, REPEATS = 2, 96
SLICE_WORDS = 1_000_000
CHUNK_CHARS = 1 << 20
_WORD = re.compile(r"\w+")
_NONE, _PAD = -1, -2


def words_of(text: str) -> list[str]:
    """Lower-cased words, one for each run of word characters of the text as it is."""
    lower = text.lower()
    return _WORD.findall(lower) if len(lower) == len(text) and text.isascii() else [w.lower() for w in _WORD.findall(text)]


#: Random bits of the walks by step and word, taken modulo these numbers: words that share a bit are still different symbols.
STEPS, SLOTS = 128, 1024
_WALKS: dict[int, np.ndarray] = {}


def _walk_bits(repeats: int, seed: int = 5) -> np.ndarray:
    """For each step, word slot and repeat, whether the pointer moves on."""
    if repeats not in _WALKS:
        _WALKS[repeats] = np.random.default_rng(seed).integers(0, 2, (STEPS, SLOTS * repeats), dtype=np.int8)
    return _WALKS[repeats]


def sample_keys(windows: np.ndarray, repeats: int = REPEATS, sampled: int = SAMPLED, seed: int = 3) -> np.ndarray:
    """Hash keys, one for each window (row of word numbers) and repeat, of sampled positions of its embedding."""
    n, length = windows.shape
    # Sampled places lie far apart and before most walks have ended: near ones often show the same word, late ones the padding.
    draw, room = np.random.default_rng(seed + length), max(1, 7 * length // 4)
    apart = room // sampled
    places = (draw.integers(0, room, (repeats, 1)) + np.arange(sampled) * apart + draw.integers(-(apart // 4), apart // 4 + 1, (repeats, sampled))) % room
    order = np.argsort(-places.max(axis=1), kind="stable")  # repeats that walk furthest first
    places, last = places[order], places[order].max(axis=1)
    moves, columns = _walk_bits(repeats), np.arange(repeats)
    padded = np.hstack([windows, np.full((n, 1), _PAD)]).ravel()
    row_start = np.arange(n)[:, None] * (length + 1)
    ends = row_start + length
    at = np.repeat(row_start, repeats, axis=1)
    keys = np.zeros((n, repeats), dtype=np.uint64)
    for step in range(int(last.max()) + 1):
        walking = int(np.searchsorted(-last, -step, side="right"))
        symbol = padded[at[:, :walking]]
        for k in range(sampled):
            taken = np.flatnonzero(places[:walking, k] == step)
            if len(taken):
                mixed = (symbol[:, taken].astype(np.uint64) + np.uint64(k + 1)) * np.uint64(0xD6E8FEB86659FD93)
                keys[:, taken] ^= (mixed ^ mixed >> np.uint64(29)) * np.uint64(2 * k + 0x9E3779B97F4A7C15 | 1)
        at[:, :walking] += moves[step % STEPS][(symbol & (SLOTS - 1)) * repeats + columns[:walking]]
        np.minimum(at[:, :walking], ends, out=at[:, :walking])
    return (keys ^ columns.astype(np.uint64) << np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Items by the keys they share with a window: a bit table in front of a sorted array."""

    def __init__(self, keys: np.ndarray) -> None:
        flat, owner = keys.ravel(), np.repeat(np.arange(len(keys)), keys.shape[1])
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner = flat[order], owner[order]
        self.shift = np.uint64(64 - max(10, int(32 * len(flat)).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.seen[flat >> self.shift] = True

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Rows (item, window) that share a key, once each, in order."""
        window, column = np.nonzero(self.seen[keys >> self.shift])
        wanted = keys[window, column]
        low, high = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        n = high - low
        place = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.column_stack(np.divmod(np.unique(self.owner[place] * len(keys) + np.repeat(window, n)), len(keys)))


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Word edits between two sequences, or ``most + 1`` if there are more; only the band that counts is filled."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    wide = most + 1
    before = [min(j, wide) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        now = [wide] * (len(b) + 1)
        if low == 1:
            now[0] = min(i, wide)
        for j in range(low, high + 1):
            now[j] = min(before[j - 1] + (x != b[j - 1]), before[j] + 1, now[j - 1] + 1, wide)
        if min(now[max(0, low - 1) : high + 1]) > most:
            return wide
        before = now
    return before[len(b)]


def _last_row(text: np.ndarray, item: np.ndarray, most: int, free: bool) -> np.ndarray | None:
    """Least word edits between the item and a stretch that ends at each place of the text, from any place (``free``) or its first word; none if all are over ``most``."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64) if free else steps
    for word in item:
        now = row + 1
        np.minimum(now[1:], row[:-1] + (text != word), out=now[1:])
        row = np.minimum.accumulate(now - steps) + steps
        if row.min() > most:
            return None
    return row


def nearest_passage(text: np.ndarray, item: np.ndarray, most: int) -> tuple[int, int, int]:
    """Start, words and distance of the passage of ``text``, of any length, nearest to the item (the first such end, the length nearest to the item's); distance ``most + 1`` if it is over ``most``."""
    row = _last_row(text, item, most, True)
    if row is None or row.min() > most:
        return 0, 0, most + 1
    end, distance = int(row.argmin()), int(row.min())
    back = _last_row(text[max(0, end - len(item) - most) : end][::-1], item[::-1], most, False)
    lengths = np.flatnonzero(back == distance)
    length = int(lengths[np.abs(lengths - len(item)).argmin()])
    return end - length, length, distance


#: Words of all windows that are compared at a time: fewer windows of long items.
WINDOW_CELLS = 1 << 18


class Items:
    """A slice of the benchmark, by number of words."""

    def __init__(self, rows: list[tuple[object, list[str]]], similarity: float) -> None:
        self.vocabulary: dict[str, int] = {}
        for _, words in rows:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary))
        self.ids = [item for item, _ in rows]
        self.words = [[self.vocabulary[w] for w in words] for _, words in rows]
        self.by_length: dict[int, list[int]] = {}
        for k, words in enumerate(self.words):
            self.by_length.setdefault(len(words), []).append(k)
        self.most = {n: int((1 - similarity) * n + 1e-9) for n in self.by_length}
        times = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *[np.unique(w) for w in self.words]]).astype(np.int64), minlength=len(self.vocabulary) + 1)
        self.known, self.telling, self.tables = {}, {}, {}
        for n, which in self.by_length.items():
            known, telling = (np.zeros(len(self.vocabulary) + 1, dtype=np.int32) for _ in range(2))
            for k in which:
                own = np.unique(self.words[k])
                known[own] = 1
                rarest = own[np.argsort(times[own], kind="stable")][: self.most[n] + 1]
                telling[rarest] = 1
                if len(own) <= self.most[n]:  # a window may hold none of the item's words
                    telling[:] = 1
            self.known[n], self.telling[n] = known, telling
            self.tables[n] = KeyTable(sample_keys(np.array([self.words[k] for k in which])))
        self.longest = max((n + 2 * most for n, most in self.most.items()), default=0)

    def number(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, _NONE) for w in words], dtype=np.int64)

    def _holding(self, pairs: np.ndarray, windows: np.ndarray, which: list[int], n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Items and, of the windows they share a key with, those that hold all but ``most`` of their different words."""
        ordered = np.sort(windows, axis=1)
        fresh = np.hstack([np.ones((len(ordered), 1), dtype=bool), ordered[:, 1:] != ordered[:, :-1]])
        own = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        cuts = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
        for low, high in zip(cuts, np.append(cuts, len(pairs))[1:], strict=True):
            k, met = which[pairs[low, 0]], pairs[low:high, 1]
            own[self.words[k]] = True
            held = met[(own[ordered[met]] & fresh[met]).sum(axis=1) >= own.sum() - self.most[n]]
            own[self.words[k]] = False
            if len(held):
                yield k, held

    def find(self, numbers: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(start, item, words, distance) of the nearest passage of ``numbers`` in each stretch within an item's distance; ``ends``: where each word's text ends."""
        for n, which in self.by_length.items():
            stops = np.minimum(np.arange(len(numbers)) + n, ends)
            counted, telling = (np.concatenate([[0], np.cumsum(marked[n][numbers])]) for marked in (self.known, self.telling))
            starts = np.flatnonzero((counted[stops] - counted[:-1] >= n - self.most[n]) & (telling[stops] > telling[:-1]))
            hits: dict[int, list[int]] = {}
            step = max(1, min(4096, WINDOW_CELLS // n))
            for low in range(0, len(starts), step):
                some = starts[low : low + step]
                at = some[:, None] + np.arange(n)
                windows = np.where(at < ends[some][:, None], numbers[np.minimum(at, len(numbers) - 1)], _NONE)
                for k, held in self._holding(self.tables[n].pairs(sample_keys(windows)), windows, which, n):
                    hits.setdefault(k, []).extend(some[held].tolist())
            for k, own in hits.items():
                for low, high in self._stretches(own, ends, n):
                    start, length, distance = nearest_passage(numbers[low:high], np.array(self.words[k]), self.most[n])
                    if distance <= self.most[n]:
                        yield low + start, k, length, distance

    def _stretches(self, starts: list[int], ends: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Where passages around windows of ``n`` words may lie: ``most`` words more on either side, within the text; overlapping ones merged."""
        low = high = 0
        for start in starts:
            end = int(ends[start])
            first, last = max(start - self.most[n], int(np.searchsorted(ends, end))), min(start + n + self.most[n], end)
            if first < high:
                high = max(high, last)
                continue
            if high:
                yield low, high
            low, high = first, last
        if high:
            yield low, high


def _blocks(text: str, overlap: int) -> Iterator[tuple[int, list[str]]]:
    """Number of the first word, and words, of stretches of a text that overlap by ``overlap`` words."""
    if len(text) <= CHUNK_CHARS:
        yield 0, words_of(text)
        return
    at, first, tail = 0, 0, []
    while at < len(text):
        end = min(len(text), at + CHUNK_CHARS)
        while end < len(text) and (text[end].isalnum() or text[end] == "_" or not text[end].isascii()):
            end += 1
        words = tail + words_of(text[at:end])
        yield first, words
        keep = min(len(words), overlap)
        first += len(words) - keep
        tail, at = words[len(words) - keep :], end


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, least_words: int = 1) -> DataFrame:
    """A row for each document and item it holds: the keys, the least ``distance`` in words, ``item_words``, and where that passage is (``start``, ``end``: words)."""
    spark = docs.sparkSession
    kind, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-total // (4 * SLICE_WORDS)))
    schema = f"id {kind}, item {item_type.simpleString()}, distance int, item_words int, start int, end int"
    out = None
    for number in range(slices):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == number).collect()
        worded = [(r["item"], w) for r in rows if len(w := words_of(r["text"])) >= least_words]
        told = spark.sparkContext.broadcast(Items(sorted(worded, key=lambda x: (str(x[0]), x[1])), similarity))

        def run(batch: pa.RecordBatch, told=told) -> pa.RecordBatch:
            return _report(batch, told.value, schema_of)

        schema_of = pa.schema([("item", to_arrow_type(item_type)), ("distance", pa.int32()), ("item_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        part = arrow_map(id_and_text(docs, id_col, text_col), run, schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance", "item_words", "start", "end")


def _report(batch: pa.RecordBatch, items: Items, schema: pa.Schema) -> pa.RecordBatch:
    owners, firsts, parts, ends, size = [], [], [], [], 0
    for row, text in enumerate(batch.column("text")):
        for first, words in _blocks(text.as_py() or "", items.longest):
            numbers = items.number(words)
            size += len(numbers)
            parts.append(numbers)
            owners.append(np.full(len(numbers), row))
            firsts.append(first + np.arange(len(numbers)))
            ends.append(np.full(len(numbers), size))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    if size:
        owner, first = np.concatenate(owners), np.concatenate(firsts)
        for start, k, n, distance in items.find(np.concatenate(parts), np.concatenate(ends)):
            pair, now = (int(owner[start]), k), (distance, int(first[start]), n)
            best[pair] = min(best.get(pair, now), now)
    rows = sorted(best)
    columns = [[items.ids[k] for _, k in rows], [best[r][0] for r in rows], [len(items.words[k]) for _, k in rows], [best[r][1] for r in rows], [best[r][1] + best[r][2] for r in rows]]
    arrays = [batch.column("id").take(pa.array([r for r, _ in rows], pa.int64()))] + [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["id", *schema.names])
