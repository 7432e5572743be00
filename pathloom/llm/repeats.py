"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A window is ``LENGTH`` bytes of a text; it repeats if the same bytes start earlier (smaller key,
or same text, earlier start).  All bytes of repeating windows go.

1. Every window has an anchor, the ``GRAM``-byte gram in it with the least hash (leftmost of
   equals), so equal windows have equal anchors at equal offsets.  Consecutive windows with the
   same anchor make one stretch of text; only anchors with hashes of their gram and stretch
   are shuffled, after a first look within each slice of the input.  A stretch whose hash came
   earlier repeats as a whole.
2. Stretches that share an anchor's gram but not the whole stretch (ends of passages, edits)
   are resolved byte by byte: their text is fetched, and bucket by bucket their windows go in
   batches, in order of the texts, into a family of suffix arrays: a batch is sorted, scanned
   against each level for strings it holds already, and becomes a level, levels of like size
   being merged.  Windows of a gram with very many different stretches go by ``LENGTH - STEP``
   bytes that all windows with the gram at a like offset share, so at most four rows come of a
   stretch and a bucket holds a very common string only with what differs within ``STEP`` bytes.
3. The ranges are united for each text and cut out of it.

Step 1 takes equal 64-bit hashes of gram and of stretch for equal text; step 2 compares bytes.

Defined cases: a null text counts as empty and shorter texts than ``LENGTH`` lose nothing; rows
with the same key are ordered by a hash of their text, and equal rows are one text with one
result each; a null key comes after all others; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, written

LENGTH, GRAM = 100, 20
GRAMS = LENGTH - GRAM + 1
CHUNK = 1 << 19
SLICE = 8 << 20
#: Text bytes for each bucket of the first step.
BUCKET_BYTES = 16 << 20
#: Different stretches of one gram (of at most 180 bytes each) beyond which its windows are told apart by more than the gram.
SPREAD = 2_000
#: Windows of such a gram are grouped by the gram's offset in them, in steps of so many bytes.
STEP = 20
BATCH = 1 << 17
LAST = (1 << 63) - 1

_random = np.random.default_rng(20)
_BYTES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = {n: np.uint64(int(x) * 2 + 1) for n, x in zip((1, 2, 4, 8, 16), _random.integers(1 << 40, 1 << 62, 5), strict=True)}
_ROOT = int(_random.integers(1 << 40, 1 << 62)) * 2 + 1
ANCHOR = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<u4"), ("p", "<u4"), ("before", "u1"), ("span", "u1")])
KEY = np.dtype([("id", "<i8"), ("mark", "<i4")])


def _powers(root: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done, step = 1, root & 0xFFFFFFFFFFFFFFFF
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        step = step * step & 0xFFFFFFFFFFFFFFFF
        done += take
    return out


_POWERS: list[np.ndarray] = []


def anchors(text: np.ndarray) -> np.ndarray:
    """For each anchor of a text (bytes): gram hash, stretch hash, first window, its distance before the anchor, windows less one."""
    found = [_anchors(text[at : at + CHUNK + LENGTH - 1], at) for at in range(0, max(0, len(text) - LENGTH + 1), CHUNK)]
    return np.concatenate(found) if found else np.zeros(0, dtype=ANCHOR)


def _anchors(raw: np.ndarray, base: int) -> np.ndarray:
    if not _POWERS:
        _POWERS.append(_powers(_ROOT, CHUNK + LENGTH + 1))
        _POWERS.append(_powers(pow(_ROOT, -1, 1 << 64), CHUNK + LENGTH + 1))
    one = _BYTES[raw]
    h, sizes = one, {1: one}
    for n in (1, 2, 4, 8):
        h = h[:-n] * _MULTIPLIERS[n] + h[n:]
        sizes[2 * n] = h
    grams = len(raw) - GRAM + 1
    h = sizes[16][:grams] * _MULTIPLIERS[16] + sizes[4][16 : 16 + grams]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    least = h >> np.uint64(20) << np.uint64(20) | np.arange(grams, dtype=np.uint64)
    n = 1
    while 2 * n <= GRAMS:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    windows = len(raw) - LENGTH + 1
    least = np.minimum(least[:windows], least[GRAMS - n : GRAMS - n + windows])
    at = (least & np.uint64(0xFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [windows]]) - 1
    gram = at[first]
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(one * _POWERS[0][: len(raw)])])
    stretch = (total[last + LENGTH] - total[first]) * _POWERS[1][first]
    stretch ^= ((gram - first).astype(np.uint64) << np.uint64(8) | (last - first).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    out = np.empty(len(first), dtype=ANCHOR)
    out["h"], out["c"], out["p"], out["before"], out["span"] = h[gram], stretch, first + base, gram - first, last - first
    return out


def _first_of_each(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by gram, stretch and place in the order given; which of these are the first of their gram and stretch."""
    order = np.lexsort([rows["c"], rows["h"]])
    h, c = rows["h"][order], rows["c"][order]
    return order, np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(rows) else np.zeros(0, dtype=bool)


def _joined_ranges(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window ranges of texts, adjacent ones united."""
    order = np.lexsort([low, doc])
    doc, low, high = doc[order], low[order], high[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (low[1:] > high[:-1] + 1)])) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc[new], low[new], np.maximum.reduceat(high, new) if len(new) else high


def _index_slice(keys: np.ndarray, texts: list[bytes], buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Of one slice: (bucket, keys, anchors, ranges of windows that repeat within the slice)."""
    order = np.argsort(keys, order=["id", "mark"], kind="stable")
    keys = keys[order]
    found = []
    for doc, source in enumerate(order.tolist()):
        if len(texts[source]) < LENGTH or (doc and keys[doc] == keys[doc - 1]):
            continue
        rows = anchors(np.frombuffer(texts[source], dtype=np.uint8))
        rows["doc"] = doc
        found.append(rows)
    if not found:
        return
    rows = np.concatenate(found)
    place, first = _first_of_each(rows)
    again = rows[place[~first]]
    rows = rows[place[first]]
    doc, low, high = _joined_ranges(again["doc"].astype(np.int64), again["p"].astype(np.int64), again["p"].astype(np.int64) + again["span"])
    ranges = np.rec.fromarrays([doc, low, high], dtype=[("doc", "<u4"), ("low", "<u4"), ("high", "<u4")])
    bucket = (rows["h"] >> np.uint64(7)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        own = rows[cuts[b] : cuts[b + 1]].copy()
        told = ranges[b::buckets]
        if len(own) or len(told):
            used, place = np.unique(np.concatenate([own["doc"], told["doc"]]), return_inverse=True)
            own["doc"], told = place[: len(own)], told.copy()
            told["doc"] = place[len(own) :]
            yield b, keys[used].tobytes(), own.tobytes(), told.tobytes()


FOUND = "id long, mark int, low int, high int, gram long, before int, hot boolean"


def _match_bucket(table: pa.Table) -> pa.Table:
    """Of one bucket: window ranges that repeat (gram null), and stretches to be resolved by their bytes."""
    keys, rows, told, held = [], [], [], 0
    for k, a, r in zip(table["keys"], table["anchors"], table["ranges"], strict=True):
        own = np.frombuffer(a.as_py(), dtype=ANCHOR).copy()
        ranges = np.frombuffer(r.as_py(), dtype=[("doc", "<u4"), ("low", "<u4"), ("high", "<u4")]).copy()
        own["doc"] += held
        ranges["doc"] += held
        keys.append(np.frombuffer(k.as_py(), dtype=KEY))
        held += len(keys[-1])
        rows.append(own)
        told.append(ranges)
    keys, rows, told = np.concatenate(keys), np.concatenate(rows), np.concatenate(told)
    by_key = np.argsort(keys, order=["id", "mark"], kind="stable")
    rank = np.empty(len(keys), dtype=np.int64)
    rank[by_key] = np.arange(len(keys))
    rows = rows[np.lexsort([rows["p"], rank[rows["doc"]]])]
    place, first = _first_of_each(rows)
    again, rest = rows[place[~first]], rows[place[first]]
    h = rest["h"]
    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    count = np.repeat(np.diff(np.concatenate([begins, [len(h)]])), np.diff(np.concatenate([begins, [len(h)]])))
    open_, hot = rest[count > 1], count[count > 1] > SPREAD
    doc = np.concatenate([told["doc"], again["doc"], open_["doc"]])
    low = np.concatenate([told["low"], again["p"], open_["p"]]).astype(np.int32)
    high = np.concatenate([told["high"], again["p"] + again["span"], open_["p"] + open_["span"]]).astype(np.int32)
    sure = len(told) + len(again)
    mask = np.arange(len(doc)) < sure
    gram = np.concatenate([np.zeros(sure, dtype=np.int64), open_["h"].view(np.int64) if len(open_) == 0 else np.ascontiguousarray(open_["h"]).view(np.int64)])
    before = np.concatenate([np.zeros(sure, dtype=np.int32), open_["before"].astype(np.int32)])
    spread = np.concatenate([np.zeros(sure, dtype=bool), hot])
    return pa.table({"id": np.ascontiguousarray(keys["id"])[doc], "mark": np.ascontiguousarray(keys["mark"])[doc], "low": low, "high": high, "gram": pa.array(gram, mask=mask), "before": before, "hot": spread})


class SuffixFamily:
    """Sorted arrays of suffixes cut at ``LENGTH`` bytes, their sizes falling at least by half from level to level."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """Take a batch (fixed-length byte strings, earlier ones first); whether each was there before it."""
        order = np.argsort(suffixes, kind="stable")
        ordered = suffixes[order]
        known = np.concatenate([[False], ordered[1:] == ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, ordered), len(level) - 1)
            known |= level[at] == ordered
        fresh = ordered[~known]
        if len(fresh):
            self.levels.append(fresh)
            while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
                self.levels[-2:] = [np.sort(np.concatenate(self.levels[-2:]), kind="stable")]
        out = np.empty(len(suffixes), dtype=bool)
        out[order] = known
        return out


def _resolve_bucket(table: pa.Table) -> pa.Table:
    """Window ranges that repeat, among the windows of the stretches of one bucket."""
    ids, marks, lows = table["id"].to_numpy(), table["mark"].to_numpy(), table["low"].to_numpy().astype(np.int64)
    order = np.lexsort([lows, marks, ids])
    texts = table["stretch"].combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    every = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    sizes = np.diff(bounds) - LENGTH + 1
    family, out = SuffixFamily(), []
    total = np.cumsum(sizes[order])
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH)))
        some = order[at:end]
        n = sizes[some]
        owner = np.repeat(some, n)
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        suffixes = np.ascontiguousarray(every[bounds[:-1][owner] + offset]).view(f"S{LENGTH}").ravel()
        known = family.add(suffixes)
        owner, start = owner[known], lows[owner[known]] + offset[known]
        doc, low, high = _joined_ranges(owner, start, start)
        out.append((doc, low, high))
        at = end
    doc, low, high = (np.concatenate([o[k] for o in out]) for k in range(3))
    return pa.table({"id": ids[doc], "mark": marks[doc], "low": low.astype(np.int32), "high": high.astype(np.int32)})


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.hash(text).alias("mark"), text.alias("text"))


def _pieces(span: Column, before: Column) -> Column:
    """Of a stretch (columns ``gram``, ``hot``, ``stretch``; ``span``: its windows less one; ``before``: bytes before the gram): windows skipped, windows taken, key.

    Equal windows hold the gram at the same offset.  Those with an offset from ``low`` on, below
    ``low + STEP``, all hold the ``LENGTH - STEP`` bytes that begin ``low`` bytes before the gram.
    """
    whole = F.array(F.struct(F.lit(0).alias("skip"), (span + 1).alias("n"), F.xxhash64("gram").alias("key")))

    def piece(low: Column) -> Column:
        widest = F.when(low + STEP > LENGTH - GRAM - STEP, F.lit(LENGTH - GRAM)).otherwise(low + STEP - 1)
        first, last = F.greatest(before - widest, F.lit(0)), F.least(before - low, span)
        shared = F.substring(F.col("stretch"), before - low + 1, F.lit(LENGTH - STEP))
        return F.struct(first.alias("skip"), (last - first + 1).alias("n"), F.xxhash64(shared, low).alias("key"))

    cut = F.filter(F.array(*[piece(F.lit(low)) for low in range(0, LENGTH - GRAM, STEP)]), lambda p: p["n"] > 0)
    return F.when(F.col("hot"), cut).otherwise(whole)


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``mark`` (hash of the text), ``low``, ``high``: ranges of starts of windows that repeat; ranges may overlap."""
    rows = _keyed(docs, id_col, text_col).select("id", "mark", "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(12, -(-total // BUCKET_BYTES))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys: list, texts: list[bytes]) -> pa.RecordBatch | None:
            found = list(_index_slice(np.array(keys, dtype=KEY), texts, buckets))
            if found:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "anchors", "ranges"])
            return None

        keys, texts, held = [], [], 0
        for batch in batches:
            for key, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys.append((key, mark))
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= SLICE:
                    if (out := made(keys, texts)) is not None:
                        yield out
                    keys, texts, held = [], [], 0
        if keys and (out := made(keys, texts)) is not None:
            yield out
        release_memory()

    bounded_batches(docs.sparkSession)
    indexed = rows.mapInArrow(index, "bucket int, keys binary, anchors binary, ranges binary")
    found = written(indexed.groupBy("bucket").applyInArrow(_match_bucket, FOUND), "repeat-anchors")
    sure = found.filter("gram is null").select("id", "mark", "low", "high")
    wanted = found.filter("gram is not null").groupBy("id", "mark").agg(F.collect_list(F.struct("low", "high", "gram", "before", "hot")).alias("wanted"))
    cut = (
        rows.join(wanted, ["id", "mark"])
        .dropDuplicates(["id", "mark"])
        .select("id", "mark", "text", F.explode("wanted").alias("w"))
        .select("id", "mark", "w.*", F.expr(f"substring(text, w.low + 1, w.high - w.low + {LENGTH})").alias("stretch"))
    )
    slots = F.lit(4 * buckets)
    pieces = cut.select("id", "mark", "low", "stretch", F.inline(_pieces(F.col("high") - F.col("low"), F.col("before"))))
    pieces = pieces.select("id", "mark", (F.col("low") + F.col("skip")).alias("low"), F.expr(f"substring(stretch, skip + 1, n + {LENGTH} - 1)").alias("stretch"), F.pmod("key", slots).alias("bucket"))
    resolved = pieces.groupBy("bucket").applyInArrow(_resolve_bucket, "id long, mark int, low int, high int")
    return sure.unionByName(resolved)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes left) of every row of ``docs``."""
    rows = _keyed(docs, id_col, text_col)
    ranges = written(repeated_ranges(docs, id_col, text_col).groupBy("id", "mark").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "repeat-ranges")
    joined = rows.join(ranges, ["id", "mark"], "left").select("own_id", "text", F.transform("ranges", lambda r: r["low"]).alias("low"), F.transform("ranges", lambda r: r["high"]).alias("high"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                out = [kept_bytes(t.as_py(), low.as_py(), high.as_py()) for t, low, high in zip(some.column(1), some.column(2), some.column(3), strict=True)]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def kept_bytes(text: bytes, low: list[int] | None, high: list[int] | None) -> tuple[int, int, int, bytes]:
    """Length, removed bytes, removed runs and what is left, given ranges of repeating windows."""
    if not low:
        return len(text), 0, 0, text
    begins, ends = np.array(low, dtype=np.int64), np.array(high, dtype=np.int64) + LENGTH
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], begins[1:] > ends[:-1]]))
    starts, stops = begins[new], np.concatenate([ends[new[1:] - 1], ends[-1:]])
    parts = [text[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(text)], strict=True)]
    removed = int((stops - starts).sum())
    return len(text), removed, len(starts), b"".join(parts)
