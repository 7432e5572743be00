"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into fewer segments than its tolerance would need for an exact match:
with ``n`` segments and at most ``2n - 1`` differing bits, one segment differs by at most one
bit.  Every segment is indexed once for each of its bits with that bit left out, so two such
fingerprints share a key: an equality join finds them, the whole fingerprints are compared
then.  Components of the links are classes.

Where very many distinct fingerprints share one key, the bits outside its segment are cut
again by the same rule, twice if need be; after that a key leaves 11 bits free, so no more
than 2,048 distinct fingerprints can share it.  No bucket is capped or sampled.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any
other; null keys are kept (a class's id is the smallest key that isn't null); repeated rows are
kept one for one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, id_and_text, written
from .components import components

#: Distinct fingerprints under one key beyond which the key is cut again.
DENSE = 1_000
CHUNK = 1 << 16


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at blanks and the control characters 9 to 13."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``size`` words joined by blanks, in chunks; fewer words: of all of them."""
    n = len(words) - size + 1
    if n <= 0 and words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        some = range(at, min(n, at + CHUNK))
        yield np.array([digest(joined[starts[i] : stops[i + size - 1]], 42) for i in some], dtype=np.uint64)


def majority_bits(hashes: Iterator[np.ndarray]) -> int:
    """64 bits, each set where over half of the hashes have it set."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for some in hashes:
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(some)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id`` and ``fp``, the 64-bit SimHash over runs of ``words`` words, as a long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [majority_bits(shingle_hashes(ascii_words(t.as_py()), words)) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "fp"])

    return arrow_map(id_and_text(docs, id_col, text_col), run, f"id {kind}, fp long")


def _part(bits: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, low).bitwiseAND((1 << width) - 1)


def _variants(bits: Column, width: int) -> Column:
    """Keys of the two segments of ``width`` bits, each once without each of its bits: slot above, rest below bit 32."""
    keys = [F.lit((k * width + i) << 32).bitwiseOR(_part(bits, k * width, width).bitwiseAND(~(1 << i))) for k in range(2) for i in range(width)]
    return F.explode(F.array(*keys))


def _counted(keyed: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose key others have too, with the number ``n`` of rows of the key: an aggregate and a join, so no task holds a whole key."""
    return keyed.join(keyed.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1").hint("merge"), names)


def near_links(fps: DataFrame) -> DataFrame:
    """All pairs ``a`` < ``b`` of distinct fingerprints (column ``fp``) that differ in at most 3 bits, once each."""
    shared = written(_counted(fps.select("fp", _variants(F.col("fp"), 32).alias("key")), ["key"]), "shared-keys")
    sparse = shared.filter(F.col("n") <= DENSE)
    found = _pairs(sparse, ["key"]).filter(_first_meeting("key")).select("a", "b")
    dense = shared.filter(F.col("n") > DENSE).drop("n")
    if dense.isEmpty():
        return found
    names = ["key"]
    for depth, width in ((1, 16), (2, 8)):
        # The bits outside the segment (depth 1), or outside the half already matched (depth 2), cut in halves again.
        name = f"key{depth}"
        cut = dense.select("fp", *names, _variants(_other(F.col("fp"), depth), width).alias(name))
        names = [*names, name]
        cut = written(_counted(cut, names), f"shared-keys-{depth}")
        last = depth == 2
        found = found.unionByName(_pairs(cut if last else cut.filter(F.col("n") <= DENSE), names).select("a", "b"))
        dense = cut.filter(F.col("n") > DENSE).drop("n")
    return found.distinct()


def _other(fp: Column, depth: int) -> Column:
    """At depth 1 the 32 bits of the segment that ``key`` doesn't hold; at depth 2 the 16 of these that ``key1`` doesn't."""
    first = F.shiftrightunsigned("key", 32) < 32
    other = F.when(first, _part(fp, 32, 32)).otherwise(_part(fp, 0, 32))
    if depth == 1:
        return other
    low = F.shiftrightunsigned("key1", 32) < 16
    return F.when(low, _part(other, 16, 16)).otherwise(_part(other, 0, 16))


def _pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    one = rows.select(*keys, F.col("fp").alias("a"))
    two = rows.select(*keys, F.col("fp").alias("b"))
    return one.join(two.hint("merge"), keys).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3))


def _first_meeting(key: str) -> Column:
    """Whether this is the first of the keys that the pair shares: equal segments share all of their variants."""
    differ = F.col("a").bitwiseXOR(F.col("b"))
    low, high = F.bit_count(_part(differ, 0, 32)), F.bit_count(_part(differ, 32, 32))
    slot = F.shiftrightunsigned(key, 32)
    return ((low == 0) & (slot == 0)) | ((low == 1) & (slot < 32)) | ((low > 1) & (((high == 0) & (slot == 32)) | (high == 1)))


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``docs``: the key, ``fingerprint`` (16 hex digits), ``component_id`` (smallest key reachable).

    Nothing is broadcast, small or not, so what the driver holds doesn't grow with the rows.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("rep")), "distinct-fingerprints")
    roots = written(components(near_links(distinct)), "fingerprint-roots")
    linked = distinct.join(roots.hint("merge"), distinct["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = linked.filter("fp <> root or rep is null").select("root").distinct().hint("merge").join(linked, "root").groupBy("root").agg(F.min("rep").alias("least"))
    classes = written(linked.join(smallest.hint("merge"), "root", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "fingerprint-classes")
    discard(distinct, roots)
    out = rows.join(classes.hint("merge"), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by similarity of word shingles: SimHash classes and MinHash keys, verified on the shingles.

BANDS, ROWS = 24, 6
#: Classes of shingle hashes by which a bound on what two texts share is counted.
CLASSES = 32
SOME = 1 << 10
_MULTIPLIERS, _SHIFTS = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of ``ROWS`` least values of hashed 32-bit shingles, as longs; none without shingles."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    x = hashes.view(np.uint32).astype(np.uint64)
    for at in range(0, len(x), SOME):
        mixed = x[at : at + SOME] * _MULTIPLIERS[:, None] + _SHIFTS[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    least = (least >> np.uint64(32)).astype(np.uint32).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least)], dtype=np.uint64).view(np.int64)


_NONE = np.zeros(0, dtype=np.int32)


def _profile(text: str | None, words: int, fp_words: int) -> tuple[bytes | None, int | None, np.ndarray, np.ndarray, np.ndarray]:
    """Digest of the word sequence and fingerprint (none without words), band keys, sizes of ``CLASSES`` classes of the shingles, sorted distinct 32-bit shingle hashes."""
    found = ascii_words(text)
    if not found:
        return None, None, _NONE.astype(np.int64), _NONE, _NONE
    hashes = np.unique(np.concatenate(list(shingle_hashes(found, words))).astype(np.uint32)).view(np.int32)
    digest = hashlib.md5(b" ".join(found), usedforsecurity=False).digest()
    fp = majority_bits(shingle_hashes(found, fp_words))
    return digest, fp, band_keys(hashes), np.bincount(hashes % CLASSES, minlength=CLASSES).astype(np.int32), hashes


def _lists(parts: tuple[np.ndarray, ...]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), np.concatenate(parts))


def text_mark(text: Column) -> Column:
    """What tells texts under one key apart: the MD5 of a text as it is, null for null."""
    return F.unhex(F.md5(text.cast("string")))


def has_words(text: Column) -> Column:
    """Whether ``ascii_words`` finds any."""
    return F.coalesce(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _class_keys(texts: DataFrame) -> DataFrame:
    """``node`` and ``key``: the class of a text's fingerprint ``fp``, by links of at most 3 differing bits; texts alone in their class have none."""
    distinct = written(texts.groupBy("fp").agg(F.count("*").alias("n")), "distinct-fingerprints")
    roots = written(components(near_links(distinct.select("fp"))), "fingerprint-roots")
    # A fingerprint without links is a class of its own, of the texts that share it.
    classes = distinct.join(roots.hint("merge"), distinct["fp"] == roots["node"], "left").filter("n > 1 or root is not null").select("fp", F.coalesce("root", "fp").alias("key"))
    keys = written(texts.select("node", "fp").join(classes.hint("merge"), "fp").select("node", "key"), "class-keys")
    discard(distinct, roots)
    return keys


def _near(pairs: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose shingles are similar enough."""
    full = profiles.select("node", "shingles")
    both = pairs.join(full.toDF("a", "xa"), "a").join(full.toDF("b", "xb"), "b")
    shared = F.size(F.array_intersect("xa", "xb"))
    return both.filter(shared >= similarity * (F.size("xa") + F.size("xb") - shared)).select("a", "b")


def _unlinked(met: DataFrame, roots: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a`` < ``b`` that share a key of ``met``, lie in different components, aren't with the bucket's first and can be near, once each.

    Each pair has an end outside the bucket's largest component.  Shingles that are in one text of
    all these buckets only can't be shared; the others are counted by class of their hash.  Two
    texts share no more than the sum, over the classes, of the lesser count: pairs for which even
    that many would make too small a similarity are never formed.
    """
    placed = met.filter("n > 2").drop("n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    mixed = written(placed.filter("node <> first").join(largest, "key").select("key", "node", "root", "main"), "mixed-buckets")
    members = profiles.join(mixed.select("node").distinct(), "node")
    lone = members.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    by_class = F.array(*[F.count_if(F.pmod("s", F.lit(CLASSES)) == c) for c in range(CLASSES)])
    lone = lone.groupBy("node").agg(by_class.alias("lone"))
    counts = F.coalesce(F.zip_with("counts", "lone", lambda x, y: x - y), F.transform("counts", lambda x: x.cast("long")))
    weighed = members.join(lone, "node", "left").select("node", F.size("shingles").alias("size"), counts.alias("counts"))
    summed = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda t, c: t + c)
    weighed = written(weighed.withColumn("most", summed(F.col("counts"))), "shared-shingles")
    ends = mixed.join(weighed, "node")
    one, two = ends.filter("root <> main").select("key", F.struct("*").alias("x")), ends.select("key", F.struct("*").alias("y"))
    least = similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6
    possible = (F.least("x.most", "y.most") >= least) & (summed(F.zip_with("x.counts", "y.counts", lambda u, v: F.least(u, v))) >= least)
    apart = F.expr("x.root <> y.root and (y.root = y.main or x.node < y.node)")
    crossed = one.join(two, (one["key"] == two["key"]) & apart & possible)
    pairs = written(crossed.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "crossing-pairs")
    discard(mixed, weighed)
    return pairs


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, fp_words: int = 3) -> DataFrame:
    """``id``, ``mark`` (``text_mark``), ``group_id`` and ``group_mark`` for every row of ``docs``.

    Groups are components of links between texts whose sets of ``words``-word shingles have a
    Jaccard similarity of at least ``similarity``; a group is named by the row in it with the
    smallest key (null keys last; of equal keys the smallest mark).  Candidates are in one class
    of SimHash fingerprints (over ``fp_words`` words, linked by deletion variants as in
    ``simhash_classes``) or share one of 24 MinHash keys, each made of 6 least shingle hashes,
    since few pairs of that similarity are within 3 bits; a class is one more bucket, and each
    candidate is then verified on the shingles.
    A pair of similarity ``s`` shares a MinHash key with probability ``1 - (1 - s^6)^24``, wherever its
    shingles differ (scattered words or a block appended, cut or replaced): 0.999 at 0.8.  No
    bucket is capped: every text is compared with the most typical of its bucket, then all pairs of a
    bucket that these links leave in different components are compared too.  The pairs left out
    are in one group already or can't be near, so the groups are those of all pairs.

    Defined cases: null, empty and blank texts have no words, are near nothing and name
    themselves; rows with one key and different texts are texts of their own; repeated rows are
    kept one for one; other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, fps, *lists = zip(*(_profile(t.as_py(), words, fp_words) for t in batch.column("text")), strict=True)
        columns = [pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), *map(_lists, lists)]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), *columns], ["id", "mark", "digest", "fp", "keys", "counts", "shingles"])

    source = docs.select(F.col(id_col).alias("id"), text_mark(F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))
    rows = arrow_map(source, run, f"id {kind}, mark binary, digest binary, fp long, keys array<long>, counts array<int>, shingles array<int>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "profiles")
    named = F.struct(F.col("id").isNull().alias("keyless"), "id", "mark", "row")
    same = rows.filter("digest is not null").groupBy("digest").agg(F.min(named).alias("least"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    texts = written(same.select("digest", F.col("least.row").alias("node"), "least", "keys", "fp"), "distinct-texts")
    classed = _class_keys(texts)
    keyed = texts.select("node", F.explode("keys").alias("key")).unionByName(classed)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(keyed.join(shared, "key"), "shared-keys")
    # The first of a bucket is its most typical text: the one whose buckets hold most texts in all.
    typical = met.groupBy("node").agg(F.sum("n").alias("score"))
    first = met.join(typical, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("first"))
    keyed, met = met, written(met.join(first.select("key", F.col("first.node").alias("first")), "key"), "met-firsts")
    discard(keyed, classed)
    # Not broadcast even where it is small: one plan at every size.
    wanted = met.select("node").distinct().hint("merge")
    profiles = written(rows.select(F.col("row").alias("node"), "counts", "shingles").join(wanted, "node"), "shared-texts")
    stars = written(met.filter("node <> first").select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")).distinct(), "star-pairs")
    links = written(_near(stars, profiles, similarity), "star-links")
    roots = written(components(links), "star-roots")
    rest = _unlinked(met, roots, profiles, similarity)
    more = written(_near(rest, profiles, similarity), "crossing-links")
    discard(stars, met, rest, profiles)
    joined = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "near-roots")
    discard(links, roots, more)
    placed = texts.join(joined, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "least")
    groups = placed.groupBy("root").agg(F.min("least").alias("least"))
    own = written(placed.select("digest", "root").join(groups, "root").select("digest", F.col("least.id").alias("group_id"), F.col("least.mark").alias("group_mark")), "text-groups")
    discard(texts, joined)
    alone = rows.filter("digest is null").select("id", "mark", F.col("id").alias("group_id"), F.col("mark").alias("group_mark"))
    return rows.filter("digest is not null").select("id", "mark", "digest").join(own, "digest").drop("digest").unionByName(alone)
