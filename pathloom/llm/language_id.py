"""Language identification by hierarchical discrimination.

First the language family, then the language within it: at both levels one-versus-one linear
SVMs vote, over hashed byte bigrams and trigrams of the lower-cased text.  Counts are taken
over the whole text.

Training sees at most about ``per_language`` labelled rows of each language, texts of up to
``train_chars`` characters, chosen by a hash of the key; rows held out never.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no
labelled rows every text is ``und``; null keys and repeated rows are predicted one for one;
an unknown language code is a family of its own; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_out, id_and_text
from .svm import linear_svm, sigmoid

#: ISO 639-1 codes of some language families.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "indo-aryan": "hi bn ur mr gu pa ne si".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "uralic": "fi et hu".split(),
    "semitic": "ar he mt am".split(),
    "cjk": "zh ja ko".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BITS = 12
CHUNK = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint32)


def features(text: str) -> np.ndarray:
    """Square roots of the relative counts of hashed bigrams and trigrams: a vector of length 1."""
    counts = np.zeros(2 << BITS)
    raw = np.frombuffer(f" {text} ".lower().encode(), dtype=np.uint8)
    for start in range(0, len(raw), CHUNK):
        codes = _KEEP[raw[start : start + CHUNK + 2]]
        pairs = codes[:-1] << np.uint32(8) | codes[1:]
        last = CHUNK if start + CHUNK < len(raw) else len(pairs)
        counts[: 1 << BITS] += np.bincount(pairs[:last] * np.uint32(2654435761) >> np.uint32(32 - BITS), minlength=1 << BITS)
        triples = pairs[:-1] << np.uint32(8) | codes[2:]
        counts[1 << BITS :] += np.bincount(triples[:CHUNK] * np.uint32(2246822519) >> np.uint32(32 - BITS), minlength=1 << BITS)
    counts[(0x2020 * 2654435761 & 0xFFFFFFFF) >> (32 - BITS)] = 0
    counts[(1 << BITS) + ((0x202020 * 2246822519 & 0xFFFFFFFF) >> (32 - BITS))] = 0
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


@dataclass
class Duels:
    """One-versus-one SVMs among some classes."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Duels:
        self.pairs = list(combinations(range(len(self.classes)), 2))
        rows = []
        for a, b in self.pairs:
            one, two = x[y == self.classes[a]], x[y == self.classes[b]]
            rows.append(linear_svm(np.vstack([one, two]), np.repeat([1.0, -1.0], [len(one), len(two)])))
        self.weights = np.array(rows, dtype=np.float32) if rows else np.zeros((0, x.shape[1] + 1), np.float32)
        return self

    def __call__(self, x: np.ndarray) -> tuple[str, float]:
        """The class with most votes (ties: larger summed margin), and how sure its closest duel is."""
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes, sums, least = np.zeros(len(self.classes)), np.zeros(len(self.classes)), np.full(len(self.classes), np.inf)
        for (a, b), m in zip(self.pairs, margins, strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(range(len(self.classes)), key=lambda k: (votes[k], sums[k]))
        return self.classes[best], float(sigmoid(3 * least[best]))


@dataclass
class LanguageModel:
    families: Duels | None = None
    within: dict[str, Duels] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.families is None or text is None or LETTER.search(text) is None:
            return "und", 0.0
        x = features(text).astype(np.float32)
        family, sure = self.families(x)
        lang, surer = self.within[family](x)
        return lang, sure * surer


def fit_language_model(texts: list[str], langs: list[str]) -> LanguageModel:
    """A model from labelled texts; texts without a letter are passed over."""
    kept = [(t, lang) for t, lang in zip(texts, langs, strict=True) if t and lang is not None and LETTER.search(t)]
    if not kept:
        return LanguageModel()
    x = np.array([features(t).astype(np.float32) for t, _ in kept])
    y = np.array([lang for _, lang in kept], dtype=object)
    family = np.array([FAMILY_OF.get(lang, f"own:{lang}") for lang in y], dtype=object)
    within = {f: Duels(sorted(set(y[family == f]))).fit(x[family == f], y[family == f]) for f in sorted(set(family))}
    return LanguageModel(Duels(sorted(within)).fit(x, family), within)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, train_chars: int) -> tuple[list[str], list[str]]:
    """About ``per_language`` rows of each language, not held out, chosen by a hash of the key."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("id")) & (F.length("text") <= train_chars))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n))])
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    drawn = drawn.dropDuplicates(["id", "text", "lang"])  # copies of a row must not fill the bound
    got = drawn.orderBy(F.xxhash64("id", "text"), "lang").select("text", "lang").limit(2 * per_language * len(counts)).toPandas()
    return got["text"].tolist(), got["lang"].tolist()


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800, train_chars: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: the key, ``held_out``, ``lang_pred`` and ``score`` (0 to 1)."""
    model = docs.sparkSession.sparkContext.broadcast(fit_language_model(*labelled_sample(docs, id_col, text_col, lang_col, per_language, train_chars)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.value.predict(text.as_py()) for text in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    out = arrow_map(id_and_text(docs, id_col, text_col), run, f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
