"""Toxicity by a subsequence string kernel, a Nyström approximation and a linear SVM.

Kernel: two words are as alike as the length-4 subsequences they share, each occurrence
weighted by ``DECAY`` for every character skipped, at most ``SPAN - 4`` of them; a word's
start and end count as characters.  Gapped words and inserted characters therefore keep most of
their likeness.  Runs of single characters set apart by blanks are read as one more word.

Nyström: landmark words span the feature space; the SVM is trained in it.  As its decision
function is a sum over landmarks of this kernel, the landmarks' subsequences are summed into
one table of weights, and a word's score is read off by its own subsequences: the same value
without a kernel evaluation for each landmark.

Training is by whole texts' labels: a toxic text holds at least one toxic word, so its
words that recur in toxic and never in clean texts are the first positives, and after each fit a
toxic text without any of them adds its highest-scoring word as witness; words of clean texts are
the other class, the hardest of them added after each fit.  A text's margin is its largest word's,
scaled to 0..1 on texts set aside from the fit, toxic ones also with characters put into their worst word.

Bounds of the training sample (driver memory): ``max_toxic`` and ``max_clean`` labelled rows,
chosen by a hash of the key, texts of up to ``train_chars`` characters; held-out rows never.

Defined cases: null and empty texts have the score of a text without words; without both
classes among the labels every score is the smoothed share of toxic labels; null keys
and repeated rows are scored one for one; several labels of one key count as toxic if any is;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_out, id_and_text
from .svm import logistic_scale, newton_svm, sigmoid

SPAN = 7
DECAY = 0.6
BITS = 20
LONGEST = 48
MEMO_WORDS = 100_000
#: Positions of the second to fourth character after the first, and the weight of their gaps.
SHAPES = [(j, k, n, DECAY ** (n - 3)) for j, k, n in combinations(range(1, SPAN), 3)]
SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
BARE = re.compile(r"[\W\d_]+")
START, END = 27, 28


def _code(char: int) -> int:
    if 97 <= char <= 122:
        return char - 96
    if char == 0 or chr(char).isspace():
        return 0
    if chr(char).isalpha():
        return 29 + char % 23
    return 52 + char % 12


_CODES = np.array([_code(c) for c in range(0x3000)], dtype=np.uint32)


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all words, each between its marks and with ``SPAN`` zeros behind it; where each begins."""
    joined = "".join(["\x00" + w + "\x00" * (SPAN + 1) for w in words])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum([0] + [len(w) + 2 + SPAN for w in words[:-1]])
    codes = _CODES[np.where(raw < len(_CODES), raw, 0x2000 + raw % 0x1000)]
    codes[starts] = START
    codes[starts + [len(w) + 1 for w in words]] = END
    return codes, starts


def occurrences(codes: np.ndarray):
    """For each shape: hashed feature, weight (0 where no subsequence is) of every start."""
    n = len(codes) - SPAN
    first = codes[:n] << np.uint32(18)
    live = codes[:n] != 0
    for j, k, last, weight in SHAPES:
        end = codes[last : last + n]
        index = first | codes[j : j + n] << np.uint32(12) | codes[k : k + n] << np.uint32(6) | end
        yield index * np.uint32(2654435761) >> np.uint32(32 - BITS), np.where(live & (end != 0), np.float32(weight), np.float32(0))


#: A word's norm by its number of characters, both marks included.
NORMS = np.sqrt(np.maximum([sum(w * w * max(0, n - last) for _, _, last, w in SHAPES) for n in range(LONGEST + 4)], 1e-9))


def parts_of(word: str) -> list[str]:
    """The word, or overlapping parts of a very long one."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - SPAN, LONGEST - SPAN - 1)]


def words_of(text: str | None) -> set[str]:
    """Distinct words of a text: between white space, lower case, and again bare of all but letters; runs of single characters joined."""
    lower = (text or "").lower()
    words = set(lower.split())
    words |= {BARE.sub("", w) for w in words if not w.isalpha()} - {""}
    for run in SPACED.findall(lower):
        words.add(run.replace(" ", ""))
    return words


def vectors(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse normed feature vector of each word."""
    codes, starts = codes_of(words)
    index, weight = (np.array(x) for x in zip(*occurrences(codes), strict=True))
    out = []
    for word, start in zip(words, starts.tolist(), strict=True):
        end = start + len(word) + 2
        i, w = index[:, start:end], weight[:, start:end]
        out.append((i[w > 0], w[w > 0] / NORMS[len(word) + 2]))
    return out


@dataclass
class ToxicityModel:
    table: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    memo: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}}

    def word_margins(self, words: list[str]) -> np.ndarray:
        """Decision value of each word (of at most ``LONGEST`` characters)."""
        if not words:
            return np.zeros(0)
        codes, starts = codes_of(words)
        total = np.zeros(len(codes) - SPAN, dtype=np.float32)
        for index, weight in occurrences(codes):
            total += self.table[index] * weight
        return np.add.reduceat(total, starts) / NORMS[[len(w) + 2 for w in words]] + self.bias

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Largest word margin of each text."""
        if self.table is None:
            return np.zeros(len(texts))
        out = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            sets = [words_of(t) for t in texts[at : at + 256]]
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            new = list({w for s in sets for w in s if w not in self.memo})
            for low in range(0, len(new), 20_000):
                some = new[low : low + 20_000]
                parts = [parts_of(w) for w in some]
                values = self.word_margins([p for ps in parts for p in ps])
                self.memo.update(zip(some, np.maximum.reduceat(values, np.cumsum([0] + [len(p) for p in parts[:-1]])).tolist(), strict=True))
            get = self.memo.__getitem__
            out[at : at + 256] = [max(map(get, s), default=self.bias) for s in sets]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.slope * self.margins(texts) + self.offset)


def fit_words(positive: list[str], negative: list[str], landmarks: int, seed: int) -> ToxicityModel:
    """Nyström landmarks (the first positive words, a draw of the others) and an SVM over them, folded into a table of weights."""
    draw = np.random.default_rng(seed)
    half = landmarks // 2
    marks = [*positive[: landmarks // 2], *(negative[i] for i in sorted(draw.choice(len(negative), min(len(negative), landmarks - landmarks // 2), replace=False)))]
    at = vectors(marks)
    columns = np.unique(np.concatenate([i for i, _ in at]))
    dense = np.zeros((len(marks), len(columns)), dtype=np.float64)
    for row, (i, v) in enumerate(at):
        np.add.at(dense[row], np.searchsorted(columns, i), v)
    values, basis = np.linalg.eigh(dense @ dense.T)
    good = values > 1e-6 * values[-1]
    root = basis[:, good] / np.sqrt(values[good])
    positive = positive + stretched(positive[:400], draw)
    words = positive + negative
    kernel = np.zeros((len(words), len(marks)))
    for row, (i, v) in enumerate(vectors(words)):
        spot = np.minimum(np.searchsorted(columns, i), len(columns) - 1)
        hit = columns[spot] == i
        kernel[row] = dense[:, spot[hit]] @ v[hit]
    w = newton_svm(kernel @ root, np.repeat([1.0, -1.0], [len(positive), len(negative)]))
    table = np.zeros(1 << BITS, dtype=np.float32)
    table[columns] = (root @ w[:-1]) @ dense
    return ToxicityModel(table, float(w[-1]))


def covering(bags: list[set[str]], least: int, times: int = 3) -> list[str]:
    """Words taken greedily, each the most frequent among bags that hold fewer than ``times`` taken ones.

    Ends when the next word would be in fewer than ``least`` such bags.
    """
    holders: dict[str, list[int]] = {}
    for k, bag in enumerate(bags):
        for word in bag:
            holders.setdefault(word, []).append(k)
    gain = {w: len(ks) for w, ks in holders.items()}
    open_for, taken = [times] * len(bags), []
    while gain:
        word = max(gain, key=lambda w: (gain[w], w))
        if gain.pop(word) < least:
            break
        taken.append(word)
        for k in holders[word]:
            open_for[k] -= 1
            if open_for[k] == 0:
                for other in bags[k]:
                    if other in gain:
                        gain[other] -= 1
    return taken


def stretched(words: list[str], draw: np.random.Generator) -> list[str]:
    """Each word some times more, with a letter or mark put in at a random inner place."""
    fill = "abcdefghijklmnopqrstuvwxyz.-*"
    times = min(12, max(3, 600 // max(1, len(words))))
    return [w[:at] + fill[draw.integers(len(fill))] + w[at:] for w in words for at in draw.integers(1, max(2, len(w)), times)]


def fit_toxicity(texts: list[str], toxic: list[int], landmarks: int = 384, rounds: int = 2, seed: int = 11) -> ToxicityModel:
    """A model from labelled texts."""
    flags = np.array([bool(t) for t in toxic], dtype=bool)
    if flags.all() or not flags.any():
        share = (flags.sum() + 1) / (len(flags) + 20)
        return ToxicityModel(None, 0.0, 0.0, float(np.log(share / (1 - share))))
    bags = [[p for w in sorted(words_of(t)) for p in parts_of(w)] for t in texts]
    aside = np.arange(len(texts)) % 3 == 0
    if flags[aside].sum() < 5 or flags[~aside].sum() < 5 or (~flags)[aside].sum() < 5:
        aside[:] = False
    fit = ~aside
    clean = Counter(w for b, t, f in zip(bags, flags, fit, strict=True) if f and not t for w in set(b))
    bad = Counter(w for b, t, f in zip(bags, flags, fit, strict=True) if f and t for w in set(b) if w not in clean and len(w) >= 3)
    least = max(2, round(0.5 * float(flags[fit].sum()) ** 0.5))
    suspects = [{w for w in b if bad[w] >= least} for b, t, f in zip(bags, flags, fit, strict=True) if f and t]
    positive = covering(suspects, least) or [w for w, _ in bad.most_common(200)] or ["\x01\x01\x01"]
    draw = np.random.default_rng(seed)
    pool = sorted(clean)
    frequent = [w for w, _ in clean.most_common(500)]
    negative = sorted({*frequent, *(pool[i] for i in draw.choice(len(pool), min(2000, len(pool)), replace=False))} or {"\x02\x02\x02"})
    model = fit_words(positive, negative, landmarks, seed)
    for _ in range(rounds):
        known, witnesses = set(positive), Counter()
        for bag, t, f in zip(bags, flags, fit, strict=True):
            if f and t and known.isdisjoint(bag) and (left := [w for w in bag if w not in clean]):
                values = model.word_margins(left)
                if values.max() > 0.5:
                    witnesses[left[int(values.argmax())]] += 1
        positive += [w for w, n in witnesses.most_common(400) if n >= 2]
        hard = sorted(zip(model.word_margins(pool).tolist(), pool, strict=True), reverse=True)[:500]
        negative = sorted({*negative, *(w for v, w in hard if v > -1)})
        model = fit_words(positive, negative, landmarks, seed)
    held = aside if aside.any() else fit
    margins = model.margins([t for t, h in zip(texts, held, strict=True) if h])
    weights, extra = np.ones(len(margins)), []
    for at, bag in enumerate(b for b, h in zip(bags, held, strict=True) if h):
        if flags[held][at] and margins[at] > 0:
            values = model.word_margins(bag)
            extra.append([p for w in stretched([bag[int(values.argmax())]], draw)[:4] for p in parts_of(w)])
            weights[at] = 0.5
    changed = model.word_margins([w for ws in extra for w in ws])
    shares = np.concatenate([np.full(len(ws), 0.5 / len(ws)) for ws in extra]) if extra else np.zeros(0)
    model.slope, model.offset = logistic_scale(np.concatenate([margins, changed]), np.concatenate([flags[held], np.ones(len(changed), dtype=bool)]), np.concatenate([weights, shares]))
    model.memo.clear()
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_toxic: int, max_clean: int, train_chars: int) -> tuple[list[str], list[int]]:
    """Texts and labels of bounded samples of both classes; only keys are sorted, and at most their bound is broadcast."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.filter(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(n) for v, n in ((1, max_toxic), (0, max_clean))]
    chosen = drawn[0].unionByName(drawn[1])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") <= train_chars)
    labelled = rows.join(F.broadcast(chosen), "id").dropDuplicates(["id", "text"])  # copies of a row must not fill the bound
    got = labelled.orderBy(F.xxhash64("id", "text")).limit(2 * (max_toxic + max_clean)).toPandas().sort_values(["id", "text"])
    return got["text"].tolist(), got["toxic"].tolist()


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.3, max_toxic: int = 1000, max_clean: int = 4000, train_chars: int = 20_000, train_docs: DataFrame | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the key, ``held_out``, ``score`` (0 to 1) and ``predicted`` (score at least ``threshold``).

    ``train_docs``: where the labelled texts are, if not in ``docs``.
    """
    sample = labelled_sample(docs if train_docs is None else train_docs, labels, id_col, text_col, label_col, max_toxic, max_clean, train_chars)
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(*sample))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.value.scores(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    out = arrow_map(id_and_text(docs, id_col, text_col), run, f"id {kind}, score double", lambda: model.value.memo.clear())
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, max_toxic: int = 1000, max_clean: int = 4000, train_chars: int = 20_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(*labelled_sample(docs, labels, id_col, text_col, label_col, max_toxic, max_clean, train_chars)))
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.value.scores(batch.column(at).to_pylist()) < threshold))

    return arrow_map(docs, run, docs.schema, lambda: model.value.memo.clear())
