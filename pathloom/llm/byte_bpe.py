"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1, so that one pyahocorasick automaton over the vocabulary finds
every token in a piece in one pass.  The encoder walks from longest matches and steps to
shorter prefixes, or back, whenever the last two tokens could not stand side by side in
a merged text; that test looks only at the two tokens' own merge trees and is memoised.
The result is the one that rank-ordered merging gives, in time linear in the piece.

Defined cases: a null text encodes as empty (no ids, 0 tokens) and decodes to empty bytes;
rows with null or repeated ids are kept one for one; other columns are ignored; long texts
are taken in parts cut at blanks that no pre-token crosses.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, safe_pieces

PART_CHARS = 262_144
#: Encoded pieces that a worker remembers, in two generations of this size.
MEMO_PIECES = 100_000
MEMO_CHARS = 64
#: Pairs of adjacent tokens whose compatibility it remembers.
MEMO_PAIRS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.text_of = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.size = {rank: len(token) for token, rank in self.ranks.items()}
        self.above = max(self.text_of, default=0) + 2
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.follows: dict[int, int] = {}
        for rank in sorted(self.text_of):
            self._grow(rank)
        #: The longest token that is a proper prefix of each; -1: none.
        self.shorter = {rank: next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1) for token, rank in self.ranks.items()}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_units: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}
        self.bytes_of = [b""] * (max(self.text_of, default=-1) + 1)
        for rank, token in self.text_of.items():
            self.bytes_of[rank] = token.encode("latin-1")

    def _grow(self, rank: int) -> None:
        """Find which two lower tokens merge into this one; single bytes are their own parts."""
        token = self.text_of[rank]
        self.parts[rank] = (rank, rank)
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
            if left < rank and right < rank and self._adjacent(left, right):
                self.parts[rank] = (left, right)
                self.joined[left, right] = rank
                break

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joint text leaves exactly these two tokens.

        Peels both merge trees back along the seam, the later merge first: were there a merge
        across the seam of lower rank than what is being peeled, it would have come before.
        """
        bar = self.above
        while True:
            if self.joined.get((left, right), bar) < bar:
                return False
            seam_left, seam_right = self.parts[left][1], self.parts[right][0]
            whole_left, whole_right = seam_left == left, seam_right == right
            if whole_left and whole_right:
                return True
            if whole_right or (left > right and not whole_left):
                bar, left = left, seam_left
            else:
                bar, right = right + 1, seam_right

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece (Latin-1 characters for bytes)."""
        size, follows = self.size, self.follows
        longest: dict[int, int] = {}
        for end, rank in self.automaton.iter(piece):
            longest[end + 1 - size[rank]] = rank
        length, at, out, last = len(piece), 0, [], -1
        closed: set[int] = set()
        token = longest.get(0, -1)
        while at < length:
            if last >= 0 and token >= 0:
                pair = last << 32 | token
                token = follows.get(pair, -2)
                if token == -2:
                    token = self._follow(pair)
            if token < 0:
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte of the text")
                closed.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = self.shorter[token]
                continue
            end = at + size[token]
            if end in closed:
                token = self.shorter[token]
                continue
            out.append(token)
            last, at = token, end
            token = longest.get(at, -1)
        return out

    def _follow(self, pair: int) -> int:
        """The longest of a token and its prefixes that can stand after another; -1: none. Memoised."""
        last, token = pair >> 32, pair & 0xFFFFFFFF
        while token >= 0 and not self._adjacent(last, token):
            token = self.shorter[token]
        if len(self.follows) > MEMO_PAIRS:
            self.follows.clear()
        self.follows[pair] = token
        return token

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers.

        A blank before a character that is not white space always starts a pre-token, so the
        text falls into units there; frequent units are remembered whole.
        """
        if not text:
            return b""
        young = self.young_units.get
        first, *words = text.split(" ")
        if not first or first[-1:].isspace() or (words and (not words[0] or words[0][0].isspace())):
            return self._uneven(text)
        coded = [young(word) for word in words]
        if None in coded:
            for i, have in enumerate(coded):
                if have is None:
                    word = words[i]
                    if not word or word[0].isspace():
                        return self._uneven(text)
                    coded[i] = self._unit(word)
        coded.insert(0, self._pieces(first))
        return b"".join(coded)

    def _uneven(self, text: str) -> bytes:
        """``encode`` for a text in which some blank is followed by white space."""
        found: list[bytes] = []
        for part in safe_pieces(text, PART_CHARS, keep_blank=True):
            found.append(self._pieces(part))
        return b"".join(found)

    def _unit(self, word: str) -> bytes:
        """Ids of a blank and a word that starts with no white space."""
        have = self.young_units.get(word)
        if have is None:
            have = self.old_units.get(word)
            if have is None:
                if word.isalpha():
                    have = self._piece(" " + word)
                elif word[:-1].isalpha() and word[-1] in ".,":
                    have = self._piece(" " + word[:-1]) + self._piece(word[-1])
                else:
                    have = self._pieces(" " + word)
            if len(word) <= MEMO_CHARS:
                if len(self.young_units) >= MEMO_PIECES:
                    self.old_units, self.young_units = self.young_units, {}
                self.young_units[word] = have
        return have

    def _pieces(self, part: str) -> bytes:
        return b"".join(map(self._piece, self.pattern.findall(part)))

    def _piece(self, piece: str) -> bytes:
        have = self.young.get(piece)
        if have is not None:
            return have
        have = self.old.get(piece)
        if have is None:
            raw = piece.encode().decode("latin-1")
            have = self.packed.get(raw)
            if have is None:
                ids = self.merge(raw)
                have = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(self.young) >= MEMO_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = have
        return have

    def forget(self) -> None:
        """Drop what was remembered of the texts so far."""
        self.young, self.old, self.young_units, self.old_units = {}, {}, {}, {}

    def decode(self, ids: bytes) -> bytes:
        return decoded(ids, self.bytes_of)


def decoded(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def token_table(path: str) -> list[bytes]:
    """Token bytes by rank: all that decoding needs."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = codec(ranks, pattern)
        ids = [model.encode(text.as_py() or "") for text in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    out = arrow_map(id_and_text(docs, id_col, text_col), run, f"id {kind}, n_tokens long, ids binary", lambda: codec(ranks, pattern).forget())
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids")


def bpe_decode(coded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``coded``: the key, ``n_tokens``, ``ids`` and ``decoded``, the bytes that the ids stand for."""
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = token_table(ranks)
        raw = [x.as_py() or b"" for x in batch.column("ids")]
        return _coded_rows(batch.column("id"), raw, [decoded(x, table) for x in raw])

    rows = coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("binary").alias("ids"))
    out = arrow_map(rows, run, f"id {kind}, n_tokens long, ids binary, decoded binary")
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids", "decoded")


def _coded_rows(keys: pa.Array, ids: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
    columns = [keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"])


def bpe_round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bpe_decode`` of ``bpe_encode`` in one pass, so that a task needs one Python worker instead of two."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = codec(ranks, pattern)
        ids = [model.encode(text.as_py() or "") for text in batch.column("text")]
        return _coded_rows(batch.column("id"), ids, [model.decode(x) for x in ids])

    out = arrow_map(id_and_text(docs, id_col, text_col), run, f"id {kind}, n_tokens long, ids binary, decoded binary", lambda: codec(ranks, pattern).forget())
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids", "decoded")
