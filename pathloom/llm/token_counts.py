"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts are cut at safe blanks into pieces, pieces are packed into batches of about equal
bytes, the tokenizer's own batch call encodes them, and only the lengths leave the worker.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); null or repeated ids are
kept, one result row per input row; an empty table gives an empty result; columns other
than the key and the text are ignored whatever their names.  A text with no safe blank is
encoded in one call.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, safe_pieces

PIECE_CHARS = 32_768
BATCH_BYTES = 1_000_000


@lru_cache(maxsize=4)
def lengths_of(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to token counts, and whether a safe blank stays with the next piece.

    By the file's kind: ``.model`` sentencepiece, ``.json`` tokenizers.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)], True


def count_batch(texts: list[str | None], path: str, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Tokens of each text, encoded in batches of about ``batch_bytes``."""
    lengths, keep_blank = lengths_of(path)
    totals = [0] * len(texts)
    owners: list[int] = []
    pieces: list[str] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for owner, n in zip(owners, lengths(pieces), strict=True):
            totals[owner] += n
        owners.clear()
        pieces.clear()
        held = 0

    for row, text in enumerate(texts):
        for piece in safe_pieces(text or "", piece_chars, keep_blank):
            owners.append(row)
            pieces.append(piece)
            held += len(piece) if piece.isascii() else len(piece.encode())
            if held >= batch_bytes:
                flush()
    flush()
    return totals


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``tokenizer``: path of a sentencepiece ``.model`` or a tokenizers ``.json`` that every
    executor can open.  No begin, end or added special tokens, no truncation, no padding.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, pa.array(count_batch(texts.to_pylist(), tokenizer), pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = arrow_map(id_and_text(docs, id_col, text_col), count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
