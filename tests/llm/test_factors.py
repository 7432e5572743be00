import random
import re
from collections import Counter

import numpy as np
import pytest

from pathloom.llm import factors


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute(rows):
    """(key, words, removed words, words left) of each (key, text)."""
    words = [split(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((key, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return sorted(out, key=str)


def fixture():
    draw = random.Random(3)
    some = lambda n: [draw.choice(["a", "b", "c", "é", "word", " x", "longer"]) + draw.choice(["", "", str(draw.randrange(30))]) for _ in range(n)]
    passages = [some(n) for n in (34, 35, 36, 50, 62, 63, 90, 200)]
    rows = []
    for i in range(80):
        parts = some(draw.randrange(0, 60))
        for _ in range(draw.randrange(4)):
            passage = list(draw.choice(passages))
            if draw.random() < 0.3:
                passage[draw.randrange(len(passage))] = "edited"
            parts += passage + some(draw.randrange(0, 50))
        rows.append((i, draw.choice([" ", "\n", " \t\x0b"]).join(parts)))
    rows += [(80, "a " * 200), (81, "a b " * 100), (82, rows[3][1]), (82, rows[3][1]), (83, ""), (84, None), (None, " ".join(passages[4])), (None, "x " * 34), (None, None), (5, "other text of a known key"), (85, "q " * 34), (86, " \t "), (87, "z" * 3000)]
    return rows


@pytest.mark.parametrize("sizes", [(1 << 20, 2_000, 400_000, 1 << 20), (600, 2, 200, 2_000), (100, 0, 50, 2_000)])
def test_against_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("SLICE", "SPREAD", "BLOCK_WORDS", "LONG_WORD"), sizes, strict=True):
        monkeypatch.setattr(factors, name, value)
    rows = fixture()
    docs = spark.createDataFrame([(k, t, 1, "g", 2) for k, t in rows], "doc_id long, text string, low int, gram string, id int").repartition(5)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in factors.remove_duplicate_passages(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    out = factors.remove_duplicate_passages(spark.createDataFrame([], "doc_id int, text string"))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept"] and out.collect() == []


def test_block_knows_longest_matches():
    draw = random.Random(5)
    stretches = [[draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randrange(1, 62))] for _ in range(30)]
    block = factors.ReferenceBlock(stretches)
    places = [(s, i) for s in range(30) for i in range(len(stretches[s]))]
    for s, i in places:
        best = 0
        for t, j in places:
            n = 0
            while (s, i) != (t, j) and i + n < len(stretches[s]) and j + n < len(stretches[t]) and stretches[s][i + n] == stretches[t][j + n]:
                n += 1
            best = max(best, n)
        assert block.longest[block.begins[s] + i] == best
    owner, at, size = block.parse(np.arange(30))
    assert all(a2 == a1 + max(n, 1) for o1, o2, a1, a2, n in zip(owner, owner[1:], at, at[1:], size, strict=False) if o1 == o2)


def test_pieces_share_windows():
    text = b" ".join(str(i).encode() for i in range(5000))
    seen = Counter()
    for first, piece in factors._pieces(text, 700):
        words = piece.split()
        assert words[0] == str(first).encode()
        seen.update(range(first, first + len(words) - 34))
    assert set(seen) == set(range(5000 - 34)) and max(seen.values()) == 1
