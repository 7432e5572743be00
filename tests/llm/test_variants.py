import random
import re
import zlib
from collections import Counter

from pathloom.llm import variants


def words_of(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "[" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            out[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    forms, out = {}, []
    for w, n in words.items():
        near = [x for x in words if one_apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = (best if best is not None and words[best] >= 5 * n else None, len(near))
    for w, n in words.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        form, near = forms[w]
        out.append((w, form, root, n, near, words[form] if form else None))
    return sorted(out)


def fixture():
    draw = random.Random(7)
    letters = "abcdeéßABC÷"
    base = ["".join(draw.choice(letters) for _ in range(draw.randrange(6, 14))) for _ in range(60)] + ["aaaaaaa", "banana" * 3, "ababab", "ÿÿÿÿÿÿ"]
    pool = []
    for w in base:
        pool += [w] * draw.choice([5, 30, 200, 1000])
        for _ in range(8):
            i, kind = draw.randrange(len(w)), draw.randrange(3)
            pool += [w[:i] + (draw.choice(letters) if kind else "") + w[i + (kind < 2) :]] * draw.choice([1, 5, 6, 40])
    draw.shuffle(pool)
    rows = [(i, draw.choice([" ", ", ", "\n", "7", "€"]).join(pool[i * 50 : i * 50 + 50])) for i in range(len(pool) // 50 + 1)]
    rows += [(None, " ".join(base)), (None, None), (5, ""), (5, "Ünïcode ünïcode " * 5), (6, "x" * 100_000), (7, rows[0][1]), (7, rows[0][1]), (8, "Ābcdefg " * 9)]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(k, t, "w", 3) for k, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    counted = variants.word_counts(docs)
    got = sorted(tuple(r) for r in variants.variant_forms(counted).collect())
    want = brute(words_of(rows))
    assert got == want
    assert any(r[1] for r in want) and any(not r[4] for r in want)


def test_chains_and_ties(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "bbbbbb": 9, "bbbbbc": 45, "bbbbba": 45, "cccccc": 44, "ccccccc": 9}
    counted = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(tuple(r) for r in variants.variant_forms(counted).collect())
    assert got == brute(words)
    assert {r[0]: r[2] for r in got}["aaaaaa"] == "aaabbb" and {r[0]: r[1] for r in got}["bbbbbb"] == "bbbbba"


def test_long_texts_come_in_pieces():
    text = " ".join(f"wörd{'x' * (i % 7)}" for i in range(3000))
    whole = variants.runs_of(text)
    assert sum(map(Counter, map(lambda p: variants.runs_of(p), variants._pieces(text, 100))), Counter()) == whole
    assert list(variants._pieces("x" * 50, 10)) == ["x" * 50]


def test_empty_table(spark):
    assert variants.variant_forms(variants.word_counts(spark.createDataFrame([], "doc_id string, text string"))).collect() == []
