import random

import numpy as np

from pathloom.llm import repeats


def brute(rows):
    """Kept bytes, removed bytes and runs of each (key, text), in order of keys."""
    seen, out = set(), []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            else:
                seen.add(w)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if raw else 0
        out.append((key, len(raw), int(gone.sum()), runs, bytes(c for c, g in zip(raw, gone, strict=False) if not g)))
    return out


def fixture():
    draw = random.Random(1)
    text = lambda n: "".join(draw.choice("abcdé .") for _ in range(n))
    passages = [text(n) for n in (99, 100, 101, 180, 400)]
    rows = []
    for i in range(60):
        parts = [text(draw.randrange(0, 200))]
        for _ in range(draw.randrange(4)):
            parts += [draw.choice(passages), text(draw.randrange(0, 60))]
        rows.append((i, "".join(parts)))
    rows += [(60, "a" * 500), (61, "ab" * 400), (62, rows[3][1]), (63, ""), (64, None), (65, "a" * 99), (66, "x" + "a" * 150 + "\x00" * 130), (67, "\x00" * 240)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = fixture()
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, low int").repartition(5)
    for spread, chunk, piece, batch in ((2_000, 1 << 19, 8 << 20, 1 << 17), (1, 128, 900, 64)):
        monkeypatch.setattr(repeats, "SPREAD", spread)
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        monkeypatch.setattr(repeats, "SLICE", piece)
        monkeypatch.setattr(repeats, "BATCH", batch)
        got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(docs).collect()}
        assert got == set(brute(rows))


def test_family_of_levels():
    draw = np.random.default_rng(2)
    family, seen = repeats.SuffixFamily(), set()
    for _ in range(40):
        batch = np.array([bytes(draw.integers(97, 100, repeats.LENGTH, dtype=np.uint8)) if draw.random() < 0.5 else bytes([draw.integers(97, 123)]) * repeats.LENGTH for _ in range(draw.integers(1, 30))], dtype=f"S{repeats.LENGTH}")
        known = family.add(batch)
        for w, k in zip(batch.tolist(), known.tolist(), strict=True):
            assert k == (w in seen)
            seen.add(w)
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(seen)


def test_odd_rows(spark):
    long = "qwertyuiop" * 15
    docs = spark.createDataFrame([(None, long + "z"), (5, long), (5, long)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in repeats.remove_repeats(docs).collect())
    assert [g[0] for g in got] == [-1, 5, 5] and got[1] == got[2]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_common_string_in_many_surroundings(spark):
    draw = random.Random(4)
    text = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    phrase, ends = text(85), [text(70) for _ in range(40)]
    rows = [(i, (draw.choice(ends) if draw.random() < 0.3 else text(70)) + phrase + (draw.choice(ends) if draw.random() < 0.3 else text(70))) for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(docs).collect()}
    want = set(brute(rows))
    assert got == want and sum(w[2] > 0 for w in want) > 1_000
