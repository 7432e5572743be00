import random

import numpy as np

from pathloom.llm import simhash
from pathloom.llm.components import components


def brute_components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = {(max(p), min(p)) for p in links}
    want = brute_components(500, lambda a, b: (a, b) in pairs)
    assert all(want[n] == r for n, r in found.items()) and set(found) == {x for p in pairs for x in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_lose_none(spark, monkeypatch):
    draw = np.random.default_rng(2)
    fps = set(draw.integers(-(2**62), 2**62, 150).tolist())
    for seed in list(fps)[:20]:
        for _ in range(12):
            x = seed
            for bit in draw.integers(0, 63, draw.integers(1, 4)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    for dense in (1_000, 2):
        monkeypatch.setattr(simhash, "DENSE", dense)
        found = [tuple(r) for r in simhash.near_links(rows).collect()]
        assert set(found) == want and len(found) == len(want)


def test_classes_and_odd_rows(spark):
    docs = spark.createDataFrame([(5, "A b c d", 1), (3, "a B c d", 2), (7, "other words here now", 3), (None, None, 4), (2, "", 5), (9, " ", 6)], "doc_id long, text string, fp int")
    rows = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_classes(docs).collect()}
    assert {k[0]: v for k, v in rows.items()} == {5: 3, 3: 3, 7: 7, None: 2, 2: 2, 9: 9}
    assert rows[2, "0" * 16] == 2
    assert simhash.simhash_classes(docs.limit(0)).count() == 0


def test_groups_by_shingles(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    base = [[draw.choice(words) for _ in range(200)] for _ in range(12)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for edits in (0, 1, 2, 3, 30):
            x = list(b)
            for _ in range(edits):
                x[draw.randrange(len(x))] = draw.choice(words)
            texts.append(" ".join(x))
    texts += ["", None, "one two", "one two"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    want = brute_components(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)
    found = {r["id"]: r["group_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wrong = sum(found[i] != w for i, w in enumerate(want))
    assert all(want[found[i]] == w for i, w in enumerate(want)), "texts grouped that aren't near"
    assert wrong <= 0.05 * len(texts)


def shingle_sets(texts):
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_buckets_are_compared_whole(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(6):
        x = [draw.choice(words) for _ in range(400)]
        for k in range(30):  # versions, each with 3 % of its words changed: far ones aren't near
            texts.append(" ".join(x))
            x = list(x)
            for _ in range(4 + 3 * (k % 2)):
                x[draw.randrange(len(x))] = draw.choice(words)
    sets = shingle_sets(texts)
    want = brute_components(len(texts), lambda a, b: near(sets[a], sets[b]))
    found = {r["id"]: r["group_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_blocks_keep_pairs_near(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    fresh = lambda n: [draw.choice(words) for _ in range(n)]
    texts, pairs = [], []
    for k in range(240):
        x = fresh(300)
        if k % 2:  # a block appended: 296 of 296 + m shingles, 0.80 to 0.85
            y = x + fresh(52 + k % 4 * 7)
        else:  # a block of m words replaced: m + 4 shingles differ on either side
            m, at = 24 + k % 4 * 2, draw.randrange(20, 220)
            y = x[:at] + fresh(m) + x[at + m :]
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(x), " ".join(y)]
    sets = shingle_sets(texts)
    similar = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs]
    assert 0.8 <= min(similar) < 0.81 and 0.8 < max(similar) <= 0.85
    found = {r["id"]: r["group_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for odd in (0, 1):
        hit = [found[a] == found[b] for k, (a, b) in enumerate(pairs) if k % 2 == odd]
        print("appended" if odd else "replaced", sum(hit) / len(hit))
        assert sum(hit) >= 0.98 * len(hit)


def test_families_of_templates_keep_their_links(spark):
    draw = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for k in range(160):  # three texts that share a part of their words; chains of copies of a copy
        x = [draw.choice(words) for _ in range(200)]
        for _ in range(3):
            y = list(x)
            if k % 2:
                at = draw.randrange(160)
                y[at : at + 4 + k % 9] = [draw.choice(words) for _ in range(4 + k % 9)]
            else:
                for _ in range(1 + k % 3):
                    y[draw.randrange(len(y))] = draw.choice(words)
                x = y
            texts.append(" ".join(y))
    sets = shingle_sets(texts)
    found = {r["id"]: r["group_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    links = [(a, b) for a in range(len(texts)) for b in range(a // 3 * 3, a) if near(sets[a], sets[b])]
    kept = sum(found[a] == found[b] for a, b in links)
    print("links", kept, len(links))
    assert len(links) > 200 and kept >= 0.99 * len(links)


def test_groups_of_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, "   "), (5, "one text of its own here"), (5, "quite another text under that key"), (None, "one text of its own here"), (5, "one text of its own here"), (None, None)]
    found = simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((str(r["id"]), str(r["group_id"])) for r in found) == sorted([("1", "1"), ("2", "2"), ("3", "3"), ("4", "4"), ("5", "5"), ("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")])
    assert len({bytes(r["group_mark"]) for r in found if r["id"] == 5}) == 2
    assert simhash.near_duplicate_groups(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def plain_fingerprint(text):
    """By the definition: words between blanks and control characters, bits set in over half of the hashes of 3-word shingles."""
    import re

    import xxhash

    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return "".join(format(int("".join("1" if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) else "0" for b in range(63, -1, -1)), 2), "016x"))


def test_fingerprints_by_the_definition(spark):
    draw = random.Random(9)
    pick = lambda n: "".join(draw.choice(["Ab", "c", "É", " ", " ", "\t", "\n", "\x0b", "\u00a0", "\u2003", "Zz"]) for _ in range(n))
    texts = [pick(draw.randrange(60)) for _ in range(200)] + [None, "", " \t", "one", "One two", " ".join(f"w{draw.randrange(50)}" for _ in range(70_000))]
    found = {r["doc_id"]: r["fingerprint"] for r in simhash.simhash_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(found[i] == plain_fingerprint(t) for i, t in enumerate(texts))


def test_simhash_classes_broadcast_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{i} is here {i % 3}") for i in range(20)], "doc_id long, text string")
    out = simhash.simhash_classes(docs)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 20


def test_groups_come_by_fingerprints(spark, monkeypatch):
    draw = random.Random(14)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(8):
        x = [draw.choice(words) for _ in range(400)]
        texts += [" ".join(x), " ".join([*x[:-1], "other"]), " ".join(x[:-1])]
    texts += ["one two three", "one two three four", "", None]
    fps = [int(plain_fingerprint(t), 16) for t in texts]
    want = brute_components(len(texts), lambda a, b: bool(texts[a] and texts[b]) and (fps[a] ^ fps[b]).bit_count() <= 3)
    assert len(set(want)) < len(texts) - 8
    profile = simhash._profile
    without = lambda *args: (*(p := profile(*args))[:-3], p[-3][:0], *p[-2:])
    monkeypatch.setattr(simhash, "_profile", without)  # no MinHash keys: only fingerprints bring texts together
    found = {r["id"]: r["group_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == want
