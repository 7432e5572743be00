import hashlib

import numpy as np
from pyspark.sql import functions as F

from pathloom.llm import top_k, warc
from pathloom.llm.warc import archive_path, read_archives, record_segments, write_archives


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(top_k, "STRIPE", 64)
    monkeypatch.setattr(top_k, "ROW_BLOCK", 150)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 3)
    monkeypatch.setattr(top_k, "CHUNK", 2)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 24)).astype(np.float32)
    x[200:260] = x[3]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (950, [float("nan")] * 24, 0), (1000, [float("inf")] + [0.0] * 23, 0), (None, x[0].tolist(), 0), (1050, [1.0, 2.0], 0)]
    out = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), F.col("vec_id") % 50 == 0).collect()
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = set()
    for i in range(0, 400, 50):
        scores = q @ q[i]
        order = sorted((j for j in range(400) if j != i), key=lambda j: (-scores[j], j))[:5]
        want |= {(i, r, j, int(scores[j])) for r, j in enumerate(order, 1)}
    assert {tuple(r) for r in out} == want and len(out) == len(want)


def test_far_blocks_are_not_shipped(spark, monkeypatch):
    monkeypatch.setattr(top_k, "ROW_BLOCK", 100)
    draw = np.random.default_rng(2)
    sides = draw.choice([-1.0, 1.0], size=(16, 4)).repeat(8, axis=1)
    x = np.array([3 * sides[i % 16] + draw.normal(size=32) * 0.1 for i in range(1600)]).astype(np.float32)
    shipped, kept = [], top_k.written
    monkeypatch.setattr(top_k, "written", lambda df, what: (shipped.append(df.count()) if what == "block-pairs" else None, kept(df, what))[1])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = {tuple(r) for r in top_k.top_k(rows, F.col("vec_id") % 50 == 0).collect()}
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = set()
    for i in range(0, 1600, 50):
        scores = q @ q[i]
        order = sorted((j for j in range(1600) if j != i), key=lambda j: (-scores[j], j))[:5]
        want |= {(i, r, j, int(scores[j])) for r, j in enumerate(order, 1)}
    blocks = len({tuple(s) for s in sides})
    print("pairs of blocks shipped", shipped)
    assert out == want and shipped[0] <= 3 * blocks


def test_top_k_of_repeated_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [2.0, 2.0]), (3, [2.0, 2.0]), (4, [2.0, 2.0])]
    found = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).collect()
    scale = 256 * 512
    assert sorted(tuple(r) for r in found) == [(0, 1, 3, scale), (0, 1, 3, scale), (0, 2, 3, scale), (0, 2, 3, scale)]
    assert top_k.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    big = "é<br>\r\n\r\nWARC/1.1\r\n" * 150_000
    rows = [(1, "http://a/\r\nX: y", "x" * 1500, 1), (2, "u", "x" * 1500, 1), (3, None, None, 1), (4, "u", "", 1), (5, "u", "short", 1), (6, "u", "short", 1), (7, "u", big, 1), (None, "u", "n\n\n", 1), (2, "u", "x" * 1500, 1)]
    path = archive_path(spark)
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest int"), path)
    chunks = read_archives(spark, path)
    last = chunks.filter("last").collect()
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["total_bytes"], r["digest"]) for r in last)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [((i or 0), "revisit" if i == 1 else "response", 2 if i == 1 else None, len((t or "").encode()), sha(t)) for i, _, t, _ in rows]
    assert got == sorted(want)
    parts = sorted(chunks.filter("page_id = 7").collect(), key=lambda r: r["chunk_no"])
    assert len(parts) > 1 and max(r["n_bytes"] for r in parts) <= 1 << 20
    assert b"".join(bytes(r["payload"]) for r in parts).decode() == big
    running = hashlib.sha1()
    for r in parts:
        running.update(bytes(r["payload"]))
        assert running.hexdigest() == r["digest"]


def test_warc_segments_are_records():
    segments = list(record_segments(1, "u", b"abcdef", "d", None, False, chunk=4))
    assert [s.split(b"\r\n")[1] for s in segments] == [b"WARC-Type: response", b"WARC-Type: continuation"]
    assert b"WARC-Segment-Total-Length" in segments[-1]


def test_warc_empty(spark):
    path = archive_path(spark)
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_archives(spark, path).count() == 0


def test_changed_payload_is_noticed(spark, tmp_path):
    import gzip

    import pytest

    segment = b"".join(record_segments(1, "u", b"abcdef", hashlib.sha1(b"abcdef").hexdigest(), None, False))
    for name, raw in (("good", segment), ("bad", segment.replace(b"abcdef", b"abcdeg"))):
        (tmp_path / name).mkdir()
        with gzip.open(tmp_path / name / "a.warc.gz", "wb") as out:
            out.write(raw + b"\r\n\r\n" if not raw.endswith(b"\r\n\r\n") else raw)
    assert read_archives(spark, str(tmp_path / "good")).filter("last").count() == 1
    with pytest.raises(Exception, match="differs from its digest"):
        read_archives(spark, str(tmp_path / "bad")).collect()


def test_blocks_are_bounded(spark, monkeypatch):
    """An outlier draws the averages to itself, and one row repeats: still no block of more than twice the size asked for."""
    monkeypatch.setattr(top_k, "ROW_BLOCK", 200)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 40)
    draw = np.random.default_rng(4)
    x = draw.normal(size=(8000, 16)).astype(np.float32)
    x[77] = 1e5
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, x[5].tolist())] * 3000
    sizes = []
    kept = top_k._block_pairs
    monkeypatch.setattr(top_k, "_block_pairs", lambda rows, asked, n, asking: (sizes.extend([rows.groupBy("rb").count().agg(F.max("count")).first()[0], asked.groupBy("qb").count().agg(F.max("count")).first()[0]]), kept(rows, asked, n, asking))[1])
    out = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), F.col("vec_id") % 50 == 0).collect()
    assert sizes[0] <= 400 and sizes[1] <= 80
    q = np.floor(256 * np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)).astype(np.int64)
    ids = np.array([r[0] for r in rows])
    for query in (0, 50, 7950):
        scores = q @ q[query]
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != query)[:5]
        assert sorted((-r["score"], r["vec_id"]) for r in out if r["query_id"] == query) == want


def test_archives_of_odd_records(spark, tmp_path):
    """Several rows with the largest key of equal payloads, null keys among them, empty and null payloads, sizes at the chunks' ends."""
    size = 1 << 20
    same, big = "s" * 1500, "é" * (size // 2)
    rows = [(1, "u", same), (9, "u", same), (9, "v", same), (None, "w", same), (2, None, None), (3, "u", ""), (4, "u", big), (5, "u", big + "x"), (6, "u", "short"), (7, "u", "short")]
    pages = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, number string, count int").repartition(3)
    path = archive_path(spark)
    write_archives(pages, path)
    found = read_archives(spark, path).filter("last").collect()
    want = []
    for key, _, text in rows:
        raw = (text or "").encode()
        revisit = raw == same.encode() and key != 9
        want.append((key, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert sorted(((r["page_id"], r["total_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == sorted(want, key=str)


def test_chunks_are_the_payload(spark):
    rows = spark.createDataFrame([(1, b"abcdefg"), (2, b""), (3, None), (4, b"abcd")], "id int, payload binary")
    out = [(r["id"], r["number"], r["count"], bytes(r["piece"])) for r in warc.chunk_rows(rows, 4).collect()]
    assert sorted(out) == [(1, 1, 2, b"abcd"), (1, 2, 2, b"efg"), (2, 1, 1, b""), (3, 1, 1, b""), (4, 1, 1, b"abcd")]
