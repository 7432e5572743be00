import hashlib
import zlib

from pyspark.sql import functions as F

from pathloom.llm import manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, grp string, key int, pos int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """Top digest of a list of digests, and for each the (left, right) siblings on the way."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for n, at in enumerate(where):
            run, i = runs[at // 8], at % 8
            paths[n].append((run[:i], run[i + 1 :]))
            where[n] = at // 8
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def brute(rows):
    langs, out, tops = {}, [], []
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops.append(climb([leaf(r) for r in langs[lang]]))
    root, above = climb([t for t, _ in tops])
    for lang, (subroot, paths), upper in zip(order, tops, above, strict=True):
        for row, path in zip(langs[lang], paths, strict=True):
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf((*row[:4], text))
            for left, right in path + upper:
                now = h(*left, now, *right)
            proof = h(*[x for left, right in path + upper for x in left + right])
            out.append((row[0], leaf(row), subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def through_spark(spark, tmp_path, rows, name):
    docs = spark.createDataFrame([(*r, "g", 1, 2) for r in rows], SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted(map(tuple, manifest.op11_merkle_manifest(spark, f"{tmp_path}/{name}").collect()), key=str)


def fixture(n):
    langs = ["en", "en", "en", "é", "Zz", None, ""]
    rows = [(i, f"s{i % 3}", langs[i * i % 7], i, f"Text É {i} ABC") for i in range(n)]
    rows += [(None, None, None, None, None), (5, "s", "en", 1, None), (5, "s", "en", 1, ""), (5, "s", "en", 1, ""), (-7, "", "alone", 0, "X" * 300_000), (None, "q", "en", None, "A")]
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = fixture(700)
    assert through_spark(spark, tmp_path, rows, "many") == brute(rows)


def test_small_tables(spark, tmp_path):
    one = [(3, "s", "en", 1, "Abc")]
    assert through_spark(spark, tmp_path, one, "one") == brute(one)
    assert through_spark(spark, tmp_path, [], "none") == []
    for n in (8, 9, 64, 65):
        rows = [(i, "s", "en", i, str(i)) for i in range(n)]
        assert through_spark(spark, tmp_path, rows, f"n{n}") == brute(rows)


def test_store_levels(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("a").alias("lang"), F.col("id").alias("doc_id"))
    manifest.write_manifest(rows, f"{tmp_path}/store", ["doc_id", "lang"], "lang", "doc_id")
    sizes = [spark.read.parquet(f"{tmp_path}/store/groups/nodes/level={k}").count() for k in (1, 2, 3, 4)]
    assert sizes == [125, 16, 2, 1]
    assert manifest.proofs(spark, f"{tmp_path}/store").filter(manifest.folded(F.col("path"), F.col("leaf")) != F.col("root")).count() == 0
