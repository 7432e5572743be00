import corpus_pipeline
import pytest
from test_variants import brute, words_of

from pathloom.llm import queries
from pathloom.llm.decontaminate import contaminated
from pathloom.llm.pii import base_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == columns, name
    kept = now.collect()
    assert 0.5 * docs.count() < len(kept) == len({r["doc_id"] for r in kept})
    assert not any(base_spans(r["text"]) for r in kept) and all(len(r["text"]) == r["n_chars"] for r in kept)
    assert contaminated(now, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == len(kept)


ROW = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = "the harbour lay quiet under a pale sky and the boats came slowly home with the tide"


def kept_after(spark, rows, stages=corpus_pipeline.STAGES[:-1]):
    now = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], ROW)
    for _, stage in stages:
        now = stage(spark, now, SF)
    return sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=str)


def test_no_rows_vanish(spark):
    rows = [(1, None), (2, None), (3, ""), (4, "   "), (5, PLAIN), (5, "a letter came from the hills with word of the early snow and the closed road"), (None, None)]
    assert kept_after(spark, rows) == sorted(rows, key=str)


def test_one_of_each_group_stays(spark):
    near = PLAIN.replace("tide", "evening")
    rows = [(9, PLAIN), (7, near), (None, PLAIN), (7, near), (8, "something else entirely was written on this page by hand")]
    assert kept_after(spark, rows, corpus_pipeline.STAGES[1:2]) == [(7, near), (8, rows[-1][1])]


def test_leak_goes_and_its_namesake_stays(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, f"{PLAIN} {item} {PLAIN}"), (1, PLAIN), (None, item), (2, "")]
    assert kept_after(spark, rows, corpus_pipeline.STAGES[2:3]) == [(1, PLAIN), (2, "")]


def test_stages_of_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], ROW), SF).count() == 0


#: Rows of each query's result: one for each row of a table, or of the queries among them.
ROWS = {"documents": ["op1_token_counts", "op3_pii", "op5_simhash", "op6_byte_bpe", "op7_toxicity", "op9_suffix_array", "op10_language_id", "op11_merkle_manifest", "op12_substring_dedup"], "pages": ["op4_warc"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    found = queries.QUERIES[name](spark, SF)
    table = next((t for t, names in ROWS.items() if name in names), None)
    if table is not None:
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        key = "doc_id" if table == "documents" else "page_id"
        assert sorted(r[0] for r in found.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())
    elif name == "op2_decontamination":
        assert found.count() > 0 and found.filter("distance > floor(0.2 * item_words)").count() == 0
    elif name == "op13_spelling_variants":
        docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
        assert sorted(tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()) == brute(words_of(docs))
    else:
        asked = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 50 = 0").count()
        assert found.count() == 5 * asked


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    told = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(map(str, told.fetchall())) == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(*names).collect())
