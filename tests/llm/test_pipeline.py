"""The pipeline on a small corpus with planted cases, and the llm queries against their SQL."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import corpus_pipeline
from refract.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda row: tuple(map(str, row))
    assert sorted((key(r[x] for x in want.columns) for r in df.collect())) == sorted(map(key, want.fetchall()))


def test_pipeline_decides_as_planted(spark, tmp_path):
    r = random.Random(2)
    text = lambda n, mark: " ".join(f"{mark}{r.choice('aeiou')}{r.randrange(900)}" for _ in range(n))
    item, passage = text(30, "bench"), text(60, "pass")
    clean = {i: text(100, "word") for i in range(20)}
    docs = {
        **clean,
        100: clean[3],
        101: " ".join([*clean[4].split()[:-1], "changed"]),
        102: text(40, "lead") + " " + passage,
        103: text(40, "tail") + " " + passage,
        104: text(20, "more") + " " + item,
        105: None,
        106: "12 !!",
    }
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*clean, 102, 103}
    assert out[102].size == 100 and out[103].size == 40
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "language"


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string, of long, text_key string, score string"


def stage_rows(spark, stage, rows, folder):
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, "y", "z") for i, t, lang, s in rows], SCHEMA)
    return stage(spark, docs, folder)


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bench"))
    item = " ".join(f"item{i}" for i in range(30))
    spark.createDataFrame([(1, item), (None, "none of this counts here at all"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, bench, name, stage):
    """Empty tables, nulls in every column, empty texts, repeated rows and extra columns with clashing names."""
    folder, item = bench
    empty = stage_rows(spark, stage, [], folder)
    assert empty.count() == 0
    long = "Dies ist ein langer Satz mit vielen Worten " * 10
    rows = [(1, long, "de", "a"), (1, long, "de", "a"), (2, long + "und mehr", None, None), (None, "ohne Nummer, mit Text", "de", "b"), (3, None, "de", "b"), (4, "", "de", "b"), (5, "12 34", None, None), (6, item, "de", "a"), (6, "eine andere Zeile", "de", "a")]
    got = stage_rows(spark, stage, rows, folder)
    out = [tuple(r)[:2] for r in got.collect()] if name != "mixture" else [(r.doc_id, r.size) for r in got.collect()]
    if name == "mixture":
        assert sorted(map(str, out)) == sorted(str((i, len((t or "").split()))) for i, t, *_ in rows)
        return
    assert got.columns == list(corpus_pipeline.COLUMNS)
    kept = {"near_copies": {0, 2, 3, 4, 5, 6, 7, 8}, "repeated_passages": set(range(9)) - {2}, "benchmark_items": set(range(9)) - {7}, "language": {0, 1, 2}}[name]
    if name == "near_copies":  # rows 0 and 1 are copies of one another, 2 is a near copy of them
        kept -= {2}
    texts = sorted(str(rows[i][:2]) for i in kept)
    if name == "repeated_passages":  # row 2 keeps what it doesn't share
        out = [x for x in out if x[0] != 2]
    if name == "language":  # learned from one text alone: what is unlike it may go, null and letterless texts must
        out = [x for x in out if x[0] in (1, 2, 3, 4, 5)]
    assert sorted(map(str, out)) == texts


def test_a_clean_row_of_a_repeated_id_stays(spark, bench):
    folder, item = bench
    rows = [(1, item, None, None), (1, "clean words of another row", None, None), (2, f"more around {item} and after", None, None), (None, item, None, None)]
    got = [(r.doc_id, r.text) for r in stage_rows(spark, dict(corpus_pipeline.STAGES)["benchmark_items"], rows, folder).collect()]
    assert sorted(got, key=str) == sorted([(1, "clean words of another row"), (None, item)], key=str)


def test_two_runs_at_once(spark, tmp_path):
    """Each run owns the scratch tables of its own stages."""
    r = random.Random(5)
    for k in range(2):
        rows = [(i, " ".join(f"w{k}{r.choice('aeiou')}{r.randrange(300)}" for _ in range(80)), "en", "s", 1) for i in range(8 + k)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda k: corpus_pipeline.run(spark, f"{tmp_path}/{k}").count(), range(2)))
    assert found == [8, 9]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
