import re
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from tidemark.llm import langid, lines, neardup, packing, tokens
from tidemark.llm.queries import ORACLES, QUERIES, vocabulary

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@needs_data
def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == docs.columns, name
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, out))
        assert set(after) <= set(before)
        if name == "language_id":
            known = langid.predict(docs, langid.train(docs)).collect()
            assert {r.doc_id for r in known if r.lang_pred != "und" and r.score >= 0.5} == set(after)
            assert all(re.search(r"[^\W\d_]", t) for t in after.values())
        if name == "quality_rules":
            verdicts = {i: lines.analyse(t, lines.Rules()) for i, t in before.items()}
            assert after == {i: v[7] for i, v in verdicts.items() if v[6]}
        if name == "minhash_dedup":
            assert set(after) == {r.doc_id for r in neardup.near_duplicates(docs).collect() if r.kept}
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    enc = tokens.ByteTokens(vocabulary("byte_bpe_50k.json"))
    assert {r.doc_id: r.doc_tokens for r in pieces} == {r.doc_id: len(enc.encode(r.text)) // 4 + 1 for r in docs.collect()}


@needs_data
def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
    # where a document is cut depends on its neighbours in the batch
    whole = lambda df: sorted({(r.doc_id, r.doc_tokens) for r in df.collect()})
    got = corpus_pipeline.run(spark, DATA)
    assert whole(got) == whole(docs) and got.columns == docs.columns


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    assert sorted(map(str, map(tuple, got.select(cols).collect()))) == sorted(map(str, want.select(", ".join(cols)).fetchall()))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, keep string, key string, block long, row long"


def rows_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), "k", "x", 1, 2) for i, t, lang in rows], COLUMNS)


ENGLISH = " ".join(f"the river and {w} walked to the town." for w in "one two three four five six seven eight nine ten".split())
GERMAN = " ".join(f"der fluss und {w} ging durch die stadt." for w in "eins zwei drei vier sieben acht neun zehn elf".split())
LABELLED = [(100 + i, f"{i} {ENGLISH}", "en") for i in range(12)] + [(200 + i, f"{i} {GERMAN}", "de") for i in range(12)]


def test_the_language_stage_follows_its_model(spark):
    odd = [(1, ENGLISH, None), (2, GERMAN, None), (3, "123 --", None), (4, None, "en"), (5, "", "en"), (None, ENGLISH, None), (1, ENGLISH, None), (6, (ENGLISH + " ") * 4000, None)]
    docs = rows_of(spark, LABELLED + odd)
    ids = lambda df: sorted((r.doc_id for r in df.collect() if r.doc_id is None or r.doc_id < 100), key=str)
    model = langid.train(docs)
    got = corpus_pipeline.language_id(spark, docs, DATA)
    assert ids(got) == [1, 1, 2, 6, None] and got.schema == docs.schema
    assert ids(langid.known_language(docs, model, languages=["de"])) == [2]
    assert ids(langid.known_language(docs, model, least_score=1.01)) == []
    # with the languages' names exchanged the others stay
    other = langid.Model(model.kernel, model.languages[::-1], model.weights)
    assert ids(langid.known_language(docs, other, languages=["de"])) == [1, 1, 6, None]
    # a model that cannot tell them apart has no language above the score
    blank = langid.Model(model.kernel, model.languages, [w * 0 for w in model.weights])
    assert ids(langid.known_language(docs, blank, least_score=0.6)) == []


def test_stages_on_odd_rows_and_empty_tables(spark):
    odd = [(1, None, "en"), (2, "", "en"), (None, ENGLISH, "en"), (None, ENGLISH, "en"), (3, ENGLISH, None), (3, ENGLISH, None), (4, ENGLISH, "en"), (5, GERMAN, "de"), (6, "x " * 30_000, "en"), (7, f"{ENGLISH}\n" * 3000, "en")]
    for rows in (odd, LABELLED + odd, []):
        docs = rows_of(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns
            kept = out.collect()
            assert len(kept) <= len(rows)
            if name == "minhash_dedup":
                # rows that share an id are one document, of which one stays; a row without an id belongs to no group
                assert sorted(r.doc_id for r in kept if r.doc_id and r.doc_id < 7) == ([1, 2, 3, 5, 6] if rows else [])
                assert sum(r.doc_id is None for r in kept) == (2 if rows else 0)
            else:
                assert not {r.doc_id for r in kept} & {1, 2}
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
        by_row = sum(p.doc_tokens for p in pieces if p.start == 0)
        assert sum(p.length for p in pieces) == by_row and len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)


def test_run_on_an_empty_table(spark, tmp_path):
    rows_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["doc_id", *packing.PIECES.replace(" long", "").split(", ")]


def test_unlabelled_documents_stay(spark):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(["some words", "ünder", "12 34", "", None])], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, DATA).collect()} == {0, 1}


def test_the_rest_works_without_this_subpackage(tmp_path):
    top = Path(__file__).resolve().parents[2]
    subprocess.run(f"cp -r {top}/tidemark {top}/__spark_entry__.py {tmp_path} && rm -r {tmp_path}/tidemark/llm", shell=True, check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
