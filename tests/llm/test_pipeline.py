"""Each stage of the pipeline against a brute-force version on its own input, and the whole run."""

import numpy as np
import pytest
from test_linededup import brute as brute_lines
from test_neardup import brute as brute_classes
from test_packing import check_packing, ids_of

import corpus_pipeline
from tallyforge.llm import decontaminate, linededup
from tallyforge.llm.words import word_hashes


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """The smallest data set with odd rows added: null, letterless and empty texts, copies, a null id and a null source."""
    out = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    odd = [(9001, None, "en", "src0", 0), (9002, "", "en", "src0", 0), (9003, "12 34 ?!", "en", "src1", 8), (9004, item, "en", "src2", len(item)), (None, "the cat sat on the mat and slept", "en", "src1", 31),
           (9005, "der hund liegt auf dem sofa", None, None, 27), (9006, "word " * 30_000, "en", "src3", 150_000), (9007, "only this one", "en", "src4", 13), (9007, "only this one", "en", "src4", 13)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(str(out / "documents.parquet"))
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        tables.append(docs.collect())
    source, languages, cleaned, single, clean, packed = tables

    kept = {r.doc_id for r in languages}
    letterless = {r.doc_id for r in source if not any(c.isalpha() for c in r.text or "")}
    assert not kept & letterless and len(source) - len(languages) <= len(letterless) + 0.02 * len(source)

    want = brute_lines([(r.doc_id, r.text, r.source) for r in languages], linededup.RATIO)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text, r.source) for r in cleaned), key=key) == sorted(want, key=key)
    assert all(r.n_chars == len(r.text) for r in cleaned)

    classes = brute_classes(dict((r.doc_id, r.text) for r in cleaned if r.doc_id is not None).items())
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted(set(classes.values()))

    items = [word_hashes(r.text.encode(), marks=True) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in single if any(decontaminate.infix_distance(i, word_hashes(r.text.encode(), marks=True)) <= decontaminate.edits_allowed(len(i)) for i in items)}
    assert 9004 in leaks and {r.doc_id for r in clean} == {r.doc_id for r in single} - leaks

    n = check_packing(packed, {r.doc_id: ids_of(r.text) for r in clean}, 1024)
    assert n <= np.ceil(sum(r.length for r in packed) / 1024) * 1.06 + 1


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert corpus_pipeline.ORACLE_SQL is None
