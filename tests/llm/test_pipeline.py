"""The pipeline against a brute-force version, and the SQL twins of the subpackage."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

import corpus_pipeline
from compare import oracle, rows_of
from granary.llm import toxicity
from granary.llm.batches import read
from granary.llm.queries import ORACLE, QUERIES, held_out, vocabulary
from granary.llm.tokens import encoder

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    cursor = oracle(FOLDER).execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, cursor.fetchall())


def test_pipeline(spark):
    docs = {r["doc_id"]: r for r in read(spark, FOLDER, "documents").collect()}
    model = toxicity.trained(read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels").where(~held_out(4, 2)))
    texts = {d: r["text"] for d, r in docs.items() if model.score(r["text"]) < corpus_pipeline.TOXIC_FROM}
    texts = brute.dedup_lines(texts)
    groups = brute.components({d: brute.simhash(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if groups[d] == d}
    taken = brute.mixed([(d, docs[d]["source"], -(-len((t or "").encode()) // 4)) for d, t in texts.items()])
    encode = encoder(vocabulary())
    want = Counter()
    for d, _ in taken:
        ids = (encode.ids(texts[d]) if texts[d] else []) + [0]
        want[d, len(ids)] += 1

    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == want
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
        ids = (encode.ids(texts[r["doc_id"]]) if texts[r["doc_id"]] else []) + [0]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"]
    assert sum(filled.values()) == sum(n * c for (_, n), c in want.items())
    assert sorted(filled.values())[1:] == [1024] * (len(filled) - 1)


def test_stages_keep_columns(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = read(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
