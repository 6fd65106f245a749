"""What scans leave in the memory of executors, and what they exchange with them."""

import public_tokenizers
import pyarrow as pa

from biorec.llm import pieces, queries


def test_op6_exchanges_small_batches(spark, tmp_path):
    rows = [(i, f"word{i} " * 100) for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        queries.op6_sentencepiece(spark, str(tmp_path))

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

        got = [r["n"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 3 << 20 and max(got) < 1.5 * (1 << 20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_workers_give_memory_back_after_encoding_and_decoding(monkeypatch):
    released = []
    monkeypatch.setattr("biorec.llm.common.release_memory", lambda: released.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "mark": pa.array([1]), "text": pa.array(["a b"])})
    assert len(list(pieces._whole(public_tokenizers.path("piece_bpe_32k.model"))(iter([batch])))) == 1
    assert released == [1]
