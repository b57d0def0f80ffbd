"""What the pipeline's Python workers hold at a time is bounded, however many rows and new words come."""

import pyarrow as pa
import public_tokenizers

import corpus_pipeline
from tablewright.llm.textbytes import slices
from tablewright.llm.tokens import ENCODED_AT_ONCE, Encoder
from tablewright.session import BATCH_BYTES

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_read_batches_of_bounded_bytes(spark):
    def sizes_of(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes], pa.int64())], names=["n"])

    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 200) AS text", "'a' AS source").coalesce(1)
    spark.conf.unset(SETTING)
    try:
        corpus_pipeline.pack(spark, docs, "")
        sizes = [r.n for r in docs.mapInArrow(sizes_of, "n long").collect()]
        assert sum(sizes) > 4 * BATCH_BYTES
        assert max(sizes) < 2 * BATCH_BYTES
        spark.conf.set(SETTING, "9m")  # a session's own bound stays
        corpus_pipeline.pack(spark, docs.limit(5), "")
        assert spark.conf.get(SETTING) == "9m"
    finally:
        spark.conf.unset(SETTING)


def test_new_pieces_are_encoded_a_few_at_a_time():
    encoder, given = Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    plain = encoder.plain
    encoder.plain = lambda texts: given.append(len(texts)) or plain(texts)
    text = " ".join(f"w{i}x{i * 7}" for i in range(3 * ENCODED_AT_ONCE))
    [(_, data, starts)] = slices(pa.record_batch({"text": [text]}))
    for _ in range(2):
        ids, counts = encoder.encode(data, starts)
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert counts.tolist() == [len(ids)]
    assert sum(given) > ENCODED_AT_ONCE >= max(given)
