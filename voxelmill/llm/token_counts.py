"""Token counts of documents by a map-side two-tier lookup.

A compact table of frequent pre-token lengths is broadcast; its size is bounded by ``frequent``
entries. Other pre-tokens are encoded once per worker and kept in its cache. Text never leaves its
scan task, so nothing is shuffled but the counts of the sample that the table is chosen from.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import id_text, pieces
from voxelmill.llm.pretokens import PretokenEncoder, encoder_of, splitter


def frequent_pretokens(texts: DataFrame, pattern: str, frequent: int, sample_rows: int) -> list[str]:
    """The most frequent pre-tokens of a row sample of about ``sample_rows`` rows. They only
    fill a cache: the counts are the same whatever they are."""
    rows = texts.count()
    if not rows:
        return []

    def split(batches):
        find = splitter(pattern)
        for batch in pieces(batches, 64):
            words = pa.array([w for t in batch.column(0).to_pylist() for w in find(t) if len(w) <= PretokenEncoder.LONGEST_CACHED], pa.string())
            counts = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["word", "n"])

    sample = texts.select("text").sample(min(1.0, sample_rows / rows), seed=7)
    counts = sample.mapInArrow(split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.filter("n > 1").orderBy(F.desc("n"), "word").limit(frequent)
    return [row.word for row in top.select("word").collect()]


def token_counts(
    docs: DataFrame, vocabulary_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 1024, frequent: int = 20_000, sample_rows: int = 1_000, cache_size: int = 400_000,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Counts are those of the tokenizer library for the whole text, with no begin, end or added
    special tokens; special strings inside a text are handled as the library does by default.
    Null and empty texts have 0 bytes and tokens; a null id stays null; repeated rows are counted
    each; an empty table gives no rows. Other columns are ignored. ``frequent``, ``sample_rows`` and
    ``cache_size`` only bound memory.
    """
    texts = id_text(docs, id_col, text_col)
    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    if vocabulary_path.endswith(".model"):
        with open(vocabulary_path, "rb") as f:
            model = sc.broadcast(f.read())

        def count(texts: list[str]) -> list[int]:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=model.value)
            return [len(x) for x in processor.encode(texts, num_threads=1)]
    else:
        with open(vocabulary_path, encoding="utf-8") as f:
            spec = f.read()
        words = frequent_pretokens(texts, pattern, frequent, sample_rows)
        encoder = PretokenEncoder(spec, pattern, len)
        words = [w for w in words if encoder.splits(w)] if encoder.by_word else []
        known = {w: len(e.ids) for w, e in zip(words, encoder.tokenizer.encode_batch(words, add_special_tokens=False))}
        tiers = sc.broadcast({"json": spec, "known": known, "cache_size": cache_size})

        def count(texts: list[str]) -> list[int]:
            return [sum(lengths) for lengths in encoder_of(tiers.value, pattern, len).values(texts)]

    def run(batches):
        for batch in pieces(batches, 256):
            text = batch.column(1)
            n = pa.array(count(text.to_pylist()), pa.int64())
            size = pc.cast(pc.binary_length(text), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts.mapInArrow(run, schema)
