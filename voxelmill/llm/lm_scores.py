"""Cross-entropy difference of documents under a target and a background word bigram model.

Both models have one vocabulary and one smoothing, and the counts of the background are scaled to the
size of the target, so that their losses differ by the text alone. Counts are taken over all
documents: blocks of texts send the counts of their words and bigrams to hash buckets, which add
them up and send the totals of both models back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.blocks import PACKED, block_rows, by_bucket, gathered, packed_blocks, row_blocks
from voxelmill.llm.common import blocks_for, id_text, materialize
from voxelmill.llm.wordhash import U, Words, mix

BOUNDARY = U(0x5BD1E995A5A5A5A5)  # stands before the first and after the last word of a text
ANSWER = "block long, bucket long, payload binary, words long, target_tokens long, tokens long"
ANSWER_TYPE = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary()), ("words", pa.int64()), ("target_tokens", pa.int64()), ("tokens", pa.int64())])


class Grams:
    """Tokens (words and the closing boundary) of the texts of a block, and their distinct grams.

    ``row``: the text of each token; ``word``, ``before`` and ``pair``: the places of the token, of the
    one before it and of their bigram in ``grams``, which is sorted by bucket; ``is_word`` marks the
    single tokens in it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int, size: int = 1 << 18):
        hashes, rows, at = [np.empty(0, U)], [np.empty(0, np.int64)], 0
        while at < len(offsets) - 1:  # in pieces, as the arrays of letters are large
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            words = Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            hashes.append(words.hash)
            rows.append(words.row + at)
            at = end
        word, row = np.concatenate(hashes), np.concatenate(rows)
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        last = np.ones(len(row), bool)
        last[:-1] = first[1:]
        # A boundary after the last word of each text.
        place = np.arange(len(word)) + np.cumsum(first) - 1
        token = np.full(len(word) + int(last.sum()), BOUNDARY)
        token[place] = word
        self.row = np.empty(len(token), np.int64)
        self.row[place] = row
        self.row[place[last] + 1] = row[last]
        before = np.empty(len(token), U)
        before[1:] = token[:-1]
        before[:1] = BOUNDARY
        pair = mix(before * U(5) + mix(token + U(11)))
        self.grams, places, = np.unique(np.concatenate([token, pair]), return_inverse=True)
        self.is_word = np.zeros(len(self.grams), bool)
        self.is_word[places[: len(token)]] = True
        bucket = (self.grams % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.grams, self.is_word, self.bucket, places = self.grams[order], self.is_word[order], bucket[order], back[places]
        self.word, self.pair = places[: len(token)], places[len(token) :]
        self.before = np.empty(len(token), np.int64)
        self.before[1:] = self.word[:-1]
        self.before[:1] = self.word[-1:]  # the last token of a block is a boundary

    def counts(self, use: np.ndarray) -> np.ndarray:
        """Occurrences of each gram in the tokens that ``use`` marks."""
        return np.bincount(self.word[use], minlength=len(self.grams)) + np.bincount(self.pair[use], minlength=len(self.grams))


def steps_of(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as the steps between them, high bytes first, which compress well."""
    return np.diff(values, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(U).ravel(), dtype=U)


def lm_scores(
    docs: DataFrame, target_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    weight: float = 10.0, floor: float = 0.5, block_bytes: int = 6 << 20, bucket_bytes: int = 4 << 20,
) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row.

    ``target_ids``: one column, the ids of the documents that the target model is counted on; the
    background model is counted on all documents. Losses are means over the words of a text and its
    end, in nats; ``score`` is target_loss - background_loss, lower for texts like the target.
    A word w after v has the probability (c(v w) + weight * p(w)) / (c(v) + weight) with
    p(w) = (c(w) + floor) / (n + floor * vocabulary). Null, empty and blank texts have 0 tokens and null losses
    and count for nothing. Ids that no document has are ignored; rows without an id belong to the
    background alone; repeated rows count each. Without target texts all scores are 0. An empty
    table gives no rows; other columns are ignored.
    """
    texts = id_text(docs, id_col, text_col)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = blocks_for(size, bucket_bytes)

    def members(batches):
        for block, ids, _, _ in row_blocks(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), ids], names=["block", "doc_id"])

    def send(batches):
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                ids, data, offsets = block_rows(row)
                grams = Grams(data, offsets, buckets)
                wanted = set(row["target"] or ())
                is_target = np.array([i in wanted for i in ids.to_pylist()], bool)
                target, every = grams.counts(is_target[grams.row]), grams.counts(np.ones(len(grams.row), bool))
                out = []
                for k, a, b in by_bucket(grams.bucket):
                    body = b"".join([steps_of(grams.grams[a:b]), target[a:b].astype(np.uint32).tobytes(), every[a:b].astype(np.uint32).tobytes(), np.packbits(grams.is_word[a:b]).tobytes()])
                    out.append((row["block"], k, np.array([b - a, len(body)], np.uint32).tobytes() + pa.compress(body, "zstd", asbytes=True)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["block", "bucket", "payload"])

    def add_up(table):
        grams, target, every, is_word, sizes = [], [], [], [], []
        for p in table["payload"].to_pylist():
            n, whole = (int(x) for x in np.frombuffer(p, np.uint32, 2))
            body = pa.decompress(p[8:], whole, "zstd", asbytes=True)
            grams.append(from_steps(body[: 8 * n]))
            target.append(np.frombuffer(body, np.uint32, n, 8 * n))
            every.append(np.frombuffer(body, np.uint32, n, 12 * n))
            is_word.append(np.unpackbits(np.frombuffer(body, np.uint8, offset=16 * n), count=n).astype(bool))
            sizes.append(n)
        known, place = np.unique(np.concatenate(grams), return_inverse=True)
        total = [np.bincount(place, np.concatenate(x), len(known)).astype(np.int64) for x in (target, every)]
        words = np.zeros(len(known), bool)
        words[place[np.concatenate(is_word)]] = True
        stats = [int(words.sum()), *(int(t[words].sum()) for t in total)]
        out, at = [], 0
        for k, (block, bucket, n) in enumerate(zip(table["block"].to_pylist(), table["bucket"].to_pylist(), sizes)):
            mine = place[at : at + n]
            body = total[0][mine].tobytes() + total[1][mine].tobytes()
            out.append((block, bucket, np.array([n, len(body)], np.uint32).tobytes() + pa.compress(body, "zstd", asbytes=True), *(stats if k == 0 else (0, 0, 0))))
            at += n
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(ANSWER_TYPE)], schema=ANSWER_TYPE)

    packed = texts.mapInArrow(lambda batches: packed_blocks(batches, block_bytes), PACKED)
    wanted = target_ids.toDF("doc_id").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    in_target = texts.mapInArrow(members, "block long, doc_id long").join(wanted, "doc_id").groupBy("block").agg(F.collect_set("doc_id").alias("target"))
    sent = packed.join(in_target, "block", "left").mapInArrow(send, "block long, bucket long, payload binary")
    answers = materialize(sent.groupBy("bucket").applyInArrow(add_up, ANSWER), "lm-counts")
    vocabulary, n_target, n_all = (int(x or 0) for x in answers.agg(F.sum("words"), F.sum("target_tokens"), F.sum("tokens")).first())
    scale = n_target / n_all if n_all else 0.0

    def score(batches):
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                ids, data, offsets = block_rows(row)
                grams = Grams(data, offsets, buckets)
                counts = np.zeros((2, len(grams.grams)))
                answer = {a["bucket"]: a["payload"] for a in row["answers"] or []}
                for k, a, b in by_bucket(grams.bucket):
                    n, whole = (int(x) for x in np.frombuffer(answer[k], np.uint32, 2))
                    counts[:, a:b] = np.frombuffer(pa.decompress(answer[k][8:], whole, "zstd", asbytes=True), np.int64).reshape(2, n)
                tokens = np.bincount(grams.row, minlength=len(ids))
                losses = []
                for count, part in ((counts[0], 1.0), (counts[1], scale)):
                    count = count * part
                    p = (count + floor) / (n_target + floor * vocabulary)
                    loss = np.log(count[grams.before] + weight) - np.log(count[grams.pair] + weight * p[grams.word])
                    losses.append(np.bincount(grams.row, loss, len(ids)) / np.maximum(tokens, 1))
                none = tokens == 0
                yield pa.RecordBatch.from_arrays([ids, pa.array(tokens.astype(np.int64)), *(pa.array(x, mask=none) for x in (*losses, losses[0] - losses[1]))],
                                                 names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    return packed.join(gathered(answers.select("block", "bucket", "payload"), "answers"), "block", "left").mapInArrow(score, schema)
