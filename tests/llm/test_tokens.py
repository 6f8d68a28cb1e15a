"""Token counts, encoding and record files against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_fixtures import SMALL, make_docs, odd_rows  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelmill.llm import bpe_fold, pretokens, token_records
from voxelmill.llm.queries import QUERIES
from voxelmill.llm.token_counts import token_counts
from voxelmill.session import scratch_folder

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_fold.read_ranks(RANKS), special_tokens={})


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def pairs(rows):
    return sorted(rows, key=repr)


def test_split_pattern_is_the_public_one():
    assert pretokens.SPLIT_PATTERN == P.PATTERN


def test_plain_split_equals_general_split():
    general = pretokens.regex.compile(P.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    random.seed(3)
    letters = "aZé'stredvlm 09_!\n\tßɏ×²\x1c"
    for _ in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 25)))
        assert pretokens.splitter(P.PATTERN)(text) == general(text)


def test_words_of_the_merge_model_equal_the_library(library):
    encoder = pretokens.PretokenEncoder(open(JSON, encoding="utf-8").read(), P.PATTERN, tuple)
    for text in ("Hello there, it's  fine", "tab\tand\n\nlines ", "a<|endoftext|>b", "ɐ԰", "", "  "):
        assert [i for v in encoder.values([text])[0] for i in v] == ids_of(library, text)


def test_token_counts_on_odd_rows(make_docs, odd_rows, library):
    got = token_counts(make_docs(odd_rows), JSON, P.PATTERN, frequent=5, cache_size=3).collect()
    want = [(i, len((t or "").encode()), n, n > 1024) for i, t in odd_rows for n in [len(ids_of(library, t))]]
    assert pairs(tuple(r) for r in got) == pairs(want)


def test_token_counts_with_a_piece_model(make_docs, odd_rows):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = token_counts(make_docs(odd_rows), P.path("piece_bpe_32k.model"), P.PATTERN).collect()
    assert pairs((r.doc_id, r.n_tokens) for r in got) == pairs((i, len(processor.encode(t or ""))) for i, t in odd_rows)


def test_empty_tables(make_docs, spark):
    empty = make_docs([])
    assert token_counts(empty, JSON, P.PATTERN).count() == 0
    assert bpe_fold.encode_decode(empty, RANKS, P.PATTERN).count() == 0
    folder = scratch_folder(spark, "records")
    token_records.write_records(empty, folder, JSON, P.PATTERN)
    assert token_records.read_records(spark, folder).count() == 0


def test_token_count_query(spark, library):
    docs = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op1_token_counts"](spark, SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(ids_of(library, t)) for i, t in docs.items()}


def test_long_merge_equals_the_library(coder):
    ranks = bpe_fold.read_ranks(RANKS)
    random.seed(1)
    for _ in range(500):
        word = "".join(random.choice("abtheion ñé") for _ in range(random.randint(1, 60))).encode()
        assert bpe_fold.merge_long(word, ranks) == coder._encode_single_piece(word)


def test_table_of_pairs_finds_every_pair():
    pairs_ = bpe_fold.pair_ranks(bpe_fold.read_ranks(RANKS))
    factor, shifts, entries = bpe_fold.place_keys(pairs_)
    for (a, b), rank in list(pairs_.items())[::97]:
        slot = (a * factor + b * 31 + shifts[(a * 40_503 + b) % bpe_fold.GROUPS]) % bpe_fold.SLOTS
        assert entries[slot] == (a << bpe_fold.ID_BITS | b) << bpe_fold.ID_BITS | rank


def test_bpe_plan_holds_no_tables(make_docs):
    """Plans are kept as strings for every execution; the ranks once made up 8 MB of each."""
    docs = make_docs([(1, "some unheardof wordsmithery")])
    plan = bpe_fold.encode_decode(docs, RANKS, P.PATTERN)._jdf.queryExecution().toString()
    assert len(plan) < 200_000


def test_characters_that_newer_unicode_calls_letters(make_docs, coder):
    """Letters and digits are those of the library, also where the splitter's own classes differ."""
    odd = sorted(pretokens.stand_ins())[::40]
    rows = [(i, f"ab{chr(x)}cd 12{chr(x)}34 {chr(x)} é{chr(x)}") for i, x in enumerate(odd)] + [(-1, "plain")]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe_fold.encode_decode(make_docs(rows), RANKS, P.PATTERN).collect()}
    assert got == {i: coder.encode_ordinary(t) for i, t in rows}


@pytest.mark.parametrize("fold_bytes,block_bytes", [(256, 1 << 20), (4, 200)])
def test_encode_decode_on_odd_rows(make_docs, odd_rows, coder, fold_bytes, block_bytes):
    rows = [(i, t) for i, t in odd_rows if i != 6] + [(6, "naïve café ß 漢字 かな 한글 \U0001f600 ²³ ½   x\x85y  z")]
    got = bpe_fold.encode_decode(make_docs(rows), RANKS, P.PATTERN, fold_bytes=fold_bytes, block_bytes=block_bytes, bucket_bytes=2000).collect()
    want = [(i, coder.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert pairs((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == pairs(want)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_bpe_query(spark, coder):
    docs = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op4_bpe_fold"](spark, SMALL).collect():
        ids = np.array(coder.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_records_round_trip(make_docs, odd_rows, library, spark):
    folder = scratch_folder(spark, "records")
    manifest = token_records.write_records(make_docs(odd_rows).repartition(3), folder, JSON, P.PATTERN, end_id=0)
    got = token_records.read_records(spark, folder).orderBy("start").collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = [*ids_of(library, t), 0]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)
    shard = manifest.orderBy(F.desc("n_docs")).first()
    doc_id, ids = token_records.read_at(folder, shard.file, shard.n_docs - 1)
    assert [*ids_of(library, dict(odd_rows)[doc_id]), 0] == ids.tolist()


def test_damaged_records_are_found(make_docs, spark):
    folder = scratch_folder(spark, "records")
    manifest = token_records.write_records(make_docs([(1, "some words here")]), folder, JSON, P.PATTERN)
    store, base = token_records.open_store(folder)
    path = f"{base}/{manifest.first().file}.rec"
    data = bytearray(store.open_input_file(path).read())
    data[-6] ^= 1
    with store.open_output_stream(path) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        token_records.read_records(spark, folder).collect()


def test_checksums_are_masked():
    crc = zlib.crc32(b"abc")
    assert token_records.masked_checksum(b"abc") == ((((crc >> 15) | (crc << 17)) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def test_record_query(spark, library):
    docs = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got, start = QUERIES["op9_token_records"](spark, SMALL).orderBy("doc_id").collect(), 0
    assert len(got) == len(docs)
    for r in got:
        ids = np.array([*ids_of(library, docs[r.doc_id]), 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
