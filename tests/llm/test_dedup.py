"""Near copies, repeated strings and benchmark items against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import SMALL, make_docs, odd_rows  # noqa: F401

from voxelmill.llm import anchors, decontaminate, near_dedup, repeated_spans, wordhash
from voxelmill.llm.components import connected_components
from voxelmill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def components(rows, size, percent):
    """{(id, text): (set size, component, kept)} by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=repr)


def variants(seed=5, groups=6, copies=9):
    """Groups of texts with ever more changed words, exact copies and short texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 1 + c // 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 - 10 * g - c, " ".join(text)))
    return rows + [(1, "a b"), (2, "A  B"), (3, "a"), (4, "A"), (5, "\tb\n")]


def test_near_duplicates_equal_all_pairs(make_docs, odd_rows):
    rows = variants() + [(i and i + 2000, t) for i, t in odd_rows]
    for size, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(make_docs(rows), size=size, percent=percent).collect()
        assert sorted((tuple(r) for r in got), key=repr) == components(rows, size, percent)


def test_near_duplicates_in_small_tiles(make_docs, spark, monkeypatch):
    """A family larger than a tile is compared in pairs of tiles, with the same result."""
    rows = variants(seed=8, groups=2, copies=25)
    plain = near_dedup.verified_edges
    monkeypatch.setattr(near_dedup, "verified_edges", lambda d, f, size, percent: plain(d, f, size, percent, tile_shingles=300, tile_sets=4))
    got = near_dedup.near_duplicates(make_docs(rows), size=3, percent=85).collect()
    assert sorted((tuple(r) for r in got), key=repr) == components(rows, 3, 85)


def test_rows_of_one_id_share_a_component(make_docs):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    got = near_dedup.near_duplicates(make_docs([(7, a), (7, b), (3, b), (9, a)]), size=3, percent=85).collect()
    assert {r.component_id for r in got} == {3} and sum(r.kept for r in got) == 1


def test_near_duplicates_of_nothing(make_docs):
    assert near_dedup.near_duplicates(make_docs([])).count() == 0


def test_near_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op6_near_dedup"](spark, SMALL).collect()
    assert sorted((tuple(r) for r in got), key=repr) == components([tuple(r) for r in rows], 3, 85)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (201, 200), (200, 202), (202, 201)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_band_hashes_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.sort(base[:800]), np.sort(base[100:])
    bands = near_dedup.band_hashes(np.concatenate([a, b]), np.array([0, 800, 1600]), 200, 1)
    assert abs((bands[0] == bands[1]).mean() - 700 / 900) < 0.06


def cut_by_hand(rows, length):
    """{...}: bytes covered by a string that also starts in a document with a smaller id."""
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        if i is not None:
            seen = {d[k : k + length] for j, u in rows if j is not None and j < i for d in [(u or "").encode()] for k in range(len(d) - length + 1)}
            for k in range(len(data) - length + 1):
                if data[k : k + length] in seen:
                    gone[k : k + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(data), sum(gone), [a for a, _ in spans], [b for _, b in spans], bytes(c for c, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def repeats(seed):
    rng = random.Random(seed)
    letters = "abcdé "
    parts = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 90))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(parts) + rng.choice(["", "x", "yz"]) for _ in range(rng.randint(0, 6)))) for k in rng.sample(range(100), 30)]
    return rows + [(200, "ab" * 300), (201, "ab" * 150), (150, "b" + "ab" * 40), (202, "q" * 50), (203, "q" * 49), (204, "q" * 51)]


@pytest.mark.parametrize("seed,block_bytes,bucket_bytes", [(1, 1 << 20, 1 << 20), (2, 300, 500), (3, 60, 200)])
def test_repeated_spans_equal_brute_force(make_docs, odd_rows, seed, block_bytes, bucket_bytes):
    rows = repeats(seed) + [(i and i + 300, t[:2000] if t else t) for i, t in odd_rows]
    got = repeated_spans.repeated_spans(make_docs(rows), length=50, gram=24, block_bytes=block_bytes, bucket_bytes=bucket_bytes).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.span_starts, r.span_stops, bytes(r.kept)) for r in got), key=repr) == cut_by_hand(rows, 50)


def test_repeated_spans_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, m, len(a), hashlib.sha256(k).hexdigest()) for i, n, m, a, _, k in cut_by_hand(rows, 50)]
    assert sorted((tuple(r) for r in QUERIES["op3_repeated_spans"](spark, SMALL).collect()), key=repr) == sorted(want, key=repr)


def test_repeated_spans_of_nothing(make_docs):
    assert repeated_spans.repeated_spans(make_docs([])).count() == 0


def test_long_texts_are_ranked_in_overlapping_parts(monkeypatch):
    data = np.frombuffer(random.Random(4).randbytes(3000), np.uint8)
    offsets = np.array([0, 2500, 3000])
    whole = anchors.window_groups(data, offsets, 50, 24)
    monkeypatch.setattr(anchors, "PLACE_BITS", 10)
    for part, other in zip(anchors.window_groups(data, offsets, 50, 24), whole):
        assert len(part) >= len(other)
    start, count, _ = anchors.window_groups(data, offsets, 50, 24)
    assert sorted(k for s, n in zip(start, count) for k in range(s, s + n)) == [*range(2451), *range(2500, 2951)]


def test_spans_are_cut_at_whole_characters(make_docs):
    text = "é" * 60
    cut = repeated_spans.cut_spans(text.encode(), [1, 50], [5, 53])
    assert cut == "é" * 58
    docs = make_docs([(1, "a" * 60 + "b"), (2, "c" + "a" * 60), (None, "a" * 60), (3, None), (2, "other")])
    out = {(r.doc_id, r.text, r.n_chars) for r in repeated_spans.without_spans(docs, repeated_spans.repeated_spans(docs)).collect()}
    assert out == {(1, "a" * 60 + "b", 61), (2, "c", 1), (None, "a" * 60, 60), (3, None, 0), (2, "other", 5)}


def test_word_hashes_tell_words_apart():
    texts = ["one Two", "two one", "", "one  two\n", "o ne two", "one"]
    words = wordhash.Words(*wordhash.bytes_of(pa.array(texts)))
    rows = [words.hash[words.first[k] : words.first[k + 1]].tolist() for k in range(len(texts))]
    assert rows[0] == rows[3] == rows[1][::-1] and len(rows[4]) == 3 and rows[5] == rows[0][:1] and rows[2] == []


def best_alignment(item, text):
    """Score of the best local alignment by the textbook table."""
    table = np.zeros((len(item) + 1, len(text) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if a == b else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    return table.max()


def test_alignment_equals_the_table():
    rng = random.Random(9)
    for _ in range(200):
        item, text = ([rng.randrange(6) for _ in range(rng.randint(1, n))] for n in (12, 30))
        score, first, last = decontaminate.align(np.array(item), np.array(text))
        assert score == best_alignment(item, text)
        if score:
            assert 0 <= first <= last < len(text) and best_alignment(item, text[first : last + 1]) == score


def test_items_and_edited_copies_are_found(make_docs, spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(6)] + [(50, "lone Word"), (51, ""), (52, None), (53, "12 34")]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def edited(text, share):
        parts = text.split()
        for k in rng.sample(range(len(parts)), int(share * len(parts))):
            parts[k] = rng.choice(["changed", "", "two more"])
        return " ".join(parts)

    docs = [(k, filler(80)) for k in range(20)]
    docs += [(100, filler(50) + " " + items[0][1].upper() + "! " + filler(50)), (101, items[1][1]), (102, filler(20) + edited(items[2][1], 0.1) + filler(9)),
             (103, edited(items[3][1], 0.2)), (104, items[4][1] + ". " + filler(300) + ", " + items[5][1]), (105, "a lone word here"), (106, None), (107, ""), (None, items[0][1]),
             (108, items[0][1][: len(items[0][1]) // 4] + " " + filler(40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slice_seeds in (200_000, 20):
        found = decontaminate.find_items(make_docs(docs), bench, slice_seeds=slice_seeds).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(100, 0), (101, 1), (102, 2), (103, 3), (104, 4), (104, 5), (105, 50), (None, 0)}
        exact = {(r.doc_id, r.item_id): r for r in found}[(100, 0)]
        assert exact.score == 1 and dict(docs)[100].lower()[exact.first_byte : exact.last_byte] == items[0][1]
    left = decontaminate.without_items(make_docs(docs), decontaminate.find_items(make_docs(docs), bench))
    assert {r.doc_id for r in left.collect()} == {*range(20), 106, 107, 108, None}


@pytest.mark.parametrize("every, clean", [(4, False), (5, False), (6, False), (8, False), (4, True), (8, True)])
def test_evenly_edited_copies_are_found(make_docs, spark, every, clean):
    """With and without a clean copy elsewhere, against full alignment of all documents."""
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklm" for c in "nopqr"]
    rng = random.Random(every)
    items = {k: rng.sample(words, 32) for k in range(4)}
    copy = lambda k, first: [f"zz{'abcdefgh'[j // every % 8]}{'abcdefgh'[k]}" if j % every == first else w for j, w in enumerate(items[k])]
    docs = {k: rng.sample(words, 40) for k in range(12)}
    docs |= {100 + 10 * k + first: rng.sample(words, 15) + copy(k, first) + rng.sample(words, 15) for k in items for first in ((every - 1,) if k % 2 else range(every))}
    docs |= {200 + k: items[k] for k in items if clean}
    number = {w: i for i, w in enumerate(sorted({w for t in [*items.values(), *docs.values()] for w in t}))}
    coded = lambda t: [number[w] for w in t]
    want = {(i, k): best_alignment(coded(x), coded(t)) / (2 * len(x)) for i, t in docs.items() for k, x in items.items()}
    want = {pair: score for pair, score in want.items() if score >= 0.5}
    assert len(want) == len(docs) - 12
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    found = decontaminate.find_items(make_docs([(i, " ".join(t)) for i, t in docs.items()]), bench).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == want


def test_common_items_are_found_in_all_their_documents(make_docs, spark):
    docs = [(k, f"start{k} the very common passage of all these many documents end{k}") for k in range(60)]
    bench = spark.createDataFrame([(1, "the very common passage of all these many documents")], "item_id long, text string")
    assert decontaminate.find_items(make_docs(docs), bench).count() == 60


def test_items_of_nothing(make_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(make_docs([]), none).count() == 0
    assert decontaminate.find_items(make_docs([(1, "a b c")]), none).count() == 0
    assert decontaminate.find_items(make_docs([]), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0


def test_item_query(spark):
    docs = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    items = dict(spark.read.parquet(f"{SMALL}/benchmark.parquet").collect())
    words = lambda t: " " + " ".join(re.findall(r"[a-z\x80-\U0010ffff]+", t.lower())) + " "
    want = {(i, k) for i, t in docs.items() for k, x in items.items() if words(x) in words(t)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, SMALL).collect()}
    assert want and want <= got and len(got) <= 1.2 * len(want) + 1
