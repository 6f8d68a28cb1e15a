"""Prefix tries, packing and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from llm_fixtures import SMALL, make_docs, odd_rows  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelmill.llm import packing, periodic, prefix_trie
from voxelmill.llm.queries import ORACLES, QUERIES

VOCABULARY = P.path("word_bpe_49k.json")
TURN = "conv_id long, turn long, role string, text string, conv long, pos long, blk int, depth string"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# ---- prefix trie

def plain_trie(rows, every=20, kinds=4):
    """Rows of the query, from (conv_id, turn, role, text) without ties between different turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % kinds
        built[c] = tuple(own.get(c - c % every, [])[:h] + turns[h:])
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(words(node[-1][1])) if node else 0
    return sorted((
        min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, convs in members.items())


def spark_trie(spark, rows, width=8, every=20, kinds=4):
    df = spark.createDataFrame([(*r, 1, 1, 1, "x") for r in rows], TURN)
    trie = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.turn_ids(df), every, kinds), width)
    empty = hashlib.sha256(b"").hexdigest()
    nodes = trie.nodes.join(prefix_trie.ends_digest(trie), ["depth", "k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)))
    return sorted(map(tuple, nodes.collect()))


def test_trie_of_odd_conversations(spark):
    rows = [(None, 1, "user", "no conversation"), (-5, 0, "u", "minus")]
    rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t} {'x ' * (c % 2)}") for c in range(0, 60) for t in range(c % 6)]
    rows += [(100, None, "user", "first"), (100, 3, None, None), (100, 1, "user", ""), (105, 0, "a", "only")]  # a base of one turn
    rows += [(141, 0, "", "ab"), (142, 0, "a", "b"), (143, 0, None, "ab"), (144, 0, "", "x"), (144, 1, "", "x"), (144, 2, "", "x")]
    rows += [(161, t, "u", f"w{t // 3}") for t in range(300)] + [(162, t, "u", f"w{t // 3}") for t in range(280)]  # two slices
    rows += [(c, t, "u", f"t{t}") for c in range(1000, 1600) for t in range(3)]  # one shared conversation
    assert spark_trie(spark, rows) == plain_trie(rows)


def test_trie_of_narrow_blocks_and_repeated_rows(spark):
    random.seed(5)
    rows = [(c, t, "u", random.choice("ab")) for c in range(40) for t in range(random.randint(1, 9))]
    rows += [r for r in rows if r[0] < 9]  # repeated rows are turns of their own
    assert spark_trie(spark, rows, 3, kinds=1) == plain_trie(rows, kinds=1)


def test_trie_of_nothing(spark):
    assert spark_trie(spark, []) == []


def test_trie_query_equals_sql(spark, duck):
    got = sorted(map(tuple, QUERIES["op11_prefix_trie"](spark, SMALL).collect()))
    assert got == sorted(duck.execute(ORACLES["op11_prefix_trie"]).fetchall()) and len(got) > 50


# ---- packing

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def check_packing(rows, docs, library, capacity):
    """Every id lies in one piece, sequences have no gap, no room is left but beside powers of two."""
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append(np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        seqs[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length > 0
    for doc_id, all_ids in want.items():
        for size in {len(ids) for ids in all_ids}:
            same = [ids for ids in all_ids if len(ids) == size]
            got = sorted(pieces.pop((doc_id, size // 4)))
            assert sum(len(ids) for _, ids in got) == size * len(same)
            for start, ids in got:
                assert any(whole[4 * start : 4 * start + len(ids)] == ids for whole in same)
            if len(same) == 1:
                assert b"".join(ids for _, ids in got) == same[0]
    assert not pieces
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


def test_packing_of_odd_rows(make_docs, odd_rows, library):
    docs = odd_rows + [(30, "<|startoftext|>"), (31, "É È İ Ⱥ NFD é Ω ﬁ"), (32, "\x0b\x0c\x85\x1f "), (None, None), (33, "long " * 9_000)]
    df = make_docs(docs).selectExpr("*", "1 AS start", "2 AS ids", "3 AS offset")
    for group in (1, 256):
        rows = packing.pack_documents(df, VOCABULARY, end_id=1, capacity=256, group_windows=group).collect()
        check_packing(rows, docs, library, 256)
    assert packing.pack_documents(df.limit(0), VOCABULARY, end_id=1).collect() == []


def test_packing_query_covers_every_id(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = QUERIES["op12_packing"](spark, SMALL).collect()
    ids = {d: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in docs}
    found, seqs = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        found[r.doc_id] += r.length
        seqs[r.sequence_id] += r.length
    assert found == {d: len(i) for d, i in ids.items()}
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in seqs.values()) == 0 and max(seqs.values()) <= 2048


def test_words_equal_the_library(library):
    encoder = packing.WordEncoder(open(VOCABULARY, encoding="utf-8").read())
    assert encoder.by_word
    random.seed(1)
    letters = "aZé'stredvlm 09_!\n\tßɏİȺȾȿⱥ²×\x1c\x0b\x0c\x85\x1b~ǅ"
    for _ in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 20)))
        assert encoder.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_differencing_balances(spark):
    random.seed(3)
    sizes = np.array([random.randint(1, 2047) for _ in range(900)])
    for windows in (2, 7, 200):
        sums = np.bincount(packing.differencing(sizes, windows), sizes, windows)
        assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 0.1 * sizes.sum() / windows
    # Every set of few pieces: never worse than the largest piece apart from an equal share.
    for _ in range(200):
        few = np.array([random.randint(1, 50) for _ in range(random.randint(1, 8))])
        m = random.randint(1, 5)
        sums = np.bincount(packing.differencing(few, m), few, m)
        assert sums.sum() == few.sum() and sums.max() <= few.sum() / m + few.max()
    members = packing.balanced(np.array([60, 60, 60, 20]), 100)  # two windows would hold 100 each only if 60 + 60 fitted
    assert sorted(sorted(m) for m in members) == [[0], [1], [2, 3]] or max(sum([60, 60, 60, 20][k] for k in m) for m in members) <= 100


# ---- periodic runs

def plain_runs(items, least_length=6, least_periods=4):
    n, out = len(items), []
    for q in range(1, n // least_periods + 1):
        equal = np.array([items[i] == items[i + q] for i in range(n - q)], bool)
        edges = np.diff(np.concatenate([[0], equal.astype(np.int8), [0]]))
        for i, j in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist()):
            size = j - i + q
            part = items[i : i + size]
            if size >= max(least_length, least_periods * q) and not any(part[r:] == part[: size - r] for r in range(1, q)):
                out.append((i, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_items(most=70):
    n, kinds = random.randint(1, most), random.choice([1, 2, 2, 3, 6])
    items = [random.randint(1, kinds) for _ in range(n)]
    if random.random() < 0.6:
        a, p = random.randrange(n), random.randint(1, 9)
        for i in range(a + p, n):
            items[i] = items[i - p]
    return items


def test_runs_of_small_sequences():
    random.seed(2)
    for _ in range(1500):
        items = random_items()
        assert periodic.runs_of(np.array(items), 6, 4) == plain_runs(items)


def test_extensions_equal_comparison():
    random.seed(4)
    for _ in range(100):
        items = random_items(40)
        tree = periodic.Extensions([*items, 0])
        assert np.argsort(tree.rank).tolist() == sorted(range(len(items) + 1), key=lambda i: [*items, 0][i:])
        pairs = [(i, j) for i in range(len(items)) for j in range(i + 1, len(items))]
        for (i, j), got in zip(pairs, tree.common(*np.array(pairs).T) if pairs else []):
            k = 0
            while j + k < len(items) and items[i + k] == items[j + k]:
                k += 1
            assert got == k


def check_runs(rows, docs, change=lambda i, w: w):
    left = defaultdict(list)
    for r in rows:
        left[r.doc_id].append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    for doc_id, text in docs:
        items = change(doc_id, words(text))
        runs = plain_runs(items)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        left[doc_id].remove((len(items), runs, " ".join(w for i, w in enumerate(items) if i not in drop)))
    assert not any(left.values())


def test_runs_of_odd_rows(make_docs, odd_rows):
    random.seed(6)
    docs = [d for d in odd_rows if len(words(d[1])) < 5000] + [(20, "a b " * 3), (21, "a b " * 4), (22, "a " * 5), (23, "a " * 6), (24, "x a b c a b c a b c a b c a b y")]
    docs += [(100 + k, " ".join(map(str, random_items(200)))) for k in range(60)]
    df = make_docs(docs).selectExpr("*", "1 AS runs", "2 AS collapsed")
    check_runs(periodic.periodic_runs(df).collect(), docs)
    (long,) = periodic.periodic_runs(make_docs([d for d in odd_rows if d[0] == 8])).collect()
    assert [tuple(x) for x in long.runs] == [(0, 40_000, 1)] and long.collapsed == "word"
    assert periodic.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, least_periods=2)


def test_runs_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    met = 0
    for doc_id, text in docs:
        items = words(text)
        n, h = len(items), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            items = [items[i] if i < a else items[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs, r = plain_runs(items), got[doc_id]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == ((len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None))
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(items) if i not in drop).encode()).hexdigest()
        met += len(runs)
    assert met > 5


def test_planted_period_of_odd_rows(make_docs):
    docs = [(None, "a b"), *[(i, t) for i in range(60) for t in (None, "", " \t", "x", " a\x0bb  c d ")]]
    for r in make_docs(docs).select("doc_id", "text", periodic.planted_period(F.col("doc_id"), F.col("text")).alias("new")).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        items = words(r.text)
        if r.doc_id is not None and h % 10 == 0 and items:
            n = len(items)
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            items = [items[i] if i < a else items[a + (i - a) % p] for i in range(n)]
        assert words(r.new) == items
