"""Url rules, language models, nearest vectors, toxicity and the pipeline."""

import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
from llm_fixtures import SMALL, make_docs, odd_rows  # noqa: F401
from pyspark.sql import functions as F
from test_dedup import LOWER, WORD

import corpus_pipeline
from voxelmill.llm import lm_scores, nearest_vectors, toxicity, url_rules
from voxelmill.llm.queries import ORACLES, QUERIES, URL_RULES


def judge(url, rules):
    """Host, path, rule and verdict of one url, by trying every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [(len(p.removeprefix("||")), v, r) for r, p, v in rules
            for h, q in [p.removeprefix("||").split("/", 1)] if ("." + host).endswith("." + h) and path.startswith("/" + q)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


def test_url_rules_equal_trying_all_of_them(spark):
    hosts = ["example.org", "a.example.org", "badexample.org", "x.com", "COM", "org", "Sub.Org", "é.org", "example.net", "org:80", ""]
    paths = ["", "/", "/es", "/es/", "/es/a", "/en/1", "/en/12?q=/es/", "/en/2#x", "/fr/", "/fr", "/de/x", "/ES/", "/a//de/", "/de/\nx"]
    urls = [s + h + p for s in ("http://", "https://u@", "", "a://b://") for h in hosts for p in paths] + [None, "", "://", "http:/x", "http://a.com/de/"]
    rows = [(k, u, 1) for k, u in enumerate(urls)] + [(7, urls[7], 1), (None, "http://a.org/", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int").selectExpr("*", "1 AS token", "2 AS verdict", "3 AS rule")
    got = url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((k, *judge(u, URL_RULES)) for k, u, _ in rows), key=repr)


def test_url_wildcards(spark):
    rules = [("ads", "/ads/*.js^", "block"), ("any", "*track*", "block"), ("exact", "||shop.com/ads/ok.js", "allow"), ("dot", "a.b+c", "block")]
    urls = {"http://x.com/ads/q.js": "ads", "http://x.com/ads/q.json": None, "http://x.com/ads/q.js?z": "ads", "http://t.com/mytracker": "any", "http://shop.com/ads/ok.js": "exact", "http://x.com/a.b+c": "dot", "http://x.com/aXb+c": None}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()}
    assert [got[k] for k in range(len(urls))] == list(urls.values())
    assert url_rules.literal_tokens("/ads/*.js^") == ["ads", "js"] and url_rules.literal_tokens("*track*") == []


def test_url_rules_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = url_rules.rule_table(spark, [])
    assert [tuple(r) for r in url_rules.judge_urls(pages, none).collect()] == [(1, "a.org", "/", None, "allow")]
    assert url_rules.judge_urls(pages.limit(0), none).count() == 0


def test_url_query_equals_sql(spark, duck):
    got = sorted((tuple(r) for r in QUERIES["op2_url_rules"](spark, SMALL).collect()), key=repr)
    assert got == sorted((tuple(r) for r in duck.execute(ORACLES["op2_url_rules"]).fetchall()), key=repr)


def lm_by_hand(rows, good, weight=10.0, floor=0.5):
    texts = [(i, [*WORD.findall((t or "").translate(LOWER)), None] if WORD.findall(t or "") else []) for i, t in rows]
    counts, sizes = [collections.Counter(), collections.Counter()], [0, 0]
    for i, s in texts:
        for m in (0, 1) if i in good else (1,):
            sizes[m] += len(s)
            for v, w in zip([None, *s], s):
                counts[m][w] += 1
                counts[m][v, w] += 1
    vocabulary = sum(not isinstance(k, tuple) for k in counts[1])
    out = []
    for i, s in texts:
        loss = []
        for m, scale in ((0, 1.0), (1, sizes[0] / sizes[1] if sizes[1] else 0)):
            c = lambda k: counts[m][k] * scale  # noqa: B023, E731
            p = lambda w: (c(w) + floor) / (sizes[0] + floor * vocabulary)  # noqa: B023, E731
            loss.append(sum(math.log((c(v) + weight) / (c((v, w)) + weight * p(w))) for v, w in zip([None, *s], s)) / max(len(s), 1))
        out.append((i, len(s), *(loss if s else (None, None))))
    return sorted(out, key=repr)


def test_language_models_equal_counting_by_hand(make_docs, odd_rows, spark):
    rng = random.Random(3)
    rows = odd_rows + [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 40)))) for k in range(50, 90)]
    good = {1, 5, 6, *range(50, 60), 999}
    ids = spark.createDataFrame([(i,) for i in [*good, 1, None]], "any_name long")
    for block_bytes in (1 << 20, 200):
        got = lm_scores.lm_scores(make_docs(rows), ids, block_bytes=block_bytes, bucket_bytes=1000).collect()
        for r, w in zip(sorted(got, key=lambda r: repr((r.doc_id, r.n_tokens))), sorted(lm_by_hand(rows, good), key=lambda w: repr(w[:2])), strict=True):
            assert (r.doc_id, r.n_tokens) == w[:2] and (r.score is None) == (w[2] is None)
            if r.score is not None:
                assert np.allclose([r.target_loss, r.background_loss, r.score], [w[2], w[3], w[2] - w[3]])


def test_language_models_of_nothing(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_scores.lm_scores(make_docs([]), none).count() == 0
    assert [tuple(r) for r in lm_scores.lm_scores(make_docs([(1, None)]), none).collect()] == [(1, 0, None, None, None)]
    assert lm_scores.lm_scores(make_docs([(1, "a b")]), none).first().score == 0


def test_language_model_prefers_its_target(spark):
    got = QUERIES["op5_lm_scores"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    mean = {r.quality: r.m for r in got.groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert mean[1] < mean[0]


def vectors_by_hand(rows, k=20):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            sound[i] = min(sound.get(i, v), v)
    size = collections.Counter(map(len, sound.values())).most_common(1)[0][0] if sound else 0
    sound = {i: np.array(v, np.float32).astype(float) for i, v in sound.items() if len(v) == size}
    out = []
    for q, v in sound.items():
        if q % 20 == 0:
            best = sorted(((-(w * v).sum(), i) for i, w in sound.items() if i != q))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_nearest_vectors_on_odd_rows(spark):
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(-40, 90)]
    rows += [(200, None), (220, []), (240, [0.0] * 5), (260, [1.0, None, 1.0, 1.0, 1.0]), (280, [float("nan")] * 5), (300, [float("inf")] * 5), (None, [1.0] * 5), (320, [1.0] * 4), (340, rows[3][1]), (360, rows[3][1]), (360, rows[4][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS block", "3 AS rank")
    got = sorted(tuple(r) for r in nearest_vectors.nearest_vectors(table).collect())
    want = vectors_by_hand(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    few = table.filter("vec_id between 0 and 4")
    assert [r.rank for r in nearest_vectors.nearest_vectors(few).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert nearest_vectors.nearest_vectors(table.limit(0)).count() == 0


def test_nearest_vectors_recall_over_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 32)) * rng.uniform(0.5, 2, (6000, 1))
    x[3000:] = x[:3000] + 0.3 * rng.standard_normal((3000, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest_vectors.nearest_vectors(table, block_rows=2000).collect()
    want = {(q, i) for q, _, i, _ in vectors_by_hand([(i, v.tolist()) for i, v in enumerate(x)])}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)
    true = x.astype(np.float32).astype(float)
    assert all(abs(true[r.query_id] @ true[r.vec_id] - r.score) < 1e-9 for r in got[:500])


def test_nearest_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i, _ in vectors_by_hand(rows)}
    got = {(r.query_id, r.vec_id) for r in QUERIES["op8_nearest_vectors"](spark, "/root/testdata/sf0.01").collect()}
    assert len(want & got) >= 0.9 * len(want) and len(got) == len(want)


def test_block_max_search_equals_full_search():
    rng = np.random.default_rng(5)
    weights = rng.random((500, 30)) * (rng.random((500, 30)) < 0.1)
    weights = (weights[weights.any(1)] / np.linalg.norm(weights[weights.any(1)], axis=1)[:, None])
    weights[50:80] = weights[0]
    ids, labels = rng.permutation(len(weights)).astype(np.int64), rng.random(len(weights)) < 0.5
    index = toxicity.BlockMaxIndex(weights, ids, labels.astype(float))
    for i in range(0, len(weights), 7):
        terms = np.flatnonzero(weights[i])
        score, place = index.nearest(terms, weights[i, terms], 15, without=int(ids[i]))
        full = np.round(weights @ weights[i], 12)
        want = [j for j in np.lexsort((ids, -full)) if ids[j] != ids[i] and full[j] > 0][:15]
        assert index.ids[place].tolist() == ids[want].tolist() and np.allclose(score, full[want])


def test_block_max_index_with_rare_terms():
    rng = np.random.default_rng(6)
    full = rng.random((300, 400)).astype(np.float32) * (rng.random((300, 400)) < 0.1)
    full /= np.linalg.norm(full, axis=1)[:, None]
    row, term = np.nonzero(full)
    ids = rng.permutation(300).astype(np.int64)
    index = toxicity.BlockMaxIndex(full[:, :20], ids, np.ones(300), (row, term, full[row, term]))
    for i in range(0, 300, 7):
        terms = np.flatnonzero(full[i])
        score, place = index.nearest(terms, full[i, terms], 15)
        by_id = dict(zip(ids.tolist(), full @ full[i]))
        assert np.allclose(score, [by_id[j] for j in index.ids[place].tolist()], atol=2e-6)
        assert np.allclose(score, sorted(by_id.values(), reverse=True)[:15], atol=2e-6)


def test_block_max_index_takes_little_memory_to_build():
    rng = np.random.default_rng(7)
    size = 1 << 21
    term = rng.integers(0, 50_000, size).astype(np.int32)
    row = np.repeat(np.arange(size // 256, dtype=np.int32), 256)
    weight, table = np.ones(size, np.float32), np.zeros((size // 256, 8), np.float32)
    tracemalloc.start()
    try:
        index = toxicity.BlockMaxIndex(table, np.arange(size // 256), np.ones(size // 256), (row, term, weight))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert index.cuts[-1] == np.count_nonzero(term >= 8)
    assert peak <= 3 * 8 * size  # a posting takes 8 bytes


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_made_texts(make_docs, spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    bad = ["vilest", "scoundrel", "gruesome"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else " ".join(text)))
        labels.append((i, int(toxic)))
    odd = [(1000, None), (1001, ""), (1002, "1234 !!"), (None, "vilest scoundrel"), (1003, "vilest " * 50_000), (3, rows[3][1])]
    table = spark.createDataFrame([*labels, (0, 0), (7, None), (None, 1), (5000, 1)], "doc_id long, toxic int").selectExpr("*", "1 AS quality", "'x' AS text")
    got = toxicity.toxicity_scores(make_docs(rows + odd), table).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == held_out(r.doc_id) for r in got if r.doc_id is not None) and not by_id[None].held_out
    assert all(by_id[i].predicted == t for i, t in labels if held_out(i))
    assert by_id[None].predicted == by_id[1003].predicted == 1
    assert by_id[1000].score == by_id[1001].score == by_id[1002].score < 0.5 and by_id[1000].evidence == []
    assert not any(held_out(e.doc_id) for r in got for e in r.evidence)
    assert by_id[1003].evidence[0].label == 1


def test_copies_of_examples_with_rare_words_are_neighbours(make_docs, spark):
    """No word here goes with the label often enough to be chosen by it."""
    lead = "one two three four five six seven eight"
    rows = [(i, f"{lead} only{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]} {'klmnopqrst'[i // 100]}{'uvwxyzabcd'[i % 10]}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400)], "doc_id long, toxic int")
    copies = [(5000 + i, t) for i, t in rows if not held_out(i)]
    got = {r.doc_id: r for r in toxicity.toxicity_scores(make_docs(rows + copies), labels).collect()}
    for i, _ in copies:
        first = got[i].evidence[0]
        assert (first.doc_id, first.label) == (i - 5000, int((i - 5000) % 8 == 0)) and abs(first.cosine - 1) < 1e-5


def test_labels_of_held_out_rows_change_nothing(make_docs, spark):
    rows = [(i, f"common words here {'nasty' if i % 3 == 0 else 'fine'} {i}") for i in range(120)]
    plain = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    turned = plain.withColumn("toxic", F.when(toxicity.in_fifth(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(tuple(r)[:4] for r in toxicity.toxicity_scores(make_docs(rows), x).collect()) for x in (plain, turned))
    assert a == b


def test_toxicity_without_examples(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.toxicity_scores(make_docs([(1, "a b")]), none).collect()] == [(0.0, 0)]
    assert toxicity.toxicity_scores(make_docs([]), none).count() == 0
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity_scores(make_docs([(i, f"w{i} a") for i in range(20)]), ones).collect()} == {1}


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "toxic").toPandas()
    one, zero = got.score[got.toxic == 1].values, got.score[got.toxic == 0].values
    assert (one[:, None] > zero).mean() + 0.5 * (one[:, None] == zero).mean() > 0.9
    assert (zero >= 0.5).mean() < 0.02


def test_stages_keep_the_columns_and_run_on_odd_tables(spark, odd_rows, make_docs, tmp_path):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    for docs in (documents.limit(0), make_docs(odd_rows, clash=False)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            out.write.parquet(f"{tmp_path}/{columns[0]}{k}-{docs.count()}", mode="overwrite")
            if k < 4:
                assert out.columns == columns
                docs = spark.createDataFrame(out.collect(), docs.schema)


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """Each stage's rows from the plain rule, given the operator's decision or a full comparison."""
    from test_dedup import components, cut_by_hand

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scores = {r.doc_id: r.predicted for r in QUERIES["op10_toxicity"](spark, SMALL).collect()}
    clean = [r for r in docs.collect() if not scores[r.doc_id]]
    assert sorted(stages["toxicity"](spark, docs, SMALL).collect()) == sorted(clean)
    near = {c[0] for c in components([(r.doc_id, r.text) for r in clean], 5, 80) if c[3]}
    left = [r for r in clean if r.doc_id in near]
    step = spark.createDataFrame(clean, docs.schema)
    assert sorted(stages["near_dedup"](spark, step, SMALL).collect()) == sorted(left)
    step = spark.createDataFrame(left, docs.schema)
    cut = {r.doc_id: r for r in stages["suffix_array_dedup"](spark, step, SMALL).collect()}
    for i, n, gone, _, _, kept in cut_by_hand([(r.doc_id, r.text) for r in left], 50):
        assert cut[i].n_chars == len(cut[i].text) if gone else cut[i].text.encode() == kept
        assert 0 <= len(cut[i].text.encode()) - len(kept) <= 6 * max(gone, 1)
    step = spark.createDataFrame(list(cut.values()), docs.schema)
    found = {r.doc_id for r in stages["decontamination"](spark, step, SMALL).collect()}
    items = [" ".join(re.findall(r"[a-z\x80-\U0010ffff]+", r.text.lower())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = {i: " ".join(re.findall(r"[a-z\x80-\U0010ffff]+", r.text.lower())) for i, r in cut.items()}
    assert found <= {i for i, t in words.items() if not any(x in t for x in items)}
    final = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in final} == found
