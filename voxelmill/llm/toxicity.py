"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are all words of the examples, and word beginnings whose presence goes with the label among
them; how closely a term goes with the label is a factor of its weight and leaves no word out. The
examples, at most ``max_examples`` labelled rows, form an inverted index: postings of the rarer terms,
and a table of the commonest in blocks, where the largest weight of each term in a block bounds the
cosine of all its examples, so that blocks which cannot hold a nearest example are passed over. Votes weighted by cosine are calibrated on the examples,
each scored without itself, by tasks. Texts are scored in groups, which meet a block of examples at
once. Document frequencies are counted over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import blocks_for, id_text, materialize
from voxelmill.llm.wordhash import U, Words, byte_chunks, bytes_of, distinct_by_row, mix

PREFIXES = (4, 5, 6, 7, 8)
BLOCK = 64
COMMON = 512  # terms in the table at most
FLOOR = 0.02  # factor of a term that does not go with the label
LOOKUP_BITS = 20
GROUP = 1 << 20  # postings and (text, example) cells that a task scores at once, or one text
SLICE = 1 << 17  # postings that are put in place at once


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all terms of the texts, repeated as often as they occur; whole words first."""
    words = Words(*bytes_of(column), letters_only=True, prefixes=PREFIXES)
    size = words.end - words.start
    hashes, rows = [words.hash], [words.row]
    for k, prefix in words.prefixes:
        longer = size > k
        hashes.append(prefix[longer])
        rows.append(words.row[longer])
    return np.concatenate(hashes), np.concatenate(rows)


@dataclass
class Terms:
    """The known terms, sorted by hash, with a table that rejects most others at once."""

    hashes: np.ndarray

    def __post_init__(self):
        self.table = np.zeros(1 << LOOKUP_BITS, bool)
        self.table[(self.hashes >> U(64 - LOOKUP_BITS)).astype(np.int64)] = True

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the known terms in the texts, by row and term."""
        hashes, rows = term_hashes(column)
        may = self.table[(hashes >> U(64 - LOOKUP_BITS)).astype(np.int64)]
        hashes, rows = hashes[may], rows[may]
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        hit = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        key, count = np.unique(rows[hit] * max(len(self.hashes), 1) + place[hit], return_counts=True)
        return key // max(len(self.hashes), 1), key % max(len(self.hashes), 1), count


def vectors(count: np.ndarray, term: np.ndarray, row: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """TF-IDF weights of unit length for each row."""
    weight = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(row, weight * weight, rows))
    return weight / norm[row]


class BlockMaxIndex:
    """Exact nearest examples by cosine. ``weights``: a row for each example, a column for each of the
    first terms. ``rare``: (example, term, weight) of the terms that follow; those of the first terms are
    skipped. Together a row has unit length."""

    def __init__(self, weights: np.ndarray, ids: np.ndarray, labels: np.ndarray, rare: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        top = weights.argmax(1) if weights.size else np.zeros(len(ids), np.int64)
        order = np.lexsort((ids, weights.max(1, initial=0), top))  # like examples share blocks
        self.weights, self.ids, self.labels = weights[order], ids[order], labels[order]
        self.starts = np.arange(0, len(ids), BLOCK)
        self.most = np.maximum.reduceat(self.weights, self.starts, axis=0) if len(ids) else np.zeros((0, weights.shape[1]), weights.dtype)
        self.digits = 12 if weights.dtype == np.float64 else 6
        example, term, weight = rare if rare else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids))
        # (term, block) pairs would be nearly as many as postings, so rare terms are added up exactly
        width = weights.shape[1]
        self.cuts = np.append(0, np.cumsum(np.bincount(term, minlength=width)[width:]))
        self.example, self.weight = np.empty(self.cuts[-1], np.int32), np.empty(self.cuts[-1], weight.dtype)
        # Slice by slice: to sort all postings at once takes several times their memory.
        free = self.cuts[:-1].copy()
        for start in range(0, len(term), SLICE):
            span = slice(start, start + SLICE)
            own = term[span] - width
            by_term = np.argsort(own, kind="stable")[np.count_nonzero(own < 0) :]
            own = own[by_term]
            begin, end = runs_of(own)
            at = np.repeat(free[own[begin]] - begin, end - begin) + np.arange(len(own))
            self.example[at], self.weight[at] = place[example[span][by_term]], weight[span][by_term]
            free[own[begin]] += end - begin

    def postings(self, terms: np.ndarray) -> np.ndarray:
        """Number of postings of each term, 0 for the terms of the table."""
        own = np.maximum(terms - self.weights.shape[1], -1)
        return np.where(own < 0, 0, self.cuts[own + 1] - self.cuts[np.maximum(own, 0)])

    def rare_scores(self, row: np.ndarray, terms: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
        """What the postings give to the cosine of every text with every example, as [text, block, example]."""
        own = terms - self.weights.shape[1]
        start, size = self.cuts[own], self.cuts[own + 1] - self.cuts[own]
        at = np.repeat(start - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        width = len(self.starts) * BLOCK
        weight = np.repeat(weights, size)
        weight *= self.weight[at]
        target = self.example[at]
        del at
        target = np.repeat(row * width, size) + target
        return np.bincount(target, weight, rows * width).astype(np.float64, copy=False).reshape(rows, -1, BLOCK)

    def nearest_of_all(self, row, terms, weights, rows: int, k: int, without: np.ndarray | None = None):
        """(text, cosine, place) of the ``k`` nearest examples with a cosine above 0 of each of ``rows``
        texts, nearest first, ties to smaller ids; for each text without the examples of the id ``without``.

        All texts meet a block at once. Some blocks with the largest bounds are scored for each text; of
        the others those whose bound reaches the k-th best cosine of these.
        """
        if not len(self.ids) or not rows:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        common = terms < self.weights.shape[1]
        scores = self.rare_scores(row[~common], terms[~common], weights[~common], rows)
        full = np.zeros((rows, self.weights.shape[1]), self.weights.dtype)
        full[row[common], terms[common]] = weights[common]
        bounds = scores.max(2) + full @ self.most.T
        first = min(max(4, -(-2 * k // BLOCK)), len(self.starts))
        best = np.argpartition(-bounds, first - 1, axis=1)[:, :first]
        todo = np.zeros(bounds.shape, bool)
        np.put_along_axis(todo, best, True, axis=1)
        self.finish(scores, full, todo, without)
        seen = scores[np.arange(rows)[:, None], best].reshape(rows, -1)  # those of the first blocks
        worst = np.partition(seen, -k, axis=1)[:, -k] if k <= seen.shape[1] else np.zeros(rows)
        self.finish(scores, full, ~todo & (bounds > 0) & (bounds >= worst[:, None] - 10.0**-self.digits), without)
        # A block that was passed over holds nothing as near as the k-th.
        if k <= scores[0].size:
            worst = np.partition(scores.reshape(rows, -1), -k, axis=1)[:, -k]
        cell = np.flatnonzero(scores >= np.maximum(worst, 0.5 * 10.0**-self.digits)[:, None, None])
        text, place = np.divmod(cell, len(self.starts) * BLOCK)
        score = scores.reshape(-1)[cell]
        order = np.lexsort((self.ids[place], -score, text))
        text, score, place = text[order], score[order], place[order]
        keep = np.arange(len(text)) - np.searchsorted(text, text) < k
        return text[keep], score[keep], place[keep]

    def finish(self, scores: np.ndarray, full: np.ndarray, todo: np.ndarray, without: np.ndarray | None) -> None:
        """Add the common terms to the cosines of the chosen blocks and texts."""
        for block in np.flatnonzero(todo.any(0)):
            texts, span = np.flatnonzero(todo[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
            table, ids = self.weights[span], self.ids[span]
            score = np.round(scores[texts, block, : len(ids)] + full[texts] @ table.T, self.digits)
            if without is not None:
                score[ids[None, :] == without[texts, None]] = 0
            scores[texts, block, : len(ids)] = score

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, places) of the ``k`` nearest examples of one text."""
        excluded = None if without is None else np.array([without])
        return self.nearest_of_all(np.zeros(len(terms), np.int64), terms, weights, 1, k, excluded)[1:]


def votes(index: BlockMaxIndex, row, terms, weights, rows: int, k: int, prior: float, without: np.ndarray | None = None):
    """Weighted share of label 1 among the nearest examples of each text, drawn to the prior by one
    vote, and the neighbours: (share, text, cosine, place)."""
    found = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
    # Texts go through in groups with a bounded number of (text, example) cells and postings.
    cost = np.bincount(row, index.postings(terms), rows) + len(index.ids)
    group = (np.cumsum(cost) // GROUP).astype(np.int64)
    for start, stop in zip(*runs_of(group)):
        s, e = np.searchsorted(row, [start, stop])
        part = index.nearest_of_all(row[s:e] - start, terms[s:e], weights[s:e], stop - start, k, None if without is None else without[start:stop])
        for out, new in zip(found, (part[0] + start, part[1], part[2])):
            out.append(new)
    text, score, place = (np.concatenate(x) for x in found)
    share = (np.bincount(text, score * index.labels[place], rows) + prior) / (np.bincount(text, score, rows) + 1)
    return share, text, score, place


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    start = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    return start, np.append(start[1:], len(values))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-6
        grad = np.array([(p - y) @ x + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        hess = np.array([[w @ (x * x) + 1e-3, w @ x], [w @ x, w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return max(float(a), 1e-3), float(b)


def in_fifth(doc_id: Column) -> Column:
    """Whether the id is in the held-out fifth."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_examples: int = 8_000, max_terms: int = 4_096, least_chi2: float = 30.0, least_share: float = 0.02, neighbours: int = 15,
) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row.

    Labels are learned only from rows outside the held-out fifth (CRC-32 of the id's text modulo 5);
    of these the ``max_examples`` with the least hash of the id. ``evidence`` lists the three nearest
    examples (id, cosine, label). A text without any word of the examples, also a null or empty one, has
    no neighbour and gets the share of label 1 among such examples. Without examples of both kinds all
    scores are that share (0 without any). A document with several labels is toxic if one of them
    says so; null labels count as absent. Null ids are not held out; repeated rows are scored each;
    an empty table gives no rows. Other columns are ignored.
    """
    texts = id_text(docs, id_col, text_col).withColumn("text", F.lower("text"))
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & ~in_fifth(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    examples = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # at most max_examples rows

    def distinct_terms(batches):
        for part in byte_chunks(batches):
            hashes, rows = term_hashes(part.column(1))
            order = np.lexsort((hashes, rows))
            hashes, rows = hashes[order], rows[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            label = np.asarray(part.column(2))[rows[new]]
            key, place = np.unique(hashes[new], return_inverse=True)
            toxic = np.bincount(place, label, len(key)).astype(np.int64)
            word = np.isin(key, Words(*bytes_of(part.column(1)), letters_only=True).hash)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(place, minlength=len(key)).astype(np.int64)), pa.array(toxic), pa.array(word)], names=["term", "n", "toxic", "word"])

    def shingle_sets(batches):
        """A hash of the whole set of five-word shingles of a text."""
        for part in byte_chunks(batches):
            hashes, cuts = distinct_by_row(*Words(*bytes_of(part.column(1))).sequences(5), part.num_rows)
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes), dtype=U)])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))], names=["doc_id", "text", "label", "key"])

    # Copies of a text would lend their label to all its words, so one of each label is counted.
    distinct = examples.mapInArrow(shingle_sets, "doc_id long, text string, label int, key long")
    distinct = distinct.groupBy("key", "label").agg(F.min(F.struct("doc_id", "text")).alias("one")).select("one.*", "label")
    distinct = materialize(distinct, "examples")
    totals = distinct.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    n, n1 = int(totals[0]), int(totals[1])
    counted = distinct.mapInArrow(distinct_terms, "term long, n long, toxic long, word boolean").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("a"), F.max("word").alias("word"))
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    c, d = F.lit(float(n1)) - a, F.lit(float(n - n1)) - b
    chi2 = F.try_divide(F.lit(float(n)) * F.pow(a * d - b * c, F.lit(2.0)), (a + b) * (c + d) * (a + c) * (b + d))
    counted = materialize(counted.select("term", "n", "word", F.coalesce(chi2, F.lit(0.0)).alias("chi2")), "terms")
    beginnings = counted.filter("not word and n >= 5").filter(F.col("chi2") >= max(least_chi2, least_share * n)).orderBy(F.desc("chi2"), "term").limit(max_terms)
    # The words of max_examples rows, and max_terms word beginnings.
    picked = counted.filter("word").unionByName(beginnings).toArrow()
    terms = picked["term"].to_numpy().view(U)
    order = np.argsort(terms)
    terms, held = terms[order], picked["n"].to_numpy()[order]
    factor = FLOOR + np.sqrt(picked["chi2"].to_numpy()[order] / max(n, 1)) if 0 < n1 < n else np.ones(len(terms))

    def frequencies(batches):
        total = np.zeros(len(terms), np.int64)
        rows = 0
        selected = Terms(terms)
        for part in byte_chunks(batches):
            _, term, _ = selected.counts(part.column(1))
            total += np.bincount(term, minlength=len(terms))
            rows += part.num_rows
        keep = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keep, -1)), pa.array(np.append(total[keep], rows))], names=["term", "n"])

    df = np.zeros(len(terms))
    counts = texts.mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row for each term
    term, total = counts["term"].to_numpy(), counts["n"].to_numpy()
    all_rows = int(total[term < 0].sum())
    df[term[term >= 0]] = total[term >= 0]
    idf = (np.log((1 + all_rows) / (1 + df)) + 1) * factor

    # The commonest terms are numbered first.
    common = np.lexsort((terms, -held))[: min(COMMON, int((held * 20 > n).sum()))]
    number = np.full(len(terms), -1, np.int32)
    number[common] = np.arange(len(common))
    number[number < 0] = np.arange(len(common), len(terms))
    shared = spark.sparkContext.broadcast({"terms": terms, "idf": idf, "number": number})  # the words of max_examples rows

    def weighted(part, selected, m):
        """(row, number, weight) of the known terms of a batch, by row."""
        row, term, count = selected.counts(part.column(1))
        return row, m["number"][term], vectors(count, term, row, m["idf"], part.num_rows)

    def example_rows(batches):
        selected = Terms(shared.value["terms"])
        for part in byte_chunks(batches):
            row, term, weight = weighted(part, selected, shared.value)
            cut = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(2), pa.ListArray.from_arrays(cut, pa.array(term.astype(np.int32))),
                pa.ListArray.from_arrays(cut, pa.array(weight.astype(np.float32)))], names=["doc_id", "label", "terms", "weights"])

    found = examples.mapInArrow(example_rows, "doc_id long, label int, terms array<int>, weights array<float>").orderBy("doc_id").toArrow().combine_chunks()  # at most max_examples rows
    sizes = found["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    ids, y = found["doc_id"].to_numpy(), (found["label"].to_numpy() > 0).astype(float)
    some = sizes > 0
    blank = float((y[~some].sum() + 0.5 * y.mean()) / ((~some).sum() + 0.5)) if len(y) else 0.0
    prior = float(y.mean()) if len(y) else 0.0
    rows = {"sizes": sizes[some], "terms": found["terms"].combine_chunks().flatten().to_numpy(), "weights": found["weights"].combine_chunks().flatten().to_numpy(), "ids": ids[some], "labels": y[some]}
    model = spark.sparkContext.broadcast(rows)
    mixed = bool(some.any() and 0 < y[some].mean() < 1)
    del found, rows
    width = len(common)

    def open_index():
        """The index of the examples, built once by each worker."""
        m = model.value
        if "index" not in m:
            row = np.repeat(np.arange(len(m["sizes"]), dtype=np.int32), m["sizes"])
            first = m["terms"] < width
            table = np.zeros((len(m["sizes"]), width), np.float32)
            table[row[first], m["terms"][first]] = m["weights"][first]
            del first
            m["index"] = BlockMaxIndex(table, m["ids"], m["labels"], (row, m["terms"], m["weights"]))
            del m["terms"], m["weights"]  # a worker keeps the index alone
        return m["index"]

    def shares(batches):
        """The votes on examples, each without itself."""
        index, selected = open_index(), Terms(shared.value["terms"])
        for part in byte_chunks(batches):
            row, term, weight = weighted(part, selected, shared.value)
            share = votes(index, row, term, weight, part.num_rows, neighbours, prior, part.column(0).to_numpy())[0]
            has = np.bincount(row, minlength=part.num_rows) > 0
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(has)), part.column(2).filter(pa.array(has)), pa.array(share[has])], names=["doc_id", "label", "share"])

    slope, shift = 1.0, 0.0
    if mixed:
        held_in = examples.repartition(blocks_for(max_examples, 256), "doc_id").mapInArrow(shares, "doc_id long, label int, share double")
        fitted = held_in.orderBy("doc_id", "share").toArrow()  # at most max_examples rows
        slope, shift = fit_logistic(logit(fitted["share"].to_numpy()), (fitted["label"].to_numpy() > 0).astype(float))

    def score(batches):
        index, selected = open_index(), Terms(shared.value["terms"])
        for part in byte_chunks(batches):
            row, term, weight = weighted(part, selected, shared.value)
            share, text, cosine, place = votes(index, row, term, weight, part.num_rows, neighbours, prior)
            near = np.bincount(text, minlength=part.num_rows)
            out = np.where(near > 0, 1 / (1 + np.exp(-(slope * logit(share) + shift))), blank)
            top = np.arange(len(text)) - np.searchsorted(text, text) < 3
            shown = pa.StructArray.from_arrays([pa.array(index.ids[place[top]]), pa.array(cosine[top]), pa.array(index.labels[place[top]].astype(np.int32))], ["doc_id", "cosine", "label"])
            evidence = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(near, 3))).astype(np.int32)), shown)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32)), evidence], names=["doc_id", "score", "predicted", "evidence"])

    scored = texts.mapInArrow(score, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, label: int>>")
    scored = materialize(scored, "scores")  # so that the model can leave the driver
    shared.destroy()
    model.destroy()
    return scored.select("doc_id", in_fifth(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
