"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes, common
words and repeated words, and those of both neighbours; transition weights tie
neighbouring labels. Trained in numpy on a bounded sample of labelled documents,
whose lines all carry the document's label. Forward-backward gives each line's
chance to be good; their mean, weighted by line length, is the score.

Defined results: a text without words (null, empty, spaces) is scored as one
empty line. Repeated rows score alike. Without labelled rows, or with one label
only, every score is the share of label 1 (1.0 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, narrow, table
from .quality_rules import _CLASS, _VOCABULARY, CLASSES
from .words import Block, U, blocks, class_counts, mix

#: Training takes about this many documents, drawn by hash, and at most this many lines of each.
SAMPLE_DOCS, SAMPLE_LINES, THRESHOLD = 5000, 64, 0.3
N_CLASS = len(CLASSES) + 1


def _own_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weight, document) of each line; a document without words has one line of zeros."""
    data, docs = block.data, len(block.offsets) - 1
    breaks = np.flatnonzero(data == 0x0A) + 1
    cuts = np.unique(np.concatenate([block.offsets[:-1], breaks]))
    cuts = cuts[cuts < len(data)] if len(data) else cuts[:0]
    n_lines = len(cuts)
    bounds = np.append(cuts, len(data)) if n_lines else np.zeros(1, np.int64)
    classes = class_counts(_CLASS, data, bounds, N_CLASS)[:, : len(CLASSES)].astype(np.float64)
    chars = np.maximum(classes.sum(1), 1)
    line_of = np.searchsorted(cuts, block.starts, "right") - 1
    words = np.bincount(line_of, minlength=n_lines)
    h = block.lowered().hashes
    found = np.searchsorted(_VOCABULARY, h)
    found[found == len(_VOCABULARY)] = 0
    common = np.bincount(line_of, _VOCABULARY[found] == h, n_lines)
    repeat = np.zeros(n_lines)
    if len(h) >= 3:
        owner = np.repeat(np.arange(docs), np.diff(block.first))
        tri = block.grams(3)
        place = np.flatnonzero(owner[2:] == owner[: len(tri)])
        _, inverse, count = np.unique(tri[place] ^ mix(owner[place].astype(U)), return_inverse=True, return_counts=True)
        repeat = np.bincount(line_of[place[count[inverse] > 1]], minlength=n_lines)
    share = {c: classes[:, i] / chars for i, c in enumerate(CLASSES)}
    w = np.maximum(words, 1)
    length = chars / w
    raw = np.stack(
        [share["vowel"] * 3, share["upper"], share["digit"] * 4, share["stop"] * 8, share["mark"] * 8, share["symbol"] * 8, share["two_byte"] * 5, common / w * 3, repeat / w, np.log1p(words) / 3, length / 8]
        + [share["symbol"] > 0.03, share["symbol"] > 0.12, share["upper"] > 0.15, share["upper"] > 0.5, share["mark"] > 0.05, share["stop"] > 0.06, share["digit"] > 0.1, repeat > 0.2 * w, repeat > 0.6 * w, common < 0.05 * w, common < 0.15 * w, words < 4, words > 60, length < 4.5, length > 8],
        1,
    ).astype(np.float64)
    real = words > 0
    doc = np.searchsorted(block.offsets, cuts[real], "right") - 1
    empty = np.setdiff1d(np.arange(docs), doc)
    feats = np.concatenate([raw[real], np.zeros((len(empty), raw.shape[1]))])
    weight = np.concatenate([chars[real], np.ones(len(empty))])
    doc = np.concatenate([doc, empty])
    order = np.argsort(doc, kind="stable")
    return feats[order], weight[order], doc[order]


N_OWN = 26
N_FEATURES = 3 * N_OWN + 3


def features(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, both neighbours' within the document, and bias, first and last flags."""
    n = len(own)
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    last = np.append(first[1:], True)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, np.ones((n, 1)), first[:, None], last[:, None]])


def chains(doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of documents of like length: (index of each line, padded to the longest; lengths)."""
    if not len(doc):
        return []
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    lengths = np.diff(np.append(starts, len(doc)))
    out, kind = [], np.ceil(np.log2(lengths)).astype(int)
    for k in np.unique(kind):
        s, n = starts[kind == k], lengths[kind == k]
        out.append((s[:, None] + np.minimum(np.arange(n.max())[None, :], n[:, None] - 1), n))
    return out


def forward_backward(unary: np.ndarray, trans: np.ndarray, index: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance of good for each place, summed pair marginals 2 x 2 of each chain, log partition).

    ``unary`` is the log-odds of good; ``trans[a, b]`` scores label b after a.
    """
    u = np.clip(unary[index], -30, 30)
    docs, longest = u.shape
    emit = np.stack([np.zeros_like(u), u], 2)
    emit -= emit.max(2, keepdims=True)
    base = np.maximum(u, 0)
    e, m = np.exp(emit), np.exp(trans)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((docs, longest))
    alpha[:, 0] = e[:, 0]
    for t in range(longest):
        if t:
            alpha[:, t] = (alpha[:, t - 1] @ m) * e[:, t]
        scale[:, t] = alpha[:, t].sum(1)
        alpha[:, t] /= scale[:, t][:, None]
    inside = np.arange(longest)[None, :] < n[:, None]
    for t in range(longest - 2, -1, -1):
        b = ((e[:, t + 1] * beta[:, t + 1]) @ m.T) / scale[:, t + 1][:, None]
        beta[:, t] = np.where(inside[:, t + 1][:, None], b, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    pair = np.zeros((docs, 2, 2))
    for t in range(1, longest):
        p = alpha[:, t - 1][:, :, None] * m[None] * (e[:, t] * beta[:, t])[:, None, :] / scale[:, t][:, None, None]
        pair += np.where(inside[:, t][:, None, None], p, 0)
    log_z = np.where(inside, np.log(scale) + base, 0).sum(1)
    return gamma[:, :, 1], pair, log_z


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    constant: float | None = None

    def unary(self, own: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """``features(own, doc) @ weights`` without the wide matrix."""
        mine, before, after = (own @ w for w in self.weights[: 3 * N_OWN].reshape(3, N_OWN))
        bias, first, last = self.weights[3 * N_OWN :]
        same = doc[1:] == doc[:-1]
        out = mine + bias
        out[1:] += np.where(same, before[:-1], first)
        out[:-1] += np.where(same, after[1:], last)
        out[:1] += first
        out[-1:] += last
        return out

    def scores(self, own: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(docs, self.constant)
        unary = self.unary(own, doc)
        good = np.zeros(len(doc))
        for index, n in chains(doc):
            p, _, _ = forward_backward(unary, self.trans, index, n)
            inside = np.arange(index.shape[1])[None, :] < n[:, None]
            good[index[inside]] = p[inside]
        return np.clip(np.bincount(doc, good * weight, docs) / np.bincount(doc, weight, docs), 0, 1)


def fit(own: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 250, rate: float = 0.08, l2: float = 2.0) -> Model:
    """Maximum likelihood by Adam; ``label`` (0 or 1) is each document's."""
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), float(label.mean()) if len(label) else 1.0)
    x = features(own, doc)
    truth = label[doc].astype(float)
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    groups = chains(doc)
    goal = np.zeros((2, 2))
    for index, n in groups:
        for d, k in zip(label[doc[index[:, 0]]], n, strict=True):
            goal[d, d] += k - 1
    # neighbouring lines share evidence; the likelihood is tempered to the number of documents
    scale = 1.0 / len(doc)
    for step in range(1, rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        unary = x @ w
        expect, pairs = np.zeros(len(doc)), np.zeros((2, 2))
        for index, n in groups:
            p, pair, _ = forward_backward(unary, trans, index, n)
            inside = np.arange(index.shape[1])[None, :] < n[:, None]
            expect[index[inside]] = p[inside]
            pairs += pair.sum(0)
        grad = np.concatenate([x.T @ (truth - expect), (goal - pairs).ravel()]) * scale - l2 * theta / len(doc)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def _line_rows(text: str):
    def run(batches):
        for batch in batches:
            label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            draw = batch.column(batch.schema.get_field_index("draw")).to_numpy(zero_copy_only=False)
            for lo, hi, block in blocks(batch, text=text):
                own, _, doc = _own_features(block)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                rows = []
                for i in range(hi - lo):
                    n = cut[i + 1] - cut[i]
                    a = cut[i] + (int(draw[lo + i]) % (n - SAMPLE_LINES + 1) if n > SAMPLE_LINES else 0)
                    rows.append(own[a : min(a + SAMPLE_LINES, cut[i + 1])].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(draw[lo:hi]), pa.array(label[lo:hi].astype(np.int32)), pa.array(rows, pa.binary())], names=["draw", "label", "lines"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Model from about ``sample`` of the documents that labels(doc_id, label) marks, drawn by hash of their id."""
    marked = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    count = marked.count()
    span = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    drawn = marked.withColumn("draw", draw).filter(F.col("draw") < F.lit(int(span * min(1.0, sample / max(count, 1)))))
    some = narrow(docs, doc_id, text).withColumnRenamed(doc_id, "doc_id").join(F.broadcast(drawn), "doc_id")  # about ``sample`` rows
    rows = sorted((r["draw"], bytes(r["lines"]), r["label"]) for r in some.mapInArrow(_line_rows(text), "draw long, label int, lines binary").collect())
    own = [np.frombuffer(r[1], np.float32).reshape(-1, N_OWN) for r in rows]
    doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
    return fit(np.concatenate([np.zeros((0, N_OWN)), *own]).astype(float), doc, np.array([r[2] for r in rows], int))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``score`` (double)."""

    def run(batch, text):
        parts = [np.zeros(0)]
        for lo, hi, block in blocks(batch, text=text):
            parts.append(model.scores(*_own_features(block), hi - lo))
        return {"score": pa.array(np.concatenate(parts), pa.float64())}

    return annotate(docs, run, "score double", text)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def quality_model(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """The query's model: it learns labels of all folds but fold 0."""
    known = labels.filter(fold(F.col("doc_id"), folds) != 0).select("doc_id", F.col("quality").alias("label"))
    return train(docs, known)


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text")
    scored = score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
