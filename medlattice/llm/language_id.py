"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths slide over fixed-length windows,
each is max-pooled and a softmax gives the language. Trained in numpy on windows
drawn from labelled texts. Every text is covered by windows end to end; their
softmax outputs, weighted by the bytes each window holds, make the score.

For inference a filter's weights fold with the embedding into tables by byte
pair, so a response is a sum of two table rows at most.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
Repeated rows are judged alike. With one known language all others get it; with
none every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, narrow, table
from .line_crf import fold
from .words import LOWER, blocks

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 8
#: Training draws about this many documents of each language and at most this many windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS = 1200, 2, 12


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    out: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """By byte pair: the first two bytes of all widths; by byte: the third of width 3; by pair: the last two of width 4."""
        e = self.embed
        part = [[f[j * EMBED : (j + 1) * EMBED] for j in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        each = [[e @ p for p in ps] for ps in part]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        head = np.hstack([pair(t[0], t[1]) + b for t, b in zip(each, self.bias, strict=True)])
        return [np.ascontiguousarray(x, np.float32) for x in (head, each[1][2], pair(each[2][2], each[2][3]))]

    def probabilities(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Softmax of windows (n x WINDOW bytes)."""
        n = len(windows)
        w = windows.astype(np.int32)
        two = w[:, :-1] * 256 + w[:, 1:]
        places = WINDOW - WIDTHS[-1] + 1
        head = tables[0].take(two[:, :places].ravel(), 0).reshape(n, places, -1)
        head[:, :, FILTERS : 2 * FILTERS] += tables[1].take(w[:, 2 : 2 + places].ravel(), 0).reshape(n, places, -1)
        head[:, :, 2 * FILTERS :] += tables[2].take(two[:, 2 : 2 + places].ravel(), 0).reshape(n, places, -1)
        return _softmax(np.maximum(head.max(1), 0) @ self.dense + self.out)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(windows: np.ndarray, label: np.ndarray, langs: list[str], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.004) -> Network:
    """Adam on the cross entropy; gradients pass only through each filter's largest response."""
    rng = np.random.default_rng(7)
    k = len(langs)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "dense": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), k)), "out": np.zeros(k)}
    for i, w in enumerate(WIDTHS):
        p |= {f"f{i}": rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)), f"b{i}": np.zeros(FILTERS)}
    p = {name: x.astype(np.float32) for name, x in p.items()}
    m, v, step = {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}, 0
    places = WINDOW - WIDTHS[-1] + 1
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            x, n = windows[own], len(own)
            e = p["embed"][x]
            pooled, best = [], []
            for i, w in enumerate(WIDTHS):
                patch = np.concatenate([e[:, j : j + places] for j in range(w)], 2)
                r = patch.reshape(n * places, -1) @ p[f"f{i}"]
                r = r.reshape(n, places, FILTERS)
                arg = r.argmax(1)
                best.append(arg)
                pooled.append(np.take_along_axis(r, arg[:, None, :], 1)[:, 0] + p[f"b{i}"])
            z = np.hstack(pooled)
            a = np.maximum(z, 0)
            q = _softmax(a @ p["dense"] + p["out"])
            q[np.arange(n), label[own]] -= 1
            q /= n
            g = {"dense": a.T @ q, "out": q.sum(0), "embed": np.zeros_like(p["embed"])}
            dz = (q @ p["dense"].T) * (z > 0)
            for i, w in enumerate(WIDTHS):
                d = dz[:, i * FILTERS : (i + 1) * FILTERS]
                spot = best[i][:, :, None] + np.arange(w)
                taken = x[np.arange(n)[:, None, None], spot]
                g[f"f{i}"] = np.einsum("nfk,nf->kf", p["embed"][taken].reshape(n, FILTERS, -1), d)
                g[f"b{i}"] = d.sum(0)
                back = d[:, :, None] * p[f"f{i}"].T[None]
                np.add.at(g["embed"], taken.reshape(-1), back.reshape(-1, EMBED))
            step += 1
            for name, x_ in p.items():
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                p[name] = x_ - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-7)
    n = range(len(WIDTHS))
    return Network(langs, p["embed"], [p[f"f{i}"] for i in n], [p[f"b{i}"] for i in n], p["dense"], p["out"])


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, bytes held, document): each text cut end to end; the last window is filled with spaces."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][doc] + nth * WINDOW
    held = np.minimum(WINDOW, offsets[1:][doc] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW)[None, :] < held[:, None]
    return np.where(inside, LOWER[data[np.minimum(at, max(len(data) - 1, 0))]] if len(data) else 32, 32).astype(np.uint8), held, doc


def train(docs: DataFrame, sample: int = SAMPLE_DOCS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Network:
    """Network from about ``sample`` documents of each language, drawn by hash of their id."""
    known = docs.filter(F.col(lang).isNotNull() & (F.length(text) >= 20))
    counts = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, span = sorted(counts), 1 << 30
    if not langs:
        return Network([], *[None] * 5)
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, int(span * min(1.0, sample / counts[k])))]), F.col(lang))
    draw = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(span))
    some = known.select(F.col(text).alias("text"), F.col(lang).alias("lang"), draw.alias("draw")).filter(F.col("draw") < share)

    def run(batches):
        for batch in batches:
            name, draw = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, block in blocks(batch):
                w, held, doc = windows_of(block.data, block.offsets)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                rows = []
                for i in range(hi - lo):
                    n = first[i + 1] - first[i]
                    for j in sorted({(draw[lo + i] + x * 7919) % int(n) for x in range(min(SAMPLE_WINDOWS, n))}) if n else ():
                        if held[first[i] + j] >= 20:
                            rows.append((draw[lo + i], name[lo + i], w[first[i] + j].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["draw", "lang", "window"])

    rows = sorted((r["draw"], r["lang"], bytes(r["window"])) for r in some.mapInArrow(run, "draw long, lang string, window binary").collect())
    if not rows:
        return Network([], *[None] * 5)
    windows = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WINDOW)
    return fit(windows, np.array([langs.index(r[1]) for r in rows]), langs)


def predict(docs: DataFrame, net: Network, text: str = "text", at_once: int = 48) -> DataFrame:
    """docs with ``lang_pred`` and ``score``; memory is bounded by ``at_once`` windows and one Arrow batch."""
    tables = net.tables() if net.langs else []
    small = [x.astype(np.float32) for x in (net.dense, net.out)] if net.langs else []
    bundle = docs.sparkSession.sparkContext.broadcast((tables, small, net.langs))  # a fixed size: filters and bytes

    def run(batch, text):
        tables, small, langs = bundle.value
        model = Network(langs, None, [], [], *(small or [None, None]))
        texts = batch.column(batch.schema.get_field_index(text))
        pred, score = [], []
        for lo, hi, block in blocks(batch, text=text):
            total = np.zeros((hi - lo, max(len(langs), 1)))
            if langs:
                w, held, doc = windows_of(block.data, block.offsets)
                for a in range(0, len(w), at_once):
                    np.add.at(total, doc[a : a + at_once], model.probabilities(w[a : a + at_once], tables) * held[a : a + at_once, None])
            size = np.maximum(np.diff(block.offsets), 1)
            for i in range(hi - lo):
                t = texts[lo + i].as_py()
                known = bool(langs) and t is not None and any(map(str.isalpha, t))
                k = int(total[i].argmax())
                pred.append(langs[k] if known else "und")
                score.append(float(min(1.0, total[i][k] / size[i])) if known else 0.0)
        return {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}

    return annotate(docs, run, "lang_pred string, score double", text)


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    net = train(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")
