"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read a window of a text's UTF-8 bytes, one from each end. At every byte both states together
give a probability for each language; a document's probability is the mean over all bytes of its windows. Windows are
`WINDOW` bytes apart, cover the whole text, and each starts from a zero state. The network is trained here, in numpy, by
backpropagation through time, on windows of a bounded sample of labelled documents, which has every language that
occurs; every position of a window carries its document's language.

Defined results: null text and text without a letter give `und` and score 0, as does every text if nothing was labelled.
Repeated rows each give a row; empty tables give none. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylake.llm import words as W

WINDOW = 64
HIDDEN = 8
#: Labelled documents for each language, and windows of each, that training reads at most.
SAMPLE, SPOTS = 500, 4
#: Windows of all languages together, divided among them; but each language keeps LEAST documents, so none goes unlearned.
WINDOWS, LEAST = 128_000, 24
#: Probabilities that are held at once, at most; with many languages fewer windows are worked on together.
CELLS = 1 << 23
UND = "und"


@dataclass
class Network:
    """For each direction the byte table (3H x 256), recurrent weights (3H x H) and bias of the new state; then the output.

    Gates are stored halved, so that one tanh serves all three: sigmoid(x) = (1 + tanh(x / 2)) / 2.
    """

    languages: list[str]
    table: list[np.ndarray]
    recurrent: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def states(self, byte: np.ndarray, d: int) -> np.ndarray:
        """(T, H, N) states of one direction for bytes (T, N), in order of position."""
        t, n = byte.shape
        h2 = HIDDEN
        out = np.zeros((t, h2, n), np.float32)
        h = np.zeros((h2, n), np.float32)
        table, u, inner = self.table[d], self.recurrent[d], self.inner[d][:, None]
        for k in range(t) if d == 0 else range(t - 1, -1, -1):
            x = table.take(byte[k], axis=1)
            g = u @ h
            x[: 2 * h2] += g[: 2 * h2]
            gate = np.tanh(x[: 2 * h2], out=x[: 2 * h2])
            gate += 1
            gate *= 0.5
            new = g[2 * h2 :]
            new += inner
            new *= gate[h2:]
            new += x[2 * h2 :]
            np.tanh(new, out=new)
            h = h - new
            h *= gate[:h2]
            h += new
            out[k] = h
        return out

    def probabilities(self, byte: np.ndarray) -> np.ndarray:
        """(T, C, N): the label of every position."""
        both = np.concatenate([self.states(byte, 0), self.states(byte, 1)], axis=1)
        z = np.matmul(self.out, both)
        z += self.bias[:, None]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z


def _new(languages: list[str], rng: np.random.Generator) -> Network:
    h = HIDDEN
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return Network(languages, [draw(3 * h, 256) for _ in range(2)], [draw(3 * h, h) for _ in range(2)], [np.zeros(h, np.float32) for _ in range(2)], draw(len(languages), 2 * h), np.zeros(len(languages), np.float32))


def _backward(net: Network, byte: np.ndarray, states: np.ndarray, dh_out: np.ndarray, d: int) -> list[np.ndarray]:
    """Gradients of one direction's table, recurrent weights and inner bias, back through all positions."""
    t, n = byte.shape
    h2 = HIDDEN
    table, u, inner = net.table[d], net.recurrent[d], net.inner[d][:, None]
    dx_all = np.zeros((t, 3 * h2, n), np.float32)
    du, db = np.zeros_like(u), np.zeros(h2, np.float32)
    dh = np.zeros((h2, n), np.float32)
    order = list(range(t)) if d == 0 else list(range(t - 1, -1, -1))
    for k in range(t - 1, -1, -1):
        at = order[k]
        before = states[order[k - 1]] if k else np.zeros((h2, n), np.float32)
        x = table.take(byte[at], axis=1)
        g = u @ before
        gate = 0.5 * (1 + np.tanh(x[: 2 * h2] + g[: 2 * h2]))
        z, r = gate[:h2], gate[h2:]
        inside = g[2 * h2 :] + inner
        new = np.tanh(x[2 * h2 :] + r * inside)
        dh = dh + dh_out[at]
        dnew = dh * (1 - z) * (1 - new * new)
        dz = dh * (before - new) * z * (1 - z) * 2
        dr = dnew * inside * r * (1 - r) * 2
        dg = np.concatenate([dz, dr, dnew * r])
        dx_all[at] = np.concatenate([dz, dr, dnew])
        du += dg @ before.T
        db += dg[2 * h2 :].sum(axis=1)
        dh = dh * z + u.T @ dg
    flat, deltas = byte.ravel(), dx_all.transpose(1, 0, 2).reshape(3 * h2, -1)
    dtable = np.stack([np.bincount(flat, weights=row, minlength=256) for row in deltas]).astype(np.float32)
    return [dtable, du, db]


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Network:
    """A network from windows (N, WINDOW) of bytes and the number of each one's language; Adam on the mean cross-entropy."""
    rng = np.random.default_rng(seed)
    net = _new(languages, rng)
    batch = max(1, min(batch, CELLS // (WINDOW * len(languages))))
    held = [net.table[0], net.recurrent[0], net.inner[0], net.table[1], net.recurrent[1], net.inner[1], net.out, net.bias]
    first, second, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    steps = epochs * max(1, -(-len(windows) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            byte = np.ascontiguousarray(windows[pick].T)
            t, n = byte.shape
            states = [net.states(byte, 0), net.states(byte, 1)]
            both = np.concatenate(states, axis=1)
            z = np.matmul(net.out, both) + net.bias[:, None]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[:, target[pick], np.arange(n)] -= 1
            z *= 1 / (t * n)
            dout, dbias = np.einsum("tcn,thn->ch", z, both, optimize=True), z.sum(axis=(0, 2))
            dboth = np.matmul(net.out.T, z)
            grads = _backward(net, byte, states[0], dboth[:, :HIDDEN], 0) + _backward(net, byte, states[1], dboth[:, HIDDEN:], 1) + [dout, dbias]
            step += 1
            scale = rate * (1 - 0.9 * step / steps)
            for p, g, m, v in zip(held, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= scale * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _sample(docs: DataFrame, sample: int, windows: int) -> tuple[list[str], list[tuple[str, bytes]]]:
    """All labelled languages, and windows of a bounded number of documents of each, chosen by a hash of the id."""
    labelled = docs.where("lang is not null and doc_id is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    sample = min(sample, max(LEAST, windows // (SPOTS * len(counts))))
    part = docs.sparkSession.createDataFrame([(lang, min(1.0, sample / n)) for lang, n in sorted(counts.items())], "lang string, part double")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.join(F.broadcast(part), "lang").where(share < F.col("part"))  # a row for each language
    chosen = chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # rows of one id share its draw: of these one is learned from
    spots = [F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id, {k}), greatest(1, char_length(text) - {WINDOW} + 1)) as int), {WINDOW})") for k in range(SPOTS)]
    rows = chosen.select("doc_id", "lang", F.explode(F.array(*spots)).alias("spot")).where("spot rlike '\\\\p{L}'").collect()  # about sample x SPOTS x languages rows
    return sorted(counts), sorted((r.lang, r.spot.encode()[:WINDOW]) for r in rows)


def fit(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Network | None:
    """A network from labelled documents; None if there are none."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    names, spots = _sample(docs, sample, windows)
    if not spots:
        return None
    taken = np.zeros((len(spots), WINDOW), np.uint8)
    for k, (_, spot) in enumerate(spots):
        taken[k, : len(spot)] = np.frombuffer(spot, np.uint8)
        taken[k, len(spot) :] = 32
    number = {lang: k for k, lang in enumerate(names)}
    return train(taken, np.array([number[lang] for lang, _ in spots]), names, **options)


def _pooled(net: Network, offsets: np.ndarray, data: np.ndarray, rows: int = 8192) -> np.ndarray:
    """(documents, languages): the mean over all bytes of each document; empty ones are 0."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    start = offsets[doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    stop = np.minimum(start + WINDOW, offsets[doc + 1])
    total = np.zeros((len(size), len(net.languages)))
    rows = max(1, min(rows, CELLS // (WINDOW * len(net.languages))))
    for lo in range(0, len(doc), rows):
        s, e, d = start[lo : lo + rows], stop[lo : lo + rows], doc[lo : lo + rows]
        at = s[None, :] + np.arange(WINDOW)[:, None]
        inside = at < e[None, :]
        byte = np.where(inside, data[np.minimum(at, len(data) - 1)], 32)
        p = net.probabilities(byte)
        p *= inside[:, None, :]
        whole = p.sum(axis=0)
        for c in range(len(net.languages)):
            total[:, c] += np.bincount(d, weights=whole[c], minlength=len(size))
    return total / np.maximum(size, 1)[:, None]


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, lang_pred, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if net is None:
        return rows.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        names = np.array([*net.languages, UND], object)
        for b in W.slices(batches, max(1, CELLS // len(net.languages))):
            mean = _pooled(net, *W.raw(b.column(1)))
            known = b.column(2).to_numpy(zero_copy_only=False)
            best = np.where(known, mean.argmax(axis=1), len(net.languages))
            score = np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)
            yield pa.record_batch([b.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
