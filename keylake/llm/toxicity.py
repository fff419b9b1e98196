"""Toxicity: a counterfactual-regularised classifier of whole texts.

A logistic regression over the presence of words and of beginnings of longer words, which catch compounds of one stem.
It is fitted on a bounded sample of labelled documents: near copies in the sample count once, the words and beginnings
that are most clearly more frequent in toxic texts become features, and terms that may be swapped always are. Every
sampled text with such terms is also taken with each term swapped for the others of its group, words and their
beginnings alike; the squared change of its logit is penalised, and every text's swaps count. So a mention of a group
moves no score while words that are toxic beside it do.

Groups are given (names of groups of people, by default), and pairs of words are learned from the sample besides: words
that texts of both labels hold, toxic ones no more often than others, and that stand between the same neighbours.

Defined results: null and empty texts score as a text without features. Without labelled rows, or with one label only,
every text gets the share of toxic labels (0 if there are none). Repeated rows each give a row. Only the named columns
are read; labels with null id or value teach nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylake.llm import words as W
from keylake.session import materialize

#: Labelled documents that the fit reads at most.
SAMPLE = 10_000
FEATURES = 512
#: Lengths in bytes of beginnings of words.
PREFIXES = (3, 4, 5, 6, 7)
#: A feature is in so many sampled texts at least, and its share of toxic ones is so many standard deviations above the usual.
SUPPORT, CLEAR = 5, 6.0
#: Words that may become pairs and pairs that are learned at most; the least likeness of two words' neighbours (the
#: Bhattacharyya coefficient of their shares).
TERMS, PAIRS, ALIKE = 200, 24, 0.5
#: Words for groups of people, by language and kind; swapped within a line.
IDENTITY = """
women men girls boys woman man
muslims christians jews hindus buddhists atheists
muslim christian jewish hindu buddhist atheist
black white asian latino african european
gay lesbian straight bisexual transgender
immigrants refugees foreigners natives
disabled deaf blind
frauen männer mädchen jungen
muslime christen juden
ausländer flüchtlinge einwanderer
femmes hommes filles garçons
musulmans chrétiens juifs
immigrés réfugiés étrangers
mujeres hombres chicas chicos
musulmanes cristianos judíos
inmigrantes refugiados extranjeros
"""


def _present(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all words and beginnings; with repeats."""
    beginning = w.prefixes.ravel()
    row = np.concatenate([w.row, np.repeat(w.row, w.prefixes.shape[1])])
    feature = np.concatenate([w.hash, beginning])
    keep = feature != 0
    return row[keep], feature[keep]


def _places(w: W.Words, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the distinct features of each row."""
    found = []
    for values in (w.hash, *w.prefixes.T):
        there, place = W.member(values, features)
        found.append(w.row[there] * np.int64(len(features) + 1) + place[there])
    return np.divmod(np.unique(np.concatenate(found)), len(features) + 1)


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the intercept; probability of a text by its distinct features.

    swaps is the number of swapped texts whose change of score was penalised, groups are those learned from the sample.
    """

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    swaps: int = 0
    groups: list[list[str]] = field(default_factory=list)

    def score(self, column: pa.Array) -> np.ndarray:
        if len(column) > 1024:
            return np.concatenate([self.score(column.slice(lo, 1024)) for lo in range(0, len(column), 1024)])
        w = W.words(column, PREFIXES)
        row, place = _places(w, self.features)
        logit = self.intercept + np.bincount(row, weights=self.weights[place], minlength=w.rows)
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def sketches(w: W.Words) -> list[bytes]:
    """Six min-hashes of each row's five-word shingles; none for shorter rows."""
    h, at = W.shingles(w, 5)
    full, starts = np.unique(w.row[at], return_index=True)
    out = [b""] * w.rows
    if len(full):
        least = np.stack([np.minimum.reduceat(W.mix(h ^ W.U(k * 7919 + 1)), starts) for k in range(6)], axis=1)
        for r, x in zip(full.tolist(), least, strict=True):
            out[r] = x.tobytes()
    return out


def _without_copies(rows: list[tuple[int, bytes]]) -> list[int]:
    """Ids of rows (id, sketch) but those that share two of six min-hashes with one earlier row."""
    where: dict[tuple[int, int], list[int]] = {}
    out = []
    for doc_id, sketch in rows:
        met: dict[int, int] = {}
        for k, x in enumerate(np.frombuffer(sketch, W.U).tolist()):
            for other in where.get((k, x), ()):
                met[other] = met.get(other, 0) + 1
            where.setdefault((k, x), []).append(doc_id)
        if max(met.values(), default=0) < 2:
            out.append(doc_id)
    return out


def identity_groups() -> list[list[str]]:
    return [line.split() for line in IDENTITY.strip().splitlines()]


def learned_pairs(texts: DataFrame, terms: int = TERMS, pairs: int = PAIRS) -> list[list[str]]:
    """Pairs of words that stand in like contexts in a bounded sample (text, label): each the other's nearest.

    The `terms` most frequent words that some texts of both labels have, and whose share of toxic ones is nearer to the
    usual than to all, are compared by how often each of them is the left and the right neighbour of each.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = texts.select("label", F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    counted = words.select("label", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    share = texts.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    both = (F.col("toxic") >= SUPPORT) & (F.col("n") - F.col("toxic") >= SUPPORT) & (F.col("toxic") <= F.col("n") * (1 + share) / 2)
    chosen = [r.word for r in counted.where(both).orderBy(F.desc("n"), "word").limit(terms).collect()]
    if len(chosen) < 2:
        return []
    here = lambda x: x.isin(chosen)
    met = words.select(F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("p")).select("p.a", "p.b")
    place, size = {w: k for k, w in enumerate(chosen)}, len(chosen)
    counts = np.zeros((size, 2 * size + 2))
    of_b = F.when(here(F.col("b")), F.col("b"))
    of_a = F.when(here(F.col("a")), F.col("a"))
    for r in met.where(here(F.col("a")) | here(F.col("b"))).select(of_a.alias("a"), of_b.alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).collect():  # terms x terms at most
        if r.a is not None:
            counts[place[r.a], place[r.b] if r.b is not None else 2 * size] += r.n
        if r.b is not None:
            counts[place[r.b], size + place[r.a] if r.a is not None else 2 * size + 1] += r.n
    root = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
    alike = root @ root.T
    np.fill_diagonal(alike, -1)
    nearest = alike.argmax(axis=1)
    found = [(-alike[a, b], a, int(b)) for a, b in enumerate(nearest) if a < b and nearest[b] == a and alike[a, b] >= ALIKE]
    return [sorted([chosen[a], chosen[b]]) for _, a, b in sorted(found)[:pairs]]


def _groups(groups: list[list[str]] | None = None) -> list[np.ndarray]:
    return [W.word_hashes(g) for g in (identity_groups() if groups is None else groups)]


def _term_features(ordered: np.ndarray, groups: list[list[str]] | None = None) -> list[tuple[np.ndarray, list[set[int]]]]:
    """For each group its terms' hashes, and the places of each term's features: the word and its beginnings."""
    out = []
    for group in identity_groups() if groups is None else groups:
        w = W.words(pa.array(group, pa.string()), PREFIXES)
        row, place = _places(w, ordered)
        out.append((w.hash, [set(place[row == r].tolist()) for r in range(w.rows)]))
    return out


def _text_swaps(w: W.Words, ordered: np.ndarray, groups: list[list[str]] | None = None) -> Iterator[tuple[int, ...]]:
    """The change of each text's features, for each of its terms of a group and each other term of the group.

    A change is the places of features that go, as -1 - place, and of those that come, in order. A feature that another
    word of the text has too does not go, and one that the text has already does not come.
    """
    known = _term_features(ordered, groups)
    terms = np.sort(np.concatenate([h for h, _ in known]))
    first = np.searchsorted(w.row, np.arange(w.rows + 1))
    for r in np.unique(w.row[W.member(w.hash, terms)[0]]).tolist():
        mine, at = np.unique(w.hash[first[r] : first[r + 1]], return_index=True)
        at = at + first[r]
        one = W.Words(mine, np.arange(len(mine)), w.start[at], w.end[at], len(mine), w.data, w.prefixes[at])
        word, place = _places(one, ordered)
        holders = np.bincount(place, minlength=len(ordered))  # distinct words of the text that have a feature
        for hashes, features in known:
            there, _ = W.member(hashes, mine)
            for a in np.flatnonzero(there).tolist():
                only = {p for p in features[a] if holders[p] == 1}
                for b in range(len(hashes)):
                    if b != a:
                        gone, come = only - features[b], {p for p in features[b] if not holders[p]}
                        yield tuple(sorted([*(-1 - p for p in gone), *come]))


def _word_swaps(x: np.ndarray, ordered: np.ndarray) -> dict[tuple[int, ...], int]:
    """Changes and their numbers of texts where only the presence of whole words is known."""
    out: dict[tuple[int, ...], int] = {}
    for group in _groups():
        columns = np.searchsorted(ordered, np.sort(group)).tolist()
        for a in columns:
            n = int(x[:, a].sum())
            for b in columns if n else ():
                both = int((x[:, a] * x[:, b]).sum())
                for change, k in (((-1 - a, b), n - both), ((-1 - a,), both)) if a != b else ():
                    if k:
                        out[change] = out.get(change, 0) + k
    return out


def _curve(swaps: dict[tuple[int, ...], int], size: int) -> np.ndarray:
    """The mean over all swaps of the outer product of a change with itself."""
    out = np.zeros((size, size))
    for change, n in swaps.items():
        at = np.array([p if p >= 0 else -1 - p for p in change], np.int64)
        sign = np.array([1.0 if p >= 0 else -1.0 for p in change])
        out[np.ix_(at, at)] += n * np.outer(sign, sign)
    return out / max(1, sum(swaps.values()))


def train(x: np.ndarray, y: np.ndarray, ordered: np.ndarray, swap_penalty: float = 10.0, ridge: float = 0.002, swaps: dict[tuple[int, ...], int] | None = None) -> Model:
    """Fit on presence (texts x features in the order of their hashes) and labels, both of which occur.

    swaps are changes as _text_swaps() gives them, with their numbers; without them, those of whole words.
    """
    curve = swap_penalty * _curve(_word_swaps(x, ordered) if swaps is None else swaps, len(ordered)) * len(x)
    penalty = np.zeros((len(ordered) + 1,) * 2)
    penalty[:-1, :-1] = curve + ridge * np.eye(len(ordered))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(len(ordered) + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(40):  # Newton's method, with a damped step
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + penalty + 1e-6 * np.eye(len(w)), gradient)
        w -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Model(ordered, w[:-1], float(w[-1]), sum(swaps.values()) if swaps else 0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", groups: list[list[str]] | None = None, learned: int = PAIRS, **options) -> Model:
    """A model from documents and their labels (0 or 1); reads `sample` labelled documents at most, chosen by a hash of the id.

    groups are the terms that may stand for each other (by default names of groups of people); `learned` pairs at most are
    found besides.

    Of an id with several labels the larger counts, of an id with several texts the smaller.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    chosen = labels.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    taken = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # `sample` rows at most
    taken = materialize(taken, "labelled")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sketches(W.words(b.column(2))), pa.binary())], ["doc_id", "label", "sketch"])

    rows = sorted(taken.mapInArrow(sketch, "doc_id long, label int, sketch binary").collect(), key=lambda r: r.doc_id)
    prior = float(np.mean([r.label for r in rows])) if rows else 0.0
    single = set(_without_copies([(r.doc_id, bytes(r.sketch)) for r in rows]))
    y_of = {r.doc_id: r.label for r in rows if r.doc_id in single}
    n, positive = len(y_of), sum(y_of.values())
    if not 0 < positive < n:
        return Model(np.zeros(0, W.U), np.zeros(0), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 700.0 * (1 if prior else -1))
    ids = docs.sparkSession.createDataFrame([(d,) for d in sorted(single)], "doc_id long")  # `sample` ids at most
    kept = materialize(taken.join(F.broadcast(ids), "doc_id"), "kept")
    pairs = learned_pairs(kept.select("text", "label"), pairs=learned) if learned else []
    swapped = (identity_groups() if groups is None else groups) + pairs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            row, feature = _present(W.words(b.column(2), PREFIXES))
            pairs = np.unique(np.rec.fromarrays([row, feature]))
            found, place = np.unique(pairs.f1, return_inverse=True)
            toxic = np.bincount(place, weights=b.column(1).to_numpy()[pairs.f0], minlength=len(found)).astype(np.int64)
            yield pa.record_batch([pa.array(W.unsigned_to_long(found)), pa.array(np.bincount(place, minlength=len(found))), pa.array(toxic)], ["feature", "n", "toxic"])

    share = positive / n
    z = (F.col("toxic") - F.col("n") * share - 0.5) / F.sqrt(F.col("n") * share * (1 - share))
    counted = kept.mapInArrow(count, "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    best = counted.where((F.col("n") >= SUPPORT) & (z >= CLEAR)).orderBy(z.desc(), "feature").limit(features).collect()
    ordered = np.unique(np.concatenate([np.array([r.feature for r in best], np.int64).view(W.U), *_groups(swapped)]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            row, at = _places(W.words(b.column(2), PREFIXES), ordered)
            yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(at)], ["doc_id", "place"])

    number = {d: k for k, d in enumerate(sorted(y_of))}
    x = np.zeros((n, len(ordered)))
    for r in kept.mapInArrow(place, "doc_id long, place long").collect():  # at most sample x features, few in practice
        x[number[r.doc_id], r.place] = 1

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            found = Counter(_text_swaps(W.words(b.column(2), PREFIXES), ordered, swapped))
            yield pa.record_batch([pa.array(list(found), pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], ["change", "n"])

    swaps = kept.mapInArrow(swap, "change array<int>, n long").groupBy("change").agg(F.sum("n").alias("n")).collect()  # few differ
    model = train(x, np.array([y_of[d] for d in sorted(y_of)], float), ordered, swaps={tuple(r.change): r.n for r in swaps}, **options)
    model.groups = pairs
    return model


def scorer(spark, model: Model):
    """A function of a text column: the probability that the text is toxic."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(pa.array(text, pa.string())))

    return score


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            score = shared.value.score(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the texts that score 0.5 or more; columns unchanged."""
    return docs.where(scorer(docs.sparkSession, model)(F.col(text_col)) < 0.5)
