"""Secret scans: patterns of known forms, and a battery of randomness tests for secrets of no known form.

Base spans are matches of three patterns: assignments of a value to a secret's name, access key ids, and hex runs.
The battery takes every other run of at least `shortest` encoding characters, cut at base spans and at each `=` that is
not padding at its end. It tests the rest whole, if one alphabet holds it, and also its pieces between `/`, `+`, `-` and
`_`, as names and paths are glued to secrets by these. For each it infers the encoding (hex, base32, base64 or its URL
form, by the characters used), and tests the sequence of symbols: chi-squared for uniform use of the alphabet, a runs test
about the alphabet's middle, and lag-one serial correlation.

What is to be refuted is that the run is text. Text is modelled by the pairs of neighbouring encoding characters of all
documents: sequences of a chain with these frequencies give the mean and spread of each statistic under text, by encoding
and length. Each test's p-value is the probability that text is as near to randomness as the run is; chi-squared has
most power, so most weight, in their Cauchy combination, which holds for dependent tests, and in which one statistic far
from randomness outweighs the others. Combined p-values go through the Benjamini-Hochberg step over all candidates of the
corpus, in strata by length, so false discoveries are controlled for each length apart. Candidates that pass and overlap
are one span.

Spans count code points, end exclusive. Null text is empty. Repeated rows each give a row; empty tables give none. Only
the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylake.llm import words as W
from keylake.session import materialize

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 or more
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Shortest run that the battery tests, unless it is told otherwise.
SHORTEST = 20
#: Between the '=' of a run; those at its end stay.
PART = re.compile(r"[^=]+(?:=+\Z)?")
#: Characters that may part the pieces of a run, together.
PARTERS = ("/", "/+", "_-", "/_-", "/+_-")
#: Sequences of the text model for each encoding, and the lengths at which their statistics are taken.
DRAWS, LENGTHS = 2000, tuple(round(8 * 1.2**k) for k in range(29))
#: Weights of chi-squared, runs and serial correlation in the combined p-value.
WEIGHTS = (0.8, 0.1, 0.1)
#: p-values are counted in steps of this much of -log10 p, up to the limit.
STEP, LIMIT = 0.05, 60.0
FALSE_DISCOVERIES = 0.05
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _runs_of(member: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Rows that have a run of so many bytes of a class (or across two rows, which the pattern sorts out)."""
    inside = member[data[offsets[0] : offsets[-1]]]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    long = edge[1::2] - edge[::2] >= least
    rows = [np.searchsorted(offsets, x[long] + offsets[0] - last, side="right") - 1 for x, last in ((edge[::2], 0), (edge[1::2], 1))]
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(*rows, strict=True)])) if long.any() else np.zeros(0, np.int64)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_HEX_CLASS = _class("0123456789abcdef")
_RUN_CLASS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_NAMES = ("passw", "secret", "token", "apikey", "api_key")


def suspects(column: pa.Array, shortest: int = SHORTEST) -> list[int]:
    """Rows that could hold a span: those with a long run of a class of bytes, or with a secret's name."""
    offsets, data = W.raw(column)
    if not len(data):
        return []
    rows = set(_runs_of(_HEX_CLASS, data, offsets, LEAST["hex"]).tolist()) | set(_runs_of(_RUN_CLASS, data, offsets, shortest).tolist())
    whole = data[offsets[0] : offsets[-1]].tobytes()
    low = whole.lower()
    for text, name in [(low, n) for n in _NAMES] + [(whole, "AKIA")]:
        at = text.find(name.encode())
        while at >= 0:
            row = int(np.searchsorted(offsets, at + offsets[0], side="right")) - 1
            rows.add(row)
            at = text.find(name.encode(), max(at + 1, int(offsets[row + 1] - offsets[0]) - len(name)))
    return sorted(rows)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def encoding(run: str) -> str | None:
    """The smallest encoding whose alphabet holds the run; None for plain numbers and words."""
    body = run.rstrip("=")
    if not body or "=" in body or body.isdigit():
        return None
    used = set(body)
    if used <= set("0123456789abcdef") or used <= set("0123456789ABCDEF"):
        return "hex"
    if used <= set(ALPHABETS["base32"]):
        return "base32"
    if used & set("+/") and used & set("-_"):
        return None
    return "base64"


def statistics(s: np.ndarray, k: int) -> np.ndarray:
    """(3, sequences): root of chi-squared, runs and serial z of sequences (in rows) of symbols below k; inf for undefined."""
    rows, n = s.shape
    counts = np.bincount((np.arange(rows)[:, None] * k + s).ravel(), minlength=rows * k).reshape(rows, k)
    chi = ((counts - n / k) ** 2).sum(axis=1) * k / n
    high = s >= k / 2
    n1 = high.sum(axis=1).astype(float)
    mean = 2 * n1 * (n - n1) / n + 1
    spread = np.sqrt(np.maximum(1e-9, (mean - 1) * (mean - 2) / max(1, n - 1)))
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    # numbers of runs are whole, so a run is as near to randomness as half a step further away
    runs_z = np.where((n1 > 0) & (n1 < n), (runs - mean + np.where(runs < mean, -0.5, 0.5)) / spread, np.inf)
    centred = s - s.mean(axis=1, keepdims=True)
    power = (centred**2).sum(axis=1)
    serial = np.where(power > 0, (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / np.maximum(power, 1e-9) * math.sqrt(n), np.inf)
    return np.stack([np.sqrt(chi), runs_z, serial])


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


class TextModel:
    """Mean and spread of the three statistics under text, by encoding and length, from counts of pairs of symbols.

    Counts are 64 x 64, by base64 symbol; - and _ count as + and /. Without any pair all symbols are alike, and nothing
    can be told from text.
    """

    def __init__(self, pairs: np.ndarray, draws: int = DRAWS, seed: int = 11):
        letters = ALPHABETS["base64"]
        self.fits: dict[str, np.ndarray] = {}
        for kind, alphabet in ALPHABETS.items():
            # symbols of either case are one where the alphabet has but one case
            fold = np.array([(alphabet.find(c) + 1 or alphabet.find(c.swapcase()) + 1) - 1 for c in letters])
            keep, k = np.flatnonzero(fold >= 0), len(alphabet)
            own = np.zeros((k, k))
            np.add.at(own, (fold[keep][:, None], fold[keep][None, :]), pairs[np.ix_(keep, keep)])
            share = own + 0.5 * (own.sum(axis=0) + 1)[None, :] / (own.sum() + k)  # a pair not seen is as likely as its second symbol, once in two
            chain = np.cumsum(share / share.sum(axis=1, keepdims=True), axis=1)
            begin = np.cumsum((own.sum(axis=1) + 1) / (own.sum() + k))
            rng = np.random.default_rng(seed)
            s = np.zeros((draws, LENGTHS[-1]), np.int64)
            s[:, 0] = np.minimum(k - 1, np.searchsorted(begin, rng.random(draws)))
            for t in range(1, LENGTHS[-1]):
                s[:, t] = np.minimum(k - 1, (chain[s[:, t - 1]] < rng.random(draws)[:, None]).sum(axis=1))
            fits = []
            for n in LENGTHS:
                found = np.clip(statistics(s[:, :n], k), -1e6, 1e6)
                fits.append((found.mean(axis=1), found.std(axis=1) + 1e-3))
            self.fits[kind] = np.array(fits)  # lengths x (mean, spread) x statistics

    def p_values(self, kind: str, n: int, found: np.ndarray) -> tuple[float, float, float]:
        """Probabilities that text of this length is as near to randomness as these statistics are."""
        place = np.clip(np.searchsorted(LENGTHS, n, side="right") - 1, 0, len(LENGTHS) - 1)
        mean, spread = self.fits[kind][place]
        even = math.sqrt(len(ALPHABETS[kind]) - 1.5) - 1.5  # two deviations below what chance gives; a more even use is no chance either
        chi = _below((even + abs(found[0] - even) - mean[0]) / spread[0])
        near = [_below((abs(x) - m) / d) - _below((-abs(x) - m) / d) if math.isfinite(x) else 1.0 for x, m, d in zip(found[1:], mean[1:], spread[1:], strict=True)]
        return chi, near[0], near[1]


def combined(ps: tuple[float, ...]) -> float:
    """The Cauchy combination of p-values."""
    total = 0.0
    for w, p in zip(WEIGHTS, ps, strict=True):
        p = min(max(p, 1e-15), 1 - 1e-15)
        total += w * (1 / (math.pi * p) if p < 1e-8 else -1 / (math.pi * (1 - p)) if p > 1 - 1e-8 else math.tan((0.5 - p) * math.pi))
    return 1 / (math.pi * total) if total > 1e8 else 0.5 - math.atan(total) / math.pi


@dataclass
class Battery:
    """The tests of runs, against a model of text."""

    model: TextModel
    shortest: int = SHORTEST

    def __post_init__(self) -> None:
        self.run = re.compile(f"[A-Za-z0-9+/_=-]{{{self.shortest},}}")
        self.cuts = [re.compile(f"[^{c}]{{{self.shortest},}}") for c in PARTERS]

    def p_value(self, run: str) -> float | None:
        """The combined p-value of a run; None if no alphabet holds it."""
        kind = encoding(run)
        if kind is None:
            return None
        alphabet = ALPHABETS[kind]
        body = run.rstrip("=")
        body = body.lower() if kind == "hex" else body.replace("-", "+").replace("_", "/")
        s = np.array([[alphabet.index(c) for c in body]])
        return combined(self.model.p_values(kind, s.shape[1], statistics(s, len(alphabet))[:, 0]))

    def _free(self, text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
        """(start, end) of the parts of runs outside the base spans, which are in order of start."""
        k, covered = 0, 0
        for m in self.run.finditer(text):
            at = m.start()
            while k < len(base) and base[k][0] < m.end():
                if base[k][0] > max(at, covered):
                    yield max(at, covered), base[k][0]
                covered = max(covered, base[k][2])
                k += 1
            if max(at, covered) < m.end():
                yield max(at, covered), m.end()

    def pieces(self, text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
        """(start, end) of what is tested: parts of runs and their pieces, of `shortest` characters at least."""
        for lo, hi in self._free(text, base):
            for part in PART.finditer(text[lo:hi]):
                if part.end() - part.start() >= self.shortest:
                    whole = part[0]
                    found = {(0, len(whole))}
                    found.update(m.span() for cut in self.cuts for m in cut.finditer(whole))
                    yield from sorted((lo + part.start() + a, lo + part.start() + b) for a, b in found)

    def candidates(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(start, end, stratum, step of -log10 p) of what was tested outside the base spans."""
        out = []
        for start, end in self.pieces(text, base):
            p = self.p_value(text[start:end])
            if p is not None:
                out.append((start, end, min(7, int(math.log2((end - start) / self.shortest) * 2)), int(min(LIMIT, -math.log10(max(p, 1e-300))) / STEP)))
        return out


_CODE = np.full(256, 255, np.uint8)
_CODE[list(ALPHABETS["base64"].encode())] = np.arange(64)
_CODE[list(b"-_")] = [62, 63]


def count_pairs(texts: DataFrame) -> np.ndarray:
    """64 x 64 counts of neighbouring encoding characters in all texts (one column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4096, np.int64)
        for b in W.slices(batches):
            offsets, data = W.raw(b.column(0))
            for lo in range(int(offsets[0]), int(offsets[-1]), W.SEGMENT):
                code = _CODE[data[lo : min(lo + W.SEGMENT + 1, int(offsets[-1]))]].astype(np.int64)
                both = (code[:-1] < 64) & (code[1:] < 64)
                begins = offsets[np.searchsorted(offsets, lo + 1) : np.searchsorted(offsets, lo + len(code))] - lo - 1
                both[begins[begins < len(both)]] = False  # the last character of one text and the first of the next
                total += np.bincount((code[:-1] * 64 + code[1:])[both], minlength=4096)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["pair", "n"])

    out = np.zeros(4096, np.int64)
    for r in texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 4096 rows at most
        out[r.pair] = r.n
    return out.reshape(64, 64)


def fit(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> Battery:
    """The battery whose model of text comes from these documents, all of them."""
    return Battery(TextModel(count_pairs(docs.select(F.col(text_col)))), shortest)


def passing(tested: list[tuple[int, int, int, int]], least: dict[int, int]) -> list[tuple[int, int, int]]:
    """(start, 3, end) of the candidates that pass these thresholds; those that overlap are one."""
    out: list[tuple[int, int, int]] = []
    for a, b, stratum, step in sorted(tested):
        if step < least.get(stratum, 1 << 30):
            continue
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], 3, max(b, out[-1][2]))
        else:
            out.append((a, 3, b))
    return out


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_CANDIDATE = "array<struct<start:int,end:int,stratum:int,step:int>>"


def _scan(shared):
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    candidate = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("step", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        battery = shared.value
        for b in batches:
            bases, tested = [[]] * b.num_rows, [[]] * b.num_rows
            for r in suspects(b.column(1), battery.shortest):
                text = b.column(1)[r].as_py() or ""
                base = base_spans(text)
                bases[r] = [{"start": s, "kind": k, "end": e} for s, k, e in base]
                tested[r] = [dict(zip(("start", "end", "stratum", "step"), c, strict=True)) for c in battery.candidates(text, base)]
            yield pa.record_batch([b.column(0), pa.array(bases, span), pa.array(tested, candidate)], ["doc_id", "base", "tested"])

    return scan


def thresholds(counts: dict[tuple[int, int], int], q: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """The least step that is taken in each stratum: Benjamini-Hochberg on counts by (stratum, step)."""
    out = {}
    for stratum in {s for s, _ in counts}:
        steps = sorted((k, n) for (s, k), n in counts.items() if s == stratum)
        total, above = sum(n for _, n in steps), 0
        for step, n in reversed(steps):
            above += n
            if 10 ** (-step * STEP) * total <= q * above:
                out[stratum] = step
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = FALSE_DISCOVERIES, shortest: int = SHORTEST) -> DataFrame:
    """One row per document row: doc_id and spans, an array of (start, kind, end) by start and kind; kind numbers KINDS."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, shortest=shortest))
    found = materialize(docs.mapInArrow(_scan(shared), f"doc_id long, base {_SPAN}, tested {_CANDIDATE}"), "secrets")
    counted = found.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.step").agg(F.count("*").alias("n"))
    least = thresholds({(r.stratum, r.step): r.n for r in counted.collect()}, q)  # 8 x LIMIT / STEP rows at most

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tested = [[{"start": a, "kind": k, "end": e} for a, k, e in passing([tuple(t.values()) for t in row], least)] if row else [] for row in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(tested, b.column(1).type)], ["doc_id", "base", "random"])

    return found.mapInArrow(taken, f"doc_id long, base {_SPAN}, random {_SPAN}").select("doc_id", F.array_sort(F.concat("base", "random")).alias("spans"))


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (text), n_random."""
    name = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scan(docs, **options).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count(3).alias("n_random"))


def mask_spans(text: str, battery: Battery, least: dict[int, int], mask: str) -> str:
    """text with its base spans, and the candidates that pass these thresholds, replaced."""
    base = base_spans(text)
    spans = base + passing(battery.candidates(text, base), least)
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mask: str = "<secret>", q: float = FALSE_DISCOVERIES, shortest: int = SHORTEST) -> DataFrame:
    """docs with every secret's span masked in the text; other rows and columns are unchanged, but n_chars follows
    the text, if there is one."""
    battery = fit(docs, text_col, shortest)
    fitted = docs.sparkSession.sparkContext.broadcast(battery)
    counted = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(fitted), f"doc_id long, base {_SPAN}, tested {_CANDIDATE}")
    counted = counted.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.step").agg(F.count("*").alias("n"))
    least = thresholds({(r.stratum, r.step): r.n for r in counted.collect()}, q)
    shared = docs.sparkSession.sparkContext.broadcast((battery, least))

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        battery, least = shared.value
        out = text.copy()
        for r in suspects(pa.array(text, pa.string()), battery.shortest):
            if text.iloc[r] is not None:
                out.iloc[r] = mask_spans(text.iloc[r], battery, least, mask)
        return out

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    return out.withColumn("n_chars", F.coalesce(F.char_length(text_col).cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
