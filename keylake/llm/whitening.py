"""Whitening of embeddings by an incremental eigendecomposition.

Each task keeps the spectrum of its rows: their number, mean, and the eigenvalues and eigenvectors of their centred
scatter. A row is a rank-one update of it: the new eigenvalues are the roots of a secular equation, solved for all roots
at once between their poles; components that hardly take part, and equal poles, are deflated first, and the weights are
recomputed from the roots, so that eigenvectors stay orthogonal. Equal rows of a batch are one update of their weight.
Tasks' spectra are combined in a tree: a spectrum takes another's mean and eigenpairs as rank-one updates of its own.
Last, a Rayleigh-Ritz step over all rows, a sum over tasks, makes the vectors exact: the covariance is projected on the
span, its small eigenproblem is solved, and where the span is not the whole space, what the vectors' residuals point to
is added until they vanish.

Defined results: rows with null id or a vector that is null or holds null or non-finite entries take no part; a shorter
vector counts as padded with zeros (which become the offset). Entries beyond 2^53 stop there. A component without
variance, to rounding, can't be whitened and gives no rows: so equal vectors, one vector or none give none. Repeated rows
count as often as they occur, and each gives its rows. A deviation beyond 64 bits stops at the end of the range. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylake.llm import vectors as V
from keylake.session import materialize

EPS = np.finfo(np.float64).eps
#: Wider vectors keep so many directions while rows are added; the refinement finds the rest.
RANK = 256
#: Spectra that a task of the tree combines.
FAN = 16
#: Rounds of the refinement; each adds the residuals' directions to the span.
ROUNDS = 100


def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """d[j] - root[i] for the roots of 1 + rho * sum(z2 / (d - x)), rows by root; d rises strictly, z2 is positive with sum 1.

    The i-th root lies between d[i] and d[i+1], the last at most rho beyond the last pole; each is found as a distance from
    the nearer pole. Iterations match value and slope of both sides by two poles, and halve where they would leave.
    """
    k = len(d)
    gap = np.append(np.diff(d), rho)
    inner = np.arange(k - 1)
    mid = d[:-1] + gap[:-1] / 2
    right = np.zeros(k, bool)
    right[:-1] = 1 / rho + (z2 / (d[None, :] - mid[:, None])).sum(axis=1) < 0
    delta = d[None, :] - d[np.arange(k) + right][:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    high[-1] = rho
    x = (low + high) / 2
    left = np.tri(k, dtype=bool)
    for _ in range(80):
        e = delta - x[:, None]
        g = z2 / e
        slope = g / e
        psi, dpsi = (g * left).sum(axis=1), (slope * left).sum(axis=1)
        phi, dphi = g.sum(axis=1) - psi, slope.sum(axis=1) - dpsi
        f = 1 / rho + psi + phi
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        with np.errstate(all="ignore"):
            e1 = e[np.arange(k), np.arange(k)]
            step = e1 + e1**2 * dpsi / (f - e1 * dpsi)
            e2 = e[inner, inner + 1]
            c = f[:-1] - e1[:-1] * dpsi[:-1] - e2 * dphi[:-1]
            a = (e1[:-1] + e2) * f[:-1] - e1[:-1] * e2 * (dpsi + dphi)[:-1]
            b = e1[:-1] * e2 * f[:-1]
            root = np.sqrt(np.maximum(a**2 - 4 * b * c, 0))
            step[:-1] = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
            new = x + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done = (np.abs(new - x) <= 2 * EPS * np.abs(new)) | (np.abs(f) <= 2 * EPS * (1 / rho + np.abs(psi) + np.abs(phi)))
        x = np.where(np.abs(f) <= 2 * EPS * (1 / rho + np.abs(psi) + np.abs(phi)), x, new)
        if done.all():
            break
    return delta - x[:, None]


def rank_one(values: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of diag(values) + rho * z z'; values rise, rho is positive."""
    k, size = len(values), float(z @ z)
    turn = np.eye(k)
    if not size * rho > 0:
        return values, turn
    z, rho = z / np.sqrt(size), rho * size
    values = values.copy()
    tolerance = 8 * EPS * max(values[-1], rho)
    live = np.flatnonzero(rho * np.abs(z) > tolerance)
    # poles that are equal but for rounding: a rotation moves the weight of one to the other
    near = np.flatnonzero(np.abs(np.diff(values[live]) * z[live[:-1]] * z[live[1:]]) <= tolerance * (z[live[:-1]] ** 2 + z[live[1:]] ** 2))
    if len(near):
        kept = [int(live[0])]
        for i in live[1:].tolist():
            p = kept[-1]
            tau = float(np.hypot(z[p], z[i]))
            c, s = z[i] / tau, z[p] / tau
            if abs((values[i] - values[p]) * c * s) <= tolerance:
                turn[:, [p, i]] = turn[:, [p, i]] @ np.array([[c, s], [-s, c]])
                values[p], values[i] = values[p] * c * c + values[i] * s * s, values[p] * s * s + values[i] * c * c
                z[p], z[i] = 0.0, tau
                kept.pop()
            kept.append(i)
        live = np.array(kept)
    if len(live):
        d = values[live]
        z2 = z[live] ** 2
        total = z2.sum()
        e = _roots(d, z2 / total, rho * total)  # rows by root
        n = len(live)
        apart = d[None, :] - d[:, None]
        divisor = np.where(np.tri(n, k=-1, dtype=bool).T, apart, np.vstack([apart[1:], -np.ones((1, n))]))
        weight = np.sqrt(np.maximum(np.prod(e / divisor, axis=0), 0)) * np.where(z[live] < 0, -1, 1)
        w = weight[:, None] / e.T
        turn[:, live] = turn[:, live] @ (w / np.sqrt((w**2).sum(axis=0)))
        values[live] = d - e[np.arange(n), np.arange(n)]
    order = np.argsort(values, kind="stable")
    return values[order], turn[:, order]


class Spectrum:
    """Number, mean and centred scatter of rows; the scatter as eigenvalues (rising) and eigenvectors (columns)."""

    def __init__(self, width: int, rank: int = RANK):
        self.n, self.mean, self.rank = 0.0, np.zeros(width), min(rank, width)
        self.values, self.basis = np.zeros(0), np.zeros((width, 0))

    def turn(self, v: np.ndarray, rho: float) -> None:
        """Add rho * v v' to the scatter."""
        size = float(np.sqrt(v @ v))
        if not size * rho > 0:
            return
        z = self.basis.T @ v
        rest = v - self.basis @ z
        again = self.basis.T @ rest
        z, rest = z + again, rest - self.basis @ again
        over = float(np.sqrt(rest @ rest))
        values, basis = self.values, self.basis
        if over > 1e-12 * size and len(values) < len(v):
            values, z = np.append(0.0, values), np.append(over, z)
            basis = np.column_stack([rest / over, basis])
        values, w = rank_one(values, z, rho)
        self.values, self.basis = np.maximum(values, 0)[-self.rank :], (basis @ w)[:, -self.rank :]

    def add(self, x: np.ndarray, weight: float = 1.0) -> None:
        v = x - self.mean
        if self.n:
            self.turn(v, self.n * weight / (self.n + weight))
        self.n += weight
        self.mean = self.mean + v * (weight / self.n)

    def merge(self, other: Spectrum) -> None:
        """Take another spectrum's rows."""
        if not other.n:
            return
        v = other.mean - self.mean
        if self.n:
            self.turn(v, self.n * other.n / (self.n + other.n))
        for value, u in zip(other.values, other.basis.T, strict=True):
            self.turn(u, float(value))
        self.n += other.n
        self.mean = self.mean + v * (other.n / self.n)

    def pack(self) -> bytes:
        return np.concatenate([[self.n, len(self.mean), self.rank, len(self.values)], self.mean, self.values, self.basis.ravel()]).astype("<f8").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Spectrum:
        x = np.frombuffer(raw, "<f8")
        width, k = int(x[1]), int(x[3])
        out = cls(width, int(x[2]))
        out.n, out.mean, out.values, out.basis = float(x[0]), x[4 : 4 + width].copy(), x[4 + width : 4 + width + k].copy(), x[4 + width + k :].reshape(width, k).copy()
        return out


def _whole(column: pa.ListArray, width: int, offset: int) -> np.ndarray:
    """Rows of whole numbers: floored entries and the offset."""
    return np.clip(V.Ragged.of([column]).dense(width), -(2.0**53), 2.0**53).astype(np.int64) + offset


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, V.AT_ONCE // max(1, width))
    for b in batches:
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def spectrum(rows: DataFrame, width: int, offset: int, n: int) -> tuple[Spectrum, list[int]]:
    """The spectrum of rows (id, v), by tasks and then by a tree of combinations, and the sums of their whole numbers."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Spectrum(width), np.zeros((2, width), np.int64)
        for b in _pieces(batches, width):
            x, count = np.unique(_whole(b.column(1), width, offset), axis=0, return_counts=True)
            sums += np.stack([((x >> 32) * count[:, None]).sum(axis=0), ((x & 0xFFFFFFFF) * count[:, None]).sum(axis=0)])
            for row, k in zip(x.astype(np.float64), count.tolist(), strict=True):
                own.add(row, k)
        if own.n:
            yield pa.record_batch([pa.array([own.pack()], pa.binary()), pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], ["spectrum", "sums"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, Spectrum] = {}  # of one node at a time but at its ends
        for b in batches:
            for node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for other in [o for o in nodes if o != node]:
                    yield pa.record_batch([pa.array([other], pa.int64()), pa.array([nodes.pop(other).pack()], pa.binary())], ["node", "spectrum"])
                if node in nodes:
                    nodes[node].merge(Spectrum.unpack(raw))
                else:
                    nodes[node] = Spectrum.unpack(raw)
        for node, s in nodes.items():
            yield pa.record_batch([pa.array([node], pa.int64()), pa.array([s.pack()], pa.binary())], ["node", "spectrum"])

    parts = materialize(V.parallel(rows, n).mapInArrow(gather, "spectrum binary, sums array<long>"), "spectra")
    sums = {r.pos: int(r.s) for r in parts.select(F.posexplode("sums").alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()}  # twice the width
    nodes, left = parts.select((F.monotonically_increasing_id()).alias("node"), "spectrum"), parts.count()
    nodes = nodes.withColumn("node", F.pmod(F.xxhash64("node"), F.lit(max(1, -(-left // FAN)))).cast("long"))
    while True:
        groups = max(1, -(-left // FAN))
        nodes = materialize(nodes.repartition(groups, "node").sortWithinPartitions("node").mapInArrow(combine, "node long, spectrum binary"), "spectra")
        left = groups
        if groups == 1:
            break
        nodes = nodes.withColumn("node", F.floor(F.col("node") / FAN))
    return Spectrum.unpack(bytes(nodes.first().spectrum)), [(sums[j] << 32) + sums[width + j] for j in range(width)]


class Centre:
    """Rows as differences from the mean of all: exact whole numbers from its floor, less a fraction below one."""

    def __init__(self, n: int, sums: list[int], offset: int):
        self.n, self.sums, self.offset = n, sums, offset
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([float(Fraction(s % n, n)) for s in sums])

    def rows(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        whole = _whole(column, len(self.sums), self.offset)
        return whole, (whole - self.floor) - self.rest

    def deviations(self, whole: np.ndarray, centred: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - sum)^2. Whole numbers wrap, so that sums within 64 bits are exact."""
        most = 2.0**63 - 1
        about = (centred**2).sum(axis=1) * float(self.n) ** 2
        sums = np.array([s % 2**64 for s in self.sums], np.uint64)
        d = whole.astype(np.uint64) * np.uint64(self.n % 2**64) - sums
        out = (d * d).sum(axis=1, dtype=np.uint64).astype(np.int64)
        out[about > most * (1 + 1e-9)] = 2**63 - 1
        for r in np.flatnonzero(np.abs(about - most) <= most * 1e-9).tolist():
            out[r] = min(2**63 - 1, sum((self.n * int(x) - s) ** 2 for x, s in zip(whole[r], self.sums, strict=True)))
        return out


def _sum_cells(rows: DataFrame, task, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over tasks of an array of a fixed shape; task(batches) gives one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = task(batches).ravel()
        yield pa.record_batch([pa.array(np.arange(len(x))), pa.array(x)], ["cell", "x"])

    out = np.zeros(int(np.prod(shape)))
    for r in rows.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        out[r.cell] = r.x
    return out.reshape(shape)


def refine(rows: DataFrame, start: np.ndarray, centre: Centre, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, eigenvectors, trace) of the covariance: Rayleigh-Ritz steps from a span."""
    width = len(centre.sums)
    basis = np.linalg.qr(start)[0] if start.size else np.zeros((width, 0))
    for _ in range(ROUNDS):
        k = basis.shape[1]

        def project(batches: Iterator[pa.RecordBatch], basis: np.ndarray = basis) -> np.ndarray:
            out = np.zeros((width, basis.shape[1] + 1))  # the last column holds squares
            for b in _pieces(batches, width):
                y = centre.rows(b.column(1))[1]
                out[:, :-1] += y.T @ (y @ basis)
                out[:, -1] += (y**2).sum(axis=0)
            return out

        found = _sum_cells(rows, project, (width, k + 1)) / centre.n
        image, trace = found[:, :-1], float(found[:, -1].sum())
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = basis @ turn
        count = min(components, k)
        residual = (image @ turn - vectors * values)[:, :count]
        if k == width or not k or np.abs(residual).max() <= 64 * EPS * max(values[0], 0):
            break
        if k > 4 * RANK:
            vectors = vectors[:, :RANK]
        basis = np.linalg.qr(np.column_stack([vectors, residual]))[0]
    else:
        raise ArithmeticError("the leading components are too close to be told apart")
    sound = values[:count] > width * EPS * trace
    vectors = vectors[:, :count][:, sound]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[:count][sound], vectors * signs, trace


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each sound row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & V.sound(vector_col)).select(F.col(id_col).cast("long").alias("id"), V.floored(vector_col, scale).alias("v"))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not width:
        return spark.createDataFrame([], schema)
    found, sums = spectrum(rows, width, offset, n)
    centre = Centre(n, sums, offset)
    values, basis, trace = refine(rows, found.basis, centre, components)
    count = len(values)
    if not count:
        return spark.createDataFrame([], schema)
    unit = basis / np.sqrt(values)

    def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((count + 1, count))  # the last row holds sums
        for b in _pieces(batches, width):
            w = centre.rows(b.column(1))[1] @ unit
            out[:-1] += w.T @ w
            out[-1] += w.sum(axis=0)
        return out

    moments = _sum_cells(rows, squares, (count + 1, count)) / n
    error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(count)).max())
    explained = values / trace

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, width):
            whole, centred = centre.rows(b.column(1))
            m = len(whole)
            columns = [
                pa.array(np.repeat(b.column(0).to_numpy(), count)),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                pa.array(np.full(m * count, n)),
                pa.array(np.repeat(centre.deviations(whole, centred), count)),
                pa.array((centred @ unit).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * count, error)),
            ]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, schema)
