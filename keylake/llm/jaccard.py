"""N-gram Jaccard join by chosen paths: which texts share at least `threshold` of their word shingles.

1. Each text becomes the set of its shingles (five words; a shorter text is one shingle). Texts of equal sets form a
   copy class, by a 128-bit digest of the set, and the join works on one set of each. Classes have numbers of their own,
   so ids may repeat.
2. In each run a set goes down a tree. At every node it takes `branches` paths: for each, the token that a random order
   of that run, level and branch samples from the set. Two sets take one path together with the probability of their
   similarity, and have a path in common at `levels` levels at least with (1 - (1 - threshold)^branches)^levels; the
   number of runs follows from that and the target recall. A node of up to `bucket` sets is a leaf. A larger one splits
   if that leaves fewer pairs to compare, by the squares of its children's sizes; where it does not, its sets are mostly
   near copies of one another, and it is a leaf too, as it is at the last level.
3. A leaf's sets are compared with one another, large leaves in pairs of blocks of about `block` sets, so none is cut; the
   pairs of near copies have to be counted, as n_links is their number. Sketches first drop sets without a likely
   partner. A pair that meets in several leaves is taken in the one of least number. What remains is compared exactly,
   on whole sets. Each leaf gives link counts and a spanning star of each linked part, never its pairs.
4. Stars are joined to groups by alternating large and small stars; nothing is gathered on the driver.

Defined results: null or wordless texts have no shingles, so no links and a class of their own. Rows with null id take
no part in links and have null class_id. Rows of one id are documents of their own: those of equal sets are copies, others
are not, and then two groups may have the same class_id. Empty tables give no rows. Only the two named columns are read,
so other columns cannot clash. Ids must be integers or text that holds integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylake.llm import words as W
from keylake.llm.groups import whole_groups
from keylake.session import free_names, materialize

SLAB = 1 << 16
#: Bits at most of the broadcast filter of documents whose sets are compared: 4 MB.
SIEVE = 1 << 25
#: A node with this share of all rows, or more, counts as large.
LARGE = 1000
#: A node splits if that leaves this part of its pairs, or less.
GAIN = 0.9


def runs_for(threshold: float, levels: int, branches: int, recall: float) -> int:
    """Runs after which a pair at the threshold, split at every level, has met with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - (1 - threshold) ** branches) ** levels))


def agreement_floor(threshold: float, size: int, miss: float) -> int:
    """Sketch places in which a pair at the threshold agrees, but for this probability."""
    below, a = 0.0, 0
    while (below := below + math.comb(size, a) * threshold**a * (1 - threshold) ** (size - a)) <= miss:
        a += 1
    return a


def _sets(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds by row, shingles): the sorted distinct shingles of each row."""
    h, at = W.shingles(w, size)
    row = w.row[at]
    own = np.searchsorted(row, np.arange(w.rows + 1))
    count = w.per_row()
    first = np.searchsorted(w.row, np.arange(w.rows))
    parts = []
    for r in range(w.rows):
        if count[r] >= size:
            parts.append(np.unique(h[own[r] : own[r + 1]]))
        elif count[r]:
            short = W.Words(w.hash[first[r] : first[r] + count[r]], np.zeros(count[r], np.int64), h, h, 1, w.data)
            parts.append(W.shingles(short, int(count[r]))[0])
        else:
            parts.append(h[:0])
    bounds = np.zeros(w.rows + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return bounds, np.concatenate(parts) if parts else h[:0]


def _digests(bounds: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, of independent mixes."""
    out = []
    for salt in (W.U(0x9E3779B97F4A7C15), W.U(0xC2B2AE3D27D4EB4F)):
        total = np.concatenate([np.zeros(1, W.U), np.cumsum(W.mix(shingles ^ salt), dtype=W.U)])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _sample(bounds: np.ndarray, shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Rows x orders: the least place of a set's tokens in each random order; rows without tokens are 0."""
    out = np.zeros((len(bounds) - 1, len(multipliers)), np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    at = 0
    while at < len(full):
        to = at + 1
        while to < len(full) and bounds[full[to] + 1] - bounds[full[at]] <= SLAB:
            to += 1
        rows = full[at:to]
        lo = bounds[rows[0]]
        part, starts = shingles[lo : bounds[rows[-1] + 1]], bounds[rows] - lo
        for k, m in enumerate(multipliers):
            out[rows, k] = np.minimum.reduceat(((part * m) >> W.U(32)).astype(np.uint32), starts)
        at = to
    return out


def _signatures(docs: DataFrame, shingle: int, orders: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, orders, dtype=W.U) * W.U(2) + W.U(1)
        for b in W.slices(batches):
            bounds, s = _sets(W.words(b.column(1)), shingle)
            k1, k2 = _digests(bounds, s)
            sig = _sample(bounds, s, multipliers).view(np.int32)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(k1), pa.array(k2), pa.array(np.diff(bounds)), pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), orders).cast(pa.list_(pa.int32()))], ["doc_id", "tag", "k1", "k2", "n", "sig"])

    return docs.mapInArrow(scan, "doc_id long, tag long, k1 long, k2 long, n long, sig array<int>")


def _sized(live: DataFrame, sizes: DataFrame) -> DataFrame:
    """live with the sizes of its nodes. Rows of large nodes are not shuffled into one task: each of these holds a share
    of 1 / LARGE of the rows that sizes counts, so there are LARGE at most, and they are broadcast."""
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    is_large = F.col("size") * LARGE >= total
    large = F.broadcast(sizes.where(is_large))
    return live.join(large, "node").unionByName(live.join(large, "node", "left_anti").join(sizes.where(~is_large), "node"))


def _leaves(reps: DataFrame, runs: int, levels: int, branches: int, bucket: int) -> DataFrame:
    """(cls, node, size): the leaves of each class where it is not alone."""

    def paths(node: Column, run: int, level: int) -> Column:
        first = (run * levels + level) * branches
        return F.array(*[F.xxhash64(node, F.lit(c), F.col("sig")[first + c]) for c in range(branches)])

    def children(level: int) -> Column:
        by_run = [paths(F.col("node"), r, level) for r in range(runs)]
        chosen = by_run[0]
        for r in range(1, runs):
            chosen = F.when(F.col("run") == r, by_run[r]).otherwise(chosen)
        return F.explode(chosen)

    first = F.flatten(F.array(*[F.transform(paths(F.lit(r), r, 0), lambda x, r=r: F.struct(F.lit(r).alias("run"), x.alias("node"))) for r in range(runs)]))
    live = reps.select("cls", F.explode(first).alias("p")).select("cls", "p.run", "p.node")
    out = None
    for k in range(levels):
        sizes = materialize(live.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), f"sizes{k}")
        met = materialize(_sized(live, sizes), f"paths{k}")
        large = met.where(F.col("size") > bucket)
        last = k == levels - 1 or large.isEmpty()
        done = (met if last else met.where(F.col("size") <= bucket)).select("cls", "node", "size")
        if not last:
            tried = materialize(large.join(reps.select("cls", "sig"), "cls").select("cls", "run", F.col("node").alias("parent"), "size", children(k + 1).alias("node")), f"tried{k}")
            cost = tried.groupBy("parent", "size", "node").agg(F.count("*").alias("n")).groupBy("parent", "size").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("cost"))
            cost = materialize(cost.select(F.col("parent").alias("node"), "size", (F.col("cost") <= GAIN * F.col("size") * F.col("size")).alias("splits")), f"splits{k}")
            whole = _sized(large.drop("size"), cost.where("not splits").drop("splits")).select("cls", "node", "size")
            done = done.unionByName(whole)
            kids = tried.select("cls", "run", F.col("node").alias("child"), F.col("parent").alias("node"))
            live = _sized(kids, cost.where("splits").drop("splits")).select("cls", "run", F.col("child").alias("node"))
        out = done if out is None else out.unionByName(done)
        if last:
            break
    return out


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, values) of lists of longs."""
    column = column.combine_chunks()
    bounds = np.zeros(len(column) + 1, np.int64)
    np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), out=bounds[1:])
    return bounds, column.flatten().to_numpy(zero_copy_only=False).view(W.U)


def _fresh(earlier: tuple[np.ndarray, np.ndarray], a: int, b: int, side: np.ndarray, crossed: bool, n: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of rows a to b - 1 to compare in this leaf: of fitting sizes, without an earlier leaf in common, and across
    if two blocks meet."""
    n = n[a:b]
    pairs = np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
    bounds, values = earlier
    if bounds[b] > bounds[a]:
        pairs &= _intersections(bounds[a : b + 1] - bounds[a], values[bounds[a] : bounds[b]]) == 0
    if crossed:
        side = side[a:b]
        pairs &= side[:, None] != side[None, :]
    np.fill_diagonal(pairs, False)
    return pairs


def _intersections(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of a bounded number of sets, in slices of the tokens that more than one set has."""
    m = len(bounds) - 1
    row = np.repeat(np.arange(m), np.diff(bounds))
    _, token, count = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[token]
    row, token = row[keep], number[token[keep]]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    width = max(256, (1 << 22) // m)
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        part = np.zeros((m, min(width, int(token[-1]) + 1 - lo)), np.float32)
        part[row[a:b], token[a:b] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _roots(linked: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The least class of each row's linked part of a leaf."""
    label = own.copy()
    while True:
        least = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, least)
        if (new == label).all():
            return label
        label = new


def _likely(rows: DataFrame, orders: int, threshold: float, floor: int) -> DataFrame:
    """Rows of leaves that have a likely partner there."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_groups(batches, 3):
            sig, earlier = _matrix(t["sig"], orders), _lists(t["earlier"])
            n, side, bi, bj = (t[c].to_numpy() for c in ("n", "side", "bi", "bj"))
            keep = np.zeros(len(t), bool)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pairs = _fresh(earlier, a, b, side, bi[a] != bj[a], n, threshold)
                for i in np.flatnonzero(pairs.any(axis=1)):
                    other = np.flatnonzero(pairs[i])
                    keep[a + i] = ((sig[a + other] == sig[a + i]).sum(axis=1) >= floor).any()
            if keep.any():
                yield from t.filter(pa.array(keep)).drop_columns(["sig"]).combine_chunks().to_batches()

    return rows.mapInArrow(scan, "node long, bi int, bj int, side int, cls long, n long, copies long, earlier array<long>")


def _linked(rows: DataFrame, threshold: float) -> DataFrame:
    """(cls, linked_docs, root) of each leaf, from exact comparisons of whole sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_groups(batches, 3):
            earlier = _lists(t["earlier"])
            n, side, bi, bj, own, copies = (t[c].to_numpy() for c in ("n", "side", "bi", "bj", "cls", "copies"))
            offsets, data = W.raw(t["shingles"])
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                pairs = _fresh(earlier, a, b, side, bi[a] != bj[a], n, threshold)
                s = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), W.U)
                both = _intersections((offsets[a : b + 1] - offsets[a]) // 8, s)
                union = n[a:b, None] + n[None, a:b] - both
                linked = pairs & (both / np.maximum(union, 1) >= threshold)
                some = np.flatnonzero(linked.any(axis=1))
                if len(some):
                    out.append((own[a:b][some], (linked[some] * copies[None, a:b]).sum(axis=1), _roots(linked, own[a:b])[some]))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["cls", "linked_docs", "root"])

    return rows.mapInArrow(scan, "cls long, linked_docs long, root long")


def _sieve(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids, in 64-bit words: about ten bits an id, and SIEVE bits at most, where it lets more through."""
    size = min(SIEVE, 1 << max(10, (10 * ids.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            bits = _bits(b.column(0).to_numpy(), size)
            yield pa.record_batch([pa.array((bits >> 6).ravel()), pa.array((np.int64(1) << (bits & 63)).ravel())], ["word", "bit"])

    out = np.zeros(size >> 6, np.int64)
    for r in ids.mapInArrow(mark, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # SIEVE / 64 rows at most
        out[r.word] = r.bits
    return out


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    h = ids.astype(np.int64).view(W.U)
    return np.stack([W.mix(h ^ W.U(k * 0x51ED27)) % W.U(size) for k in range(1, 6)]).astype(np.int64)


def _packed(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(cls, shingles) of the needed classes (cls, k1, k2, rep): the sieve spares most other documents' sets a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(needed.select("rep").distinct()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for b in W.slices(batches):
            b = b.filter(pa.compute.is_valid(b.column(0)))
            bits = _bits(b.column(0).to_numpy(), len(sieve) << 6)
            b = b.filter(pa.array((((sieve[bits >> 6] >> (bits & 63)) & 1) == 1).all(axis=0)))
            bounds, s = _sets(W.words(b.column(1)), shingle)
            k1, k2 = _digests(bounds, s)
            yield pa.record_batch([b.column(0), pa.array(k1), pa.array(k2), pa.array([s[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["rep", "k1", "k2", "shingles"])

    packed = docs.mapInArrow(pack, "rep long, k1 long, k2 long, shingles binary")
    return packed.join(needed, ["rep", "k1", "k2"]).dropDuplicates(["cls"]).select("cls", "shingles")


def _passes(sieve):
    """A function of a column of hashes: does the sieve let it through?"""

    @F.arrow_udf("boolean")
    def passes(keys: pa.Array) -> pa.Array:
        held = sieve.value
        bits = _bits(keys.to_numpy(), len(held) << 6)
        return pa.array((((held[bits >> 6] >> (bits & 63)) & 1) == 1).all(axis=0))

    return passes


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(id, root): the least id of each connected part, for all ids in edges (a, b); by alternating stars."""

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        told = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return told.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = materialize(edges.where("a <> b").select("a", "b").distinct(), name)
    before = state(now)
    while before[0]:
        now = materialize(small(large(now)), name)
        if (after := state(now)) == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def jaccard_join(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.9999, levels: int = 4, branches: int = 2, bucket: int = 128, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, class_id, n_links, n_copies, copy_of.

    class_id is the least doc_id of the document's group (linked directly or through others), copy_of the least doc_id
    with the same shingle set, n_copies the documents of that set, and n_links the other documents at the threshold,
    copies among them.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("long").alias("tag"))
    return _joined(own, threshold, shingle, recall, levels, branches, bucket, block).drop("tag", "root")


def _joined(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.9999, levels: int = 4, branches: int = 2, bucket: int = 128, block: int = 512) -> DataFrame:
    """The join's rows for (doc_id, text, tag), with each row's tag and its group's number, null for rows that take no part.

    doc_id need not tell documents apart: all steps go by sets and by numbers of their classes.
    """
    runs = runs_for(threshold, levels, branches, recall)
    orders = runs * levels * branches
    floor = agreement_floor(threshold, orders, (1 - recall) / 10)
    sets = materialize(_signatures(docs, shingle, orders), "sets")
    keyed = sets.where("n > 0 and doc_id is not null")
    reps = keyed.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = materialize(reps.withColumn("cls", F.monotonically_increasing_id()), "classes")  # numbered once, as written

    leaves = _leaves(reps, runs, levels, branches, bucket)
    own = leaves.groupBy("cls").agg(F.collect_set(F.struct("node", "size")).alias("at"))  # runs x branches^levels at most
    wide = own.join(reps.select("cls", "n", "copies", "sig"), "cls")
    rows = wide.select("cls", "n", "copies", "sig", "at", F.explode("at").alias("b"))
    blocks = F.when(F.col("b.size") > max(bucket, block), F.ceil(F.col("b.size") / block)).otherwise(1).cast("int")
    rows = rows.withColumn("earlier", F.filter(F.col("at.node"), lambda x: x < F.col("b.node"))).withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.col("b.node").alias("node"), F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "cls", "n", "copies", "earlier", "sig")
    likely = materialize(_likely(rows.repartition("node", "bi", "bj").sortWithinPartitions("node", "bi", "bj"), orders, threshold, floor), "likely")

    needed = materialize(likely.select("cls").distinct().join(reps.select("cls", "k1", "k2", "rep"), "cls"), "needed")
    rows = likely.join(_packed(docs, needed, shingle), "cls").select("node", "bi", "bj", "side", "cls", "n", "copies", "earlier", "shingles")
    found = materialize(_linked(rows.repartition("node", "bi", "bj").sortWithinPartitions("node", "bi", "bj"), threshold), "linked")

    links = found.groupBy("cls").agg(F.sum("linked_docs").alias("linked_docs"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cls")
    known = reps.select("cls", "k1", "k2", "n", "rep", "copies").join(links, "cls", "left").join(groups, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    known = materialize(known, "known")
    least = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = known.where("linked_docs is not null").join(least, "root").select("k1", "k2", "n", "rep", "copies", "root", "linked_docs", "class_id").unionByName(known.where("linked_docs is null").select("k1", "k2", "n", "rep", "copies", "root", F.lit(0).cast("long").alias("linked_docs"), F.col("rep").alias("class_id")))
    linked = keyed.select("doc_id", "tag", "k1", "k2", "n").join(known, ["k1", "k2", "n"]).select("doc_id", "tag", "root", "class_id", (F.col("linked_docs") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), F.col("rep").alias("copy_of"))
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", "tag", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.col("doc_id").alias("copy_of"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but one document of each near-duplicate group: the one of least id; its columns are unchanged.

    Each row counts by itself, with or without an id, under two 64-bit hashes of its id and text, which differ in seed and
    order: documents are taken as one row only if both hashes agree, and groups are told apart by numbers, not by hashes.
    Of rows of one id, and of repeated rows, those of one group go but one. A null id is the greatest. Rows without words
    stay. Columns of any name are carried along.
    """
    first, second = free_names(docs, "first", "second")
    keyed = docs.withColumns({first: F.xxhash64(id_col, text_col), second: F.xxhash64(F.lit(0x5D588B65), text_col, id_col)})
    own = keyed.select(F.col(first).alias("doc_id"), F.col(text_col).alias("text"), F.col(second).alias("tag"))
    found = materialize(_joined(own, **options), "groups").where("n_links > 0").groupBy(F.col("doc_id").alias("a"), F.col("tag").alias("b")).agg(F.min("root").alias("root"), F.count("*").alias("n"))
    found = materialize(found, "rows")
    named = keyed.select(F.col(first).alias("a"), F.col(second).alias("b"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(first).alias("a"), F.col(second).alias("b")).alias("own")).join(found, ["a", "b"])
    least = materialize(named.groupBy("root").agg(F.min("own").alias("own")).select("own.a", "own.b"), "kept")
    gone = found.join(least, ["a", "b"], "left_anti").select("a", "b", F.lit(True).alias("gone"))
    repeated = found.where("n > 1").join(least, ["a", "b"], "left_semi").select("a", "b", F.lit(False).alias("gone"))
    known = materialize(gone.unionByName(repeated), "decided")
    # texts stay where they are but for rows that the sieve lets through: those decided on, and few others
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(known.select("a")))
    hit = _passes(shared)(F.col(first))
    (decision,) = free_names(keyed, "gone")
    met = keyed.where(hit).join(known.select(F.col("a").alias(first), F.col("b").alias(second), F.col("gone").alias(decision)), [first, second], "left")
    kept = keyed.where(~hit).unionByName(met.where(F.col(decision).isNull()).drop(decision))
    if not known.where("not gone").isEmpty():
        kept = kept.unionByName(met.where(~F.col(decision)).drop(decision).dropDuplicates([first, second]))
    return kept.select(docs.columns)


def oracle(threshold: float = 0.8, size: int = 5) -> str:
    """The same rows in DuckDB SQL, by counting shared shingles of all classes."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 OR doc_id IS NULL THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
      ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda p: array_to_string(w[p:p + {size} - 1], ' ')))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, count(*) AS copies, len(s) AS n FROM d WHERE len(s) > 0 GROUP BY s),
t AS (SELECT rep, n, copies, unnest(s) AS x FROM c),
shared AS (SELECT a.rep AS a, b.rep AS b, b.copies AS copies, count(*) AS i, any_value(a.n) + any_value(b.n) AS n
           FROM t a JOIN t b ON a.x = b.x AND a.rep <> b.rep AND least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) - 1e-9
           GROUP BY a.rep, b.rep, b.copies),
link AS (SELECT a, b, copies FROM shared WHERE i / (n - i) >= {threshold}),
reach(id, root) AS (SELECT rep, rep FROM c UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.root),
g AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
k AS (SELECT a AS rep, sum(copies) AS docs FROM link GROUP BY a)
SELECT d.doc_id, coalesce(g.root, d.doc_id) AS class_id, CAST(coalesce(k.docs, 0) + coalesce(c.copies, 1) - 1 AS BIGINT) AS n_links,
       CAST(coalesce(c.copies, 1) AS BIGINT) AS n_copies, coalesce(c.rep, d.doc_id) AS copy_of
FROM d LEFT JOIN c ON d.s = c.s AND len(d.s) > 0 LEFT JOIN g ON g.id = c.rep LEFT JOIN k ON k.rep = c.rep
"""
