import json
import random

from pyspark.sql import functions as F

from keylake.functions import keys as K
from keylake.functions import text as T
from keylake.operators import graph, relations, snapshots, spacing, stats
from keylake.streaming import streams


def test_big_integers(spark):
    rng = random.Random(4)
    values = [1, 8, 255, 256, 2**64, *[rng.getrandbits(n) for n in (7, 60, 1024, 2048)]]
    rows = spark.createDataFrame([(str(k), f"0x{v:X}") for k, v in enumerate(values)], "id string, h string").withColumn("c", K.hex_canon(F.col("h")))
    out = {int(r.id): r for r in rows.select("id", "c", K.bit_length(F.col("c")).alias("bits"), K.hex_mod(F.col("c"), 167).alias("m")).collect()}
    for k, v in enumerate(values):
        assert (out[k].c, out[k].bits, out[k].m) == (f"{v:x}", v.bit_length(), v % 167)


def test_weak_key_flag_positive_by_construction(spark):
    m = 1
    for p in K.PRIMES:
        m *= p
    weak = pow(K.GENERATOR, 12345, m) + m * 7
    rows = spark.createDataFrame([(f"{weak:x}",), (f"{m * 3 + 2:x}",)], "h string")
    assert [r[0] for r in rows.select(K.weak_key_flag(F.col("h"))).collect()] == [True, False]


def test_snapshots_of_three_days(spark):
    rows = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "b"), ("d2", "c"), ("d3", "a"), ("d3", "c")], "snap string, fprint string")
    out = snapshots.snapshot_diff(rows).collect()
    pick = lambda f: sorted((r.snap, r.fprint) for r in out if r[f])
    assert pick("first_seen") == [("d1", "a"), ("d1", "b"), ("d2", "c")]
    assert pick("new") == [("d1", "a"), ("d1", "b"), ("d2", "c"), ("d3", "a")]
    assert pick("lost") == [("d2", "a"), ("d3", "b")]
    assert pick("same") == [("d2", "b"), ("d3", "c")]


def test_dependents_in_a_cycle_and_trust(spark):
    deps = spark.createDataFrame([("app", "lib"), ("lib", "core"), ("core", "lib")], "library string, needs string")
    seeds = spark.createDataFrame([("core",)], "library string")
    assert {(r.library, r.level) for r in graph.affected(deps, seeds).collect()} == {("lib", 1), ("app", 2)}
    certs = spark.createDataFrame([("I1", "R"), ("I2", "I1"), ("X", "X")], "subject string, issuer string")
    roots = spark.createDataFrame([("R",)], "subject string")
    assert {(r.subject, r.level) for r in graph.trust_levels(certs, roots).collect()} == {("R", 0), ("I1", 1), ("I2", 2)}


def test_chains_of_any_length(spark):
    n = 70
    few = spark.range(1, n + 1).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst")).coalesce(1)
    deps, start = few.select(F.col("dst").alias("library"), F.col("src").alias("needs")), spark.createDataFrame([(0,)], "node long")
    assert {(r.library, r.level) for r in graph.affected(deps, start.withColumnRenamed("node", "library")).collect()} == {(k, k) for k in range(1, n + 1)}
    assert {(r.node, r.parent, r.level) for r in graph.paths(few, start).collect()} == {(0, None, 0), *((k, k - 1, k) for k in range(1, n + 1))}
    assert graph.reach(few, start, 5).count() == 6


def test_association_history(spark):
    seen = spark.createDataFrame([("u", "k1", 1), ("u", "k2", 1), ("u", "k2", 2), ("u", "k1", 3), ("u", "k2", 3)], "user string, key string, at int")
    out = {(r.key, r.found_at, r.lost_at) for r in relations.assoc_history(seen, "user", "key", "at").collect()}
    assert out == {("k1", 1, 2), ("k1", 3, None), ("k2", 1, None)}


def test_sizes_and_versions(spark):
    row = spark.createDataFrame([("12.5 MB", "1:2.0")], "s string, v string").select(T.size_bytes(F.col("s")), T.version_parts(F.col("v"))).first()
    assert tuple(row) == (12.5 * 2**20, [1, 2])


def test_stream_equals_batch(spark, tmp_path):
    spark.range(100).select((F.col("id") % 7).alias("k"), F.timestamp_seconds(F.col("id") * 30).alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, ts timestamp").parquet(f"{tmp_path}/in")
    q = streams.stream_first_seen(stream, "k").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 7
    q = streams.stream_trailing_counts(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 500


def test_spacing_over_many_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(5000)) for _ in range(4000)] + [("a", None)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = spacing.min_spacing(spark.createDataFrame(rows, "g string, t long"), 70, "g", "t").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = []
    for g in ("a", "b", None):
        last = None
        for t in sorted(t for k, t in rows if k == g and t is not None):
            if last is None or t - last >= 70:
                want.append((g, t))
                last = t
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_spacing_joins_no_batch_twice_and_no_frame_shrinks(spark, monkeypatch):
    """A chunk of many batches: each row is put into a table of whole chunks once. No window goes to the end of its rows."""
    import pyarrow as pa

    batch = lambda key, chunk, lo, hi: pa.record_batch({"key": [key] * (hi - lo), "chunk": [chunk] * (hi - lo), "t": list(range(lo, hi))})
    one = [batch("a", 0, k, k + 5) for k in range(0, 500, 5)]
    mixed = pa.Table.from_batches([batch("a", 0, 500, 503), batch("a", 1, 600, 602), batch("b", 1, 0, 4)]).combine_chunks().to_batches()
    seen = []
    starts = spacing._starts
    monkeypatch.setattr(spacing, "_starts", lambda t: seen.append(len(t)) or starts(t))
    got = [(t.num_rows, [t["t"][int(k)].as_py() for k in s]) for t, s in spacing._whole_chunks(iter([*one, *mixed, batch("b", 1, 4, 6), batch("c", 0, 1, 2)]))]
    assert got == [(505, [0, 600]), (6, [0]), (1, [1])]
    assert sum(seen) <= 3 * 512
    entries = spark.createDataFrame([("a", 0, 5, 12), ("a", 1, 13, 30)], "key string, chunk long, t long, free long")
    chunks = spark.createDataFrame([("a", 0, 5, 1, 13), ("a", 1, 13, None, None)], "key string, chunk long, first long, next_chunk long, next_first long")
    targets = spacing._targets(entries, chunks)
    assert "UnboundedFollowing" not in targets._jdf.queryExecution().optimizedPlan().toString().replace("unboundedfollowing", "UnboundedFollowing")
    assert [tuple(r) for r in targets.collect()] == [("a", 0, 12, 13)]


def test_spacing_of_one_large_group(spark):
    """A group of 10^5 times in many chunks, with gaps over several of them, and chains that cross every bound."""
    rng = random.Random(5)
    times = sorted({rng.randrange(-2_000_000, 5_000_000) for _ in range(100_000)} - set(range(1_000_000, 1_400_000))) + [9_000_000, 9_000_001]
    frame = spark.createDataFrame([("only", t) for t in times], "g string, t long")
    for seconds, length in ((977, 2000), (977, 977), (3, None), (40_000, None)):
        want, free = [], None
        for t in times:
            if free is None or t >= free:
                want.append(t)
                free = t + seconds
        found = spacing.min_spacing(frame, seconds, "g", "t", length)
        assert sorted(r.t for r in found.collect()) == want
    assert spacing.min_spacing(frame.limit(0), 5, "g", "t").count() == 0


def test_deep_trees(spark):
    """A chain of 1000 nodes in a few rounds, and nested documents of two seeds with odd names."""
    n = 1000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    seeds = spark.createDataFrame([(0,), (990,)], "node long")
    found = graph.paths(edges, seeds)
    assert {(r.seed, r.node, r.level) for r in found.collect()} == {(s, k, k - s) for s in (0, 990) for k in range(s, n + 1)}
    tree, whole = {r.seed: json.loads(r.tree) for r in graph.to_tree_json(found.where("level <= 400")).collect()}, {}
    for k in range(400, -1, -1):
        whole = {str(k): whole}
    assert tree[0] == whole
    assert {(r.node, r.level) for r in graph.reach(edges, seeds).collect()} == {(k, k if k < 990 else k - 990) for k in range(n + 1)}
    names = [("a", "b"), ("a", "a-b"), ("b", 'q"1'), ("b", "x"), ("a-b", "z"), ("lone", "l2")]
    trees = graph.to_tree_json(graph.paths(spark.createDataFrame(names, "src string, dst string"), spark.createDataFrame([("a",), ("b",), ("none",)], "node string")))
    assert {r.seed: json.loads(r.tree) for r in trees.collect()} == {"a": {"a": {"b": {'q"1': {}, "x": {}}, "a-b": {"z": {}}}}, "b": {"b": {'q"1': {}, "x": {}}}, "none": {"none": {}}}
    two = [("a", "c"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "d")]
    assert {(r.node, r.level) for r in graph.reach(spark.createDataFrame(two, "src string, dst string"), spark.createDataFrame([("b",)], "node string")).collect()} == {("b", 0), ("c", 1), ("d", 2), ("a", 3)}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("p", "q")], "src string, dst string")
    assert {(r.node, r.level) for r in graph.reach(ring, spark.createDataFrame([("b",)], "node string")).collect()} == {("b", 0), ("c", 1), ("a", 2)}


def test_snapshot_differences_of_odd_rows(spark):
    rows = [("d1", "k"), ("d1", "k"), ("d3", "k"), ("d2", None), (None, "k"), ("d2", "m"), ("d3", "m")]
    got = snapshots.snapshot_diff(spark.createDataFrame(rows, "snap string, fprint string"))
    found = sorted((r.snap, str(r.fprint), r.first_seen, r.new, r.same, r.lost) for r in got.collect())
    assert found == [("d1", "k", True, True, False, False), ("d2", "None", True, True, False, False), ("d2", "k", False, False, False, True), ("d2", "m", True, True, False, False), ("d3", "None", False, False, False, True), ("d3", "k", False, True, False, False), ("d3", "m", False, False, True, False)]
    assert snapshots.snapshot_diff(spark.createDataFrame([], "snap string, fprint string")).count() == 0


def test_joins_of_nulls_ties_and_empty_tables(spark):
    keys = spark.createDataFrame([(1, None), (2, "x"), (None, "x"), (2, "x")], "k int, v string")
    none = keys.limit(0)
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(relations.in_snapshot(keys, keys, "k")) == ["(1, None)", "(2, 'x')", "(2, 'x')"] and rows(relations.in_snapshot(keys, none, "k")) == []
    assert rows(relations.missing_from(keys, keys, "k")) == ["(None, 'x')"] and len(rows(relations.missing_from(keys, none, "k"))) == 4
    assert rows(relations.attached_hosts(keys.select("k"), keys.select("k", F.col("v").alias("ip")), "k")) == ["(1, None)", "(2, 'x')", "(None, None)"]
    assert rows(relations.compare_rows(keys, keys.where("k = 1"), "k", ["v"], {"v": "none"}, {"v": F.upper})) == ["(1, True)"]
    assert rows(relations.reflag(keys.withColumn("flagged", F.col("v")), F.lit("x"))) == ["(1, None, 'x')"]
    assert rows(relations.key_packages(keys.select("k"), none, "k", "v")) == ["(1, [], 0)", "(2, [], 0)", "(2, [], 0)", "(None, [], 0)"]
    assert rows(relations.select_datasets(keys, "k", [1], [(2, 3)])) == ["(1, None)", "(2, 'x')", "(2, 'x')"] and rows(relations.select_datasets(keys, "k")) == []
    assert rows(stats.count(none)) == ["(0,)"] and rows(stats.grid_hist(none, F.col("k"), 0, 2, F.lit(True))) == ["(0, 0, 0, -1.0)", "(1, 0, 0, -1.0)"]
    assert rows(stats.mismatch_audit(keys, "k", F.col("v") == "x", F.lit(True))) == ["(1,)"]
    assert rows(snapshots.order_by_bigint(spark.createDataFrame([("ff",), ("1",), (None,), ("100",)], "h string"), "h")) == ["('1', 0)", "('100', 2)", "('ff', 1)", "(None, 3)"]

