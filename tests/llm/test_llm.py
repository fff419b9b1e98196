"""The ten operators against brute force, exact round trips and held-out labels, and on odd tables."""

import hashlib
import itertools
import math
import os
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from keylake.llm import byte_bpe, chat, decontaminate, jaccard, language, quality, queries, secret_scan, topk, toxicity, url_filter
from keylake.llm import vectors as V
from keylake.llm import words as W

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns named like outputs."""
    long = " ".join(f"w{k % 997}x{k % 89}" for k in range(60_000))
    rows = [(1, None, None, None, None, 1, 0.5), (2, "", "en", "s", 0, 1, 0.5), (3, "one two", "en", "s", 7, 1, 0.5), (3, "one two", "en", "s", 7, 1, 0.5), (None, "no id here at all", None, "s", 3, 1, 0.5), (5, long, "en", "s", len(long), 1, 0.5), (6, long + " end", "en", "s", len(long), 1, 0.5), (7, "!!! ... 123", "de", "s", 9, 1, 0.5)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    plain = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()))
    assert plain(got) == plain(want)


def test_words_across_segments(monkeypatch):
    texts = ["Ab, cd EF", None, "", "çA-b" * 50, "x" * 300, "q", "r"]
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    for size in (1 << 20, 16):
        monkeypatch.setattr(W, "SEGMENT", size)
        w = W.words(pa.array(texts, pa.string()))
        assert [[x.decode() for x in w.text(*np.searchsorted(w.row, [r, r + 1]))] for r in range(len(texts))] == want


def test_every_operator_on_odd_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two"), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    ranks, pattern = byte_bpe.read_ranks(P.path(queries.RANKS)), P.PATTERN
    for d in (odd_docs(spark), odd_docs(spark).limit(0)):
        n = d.count()
        assert decontaminate.decontaminate(d, bench).count() == n
        assert decontaminate.decontaminate(d, bench, block_bytes=1).count() == n
        assert decontaminate.decontaminate(d, bench.limit(0)).where("contaminated").count() == 0
        assert secret_scan.report(d).count() == n and secret_scan.redact(d).count() == n
        assert toxicity.score_documents(d, toxicity.fit(d, labels)).count() == n
        assert byte_bpe.digests(d, ranks, pattern).count() == n
        assert language.identify(d, language.fit(d, epochs=1)).count() == n
        assert quality.resample(d, labels).count() == n
        found = {r.doc_id: r for r in jaccard.jaccard_join(d).collect()}
        assert jaccard.keep_one(d).count() == (6 if n else 0)
        assert jaccard.keep_one(d).columns == d.columns
        if n:
            assert found[5].class_id == found[6].class_id == 5 and found[5].n_links == 1
            assert found[3].n_copies == 2 and found[2].n_links == 0


def _shingle_sets(rows):
    out = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def _groups_of(rows, threshold=0.8):
    """(number of links, group) of each row with words, by comparing all pairs."""
    sets, links, group = _shingle_sets(rows), [0] * len(rows), list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i if a else 0):
            if sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                old, new = sorted((group[i], group[j]), reverse=True)
                group = [new if g == old else g for g in group]
    return links, group


def _planted(rng):
    """Clusters of near copies, texts that share a passage, ids that repeat with equal and with other texts."""
    vocabulary = [f"w{k}" for k in range(300)]
    passage, rows = " ".join(rng.choices(vocabulary, k=30)), []
    for size in (1, 2, 8, 40, 40, 3, 1, 2):
        base = rng.choices(vocabulary, k=60)
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((len(rows) if rng.random() < 0.9 else rng.randrange(len(rows) + 1), " ".join(text)))
    rows += [(1000 + k, passage + " " + " ".join(rng.choices(vocabulary, k=40))) for k in range(50)]
    longer = " ".join(rng.choices(vocabulary, k=36))
    return rows + [(2001, "one text of a repeated id and its words"), (2001, longer), (2002, longer + " end"), (2003, None), (2003, ""), (2004, "x y"), (2004, "x y"), (2005, "x y")]


@pytest.mark.parametrize("options", [{}, {"bucket": 2, "block": 3}, {"bucket": 4, "levels": 2}])
def test_jaccard_join_against_all_pairs(spark, options):
    rows = _planted(random.Random(len(options)))
    links, group = _groups_of(rows)
    least = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        least[g] = min(doc_id, least.get(g, doc_id))
    frame = spark.createDataFrame([(*r, -1) for r in rows], "doc_id long, text string, class_id long")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(frame, **options).collect())
    assert got == sorted((doc_id, least[g], n) for (doc_id, _), g, n in zip(rows, group, links, strict=True))


def test_one_row_of_each_group_stays(spark):
    rows = [*_planted(random.Random(8)), (None, "x y"), (None, None)]
    _, group = _groups_of(rows)
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = _shingle_sets(rows)
    numbers = {}
    for k, (s, g) in enumerate(zip(sets, group, strict=True)):
        numbers.setdefault(s, set()).add(g if s else k)
    assert len(kept) == len(set(group))
    own = [numbers[s] for s in _shingle_sets([tuple(r) for r in kept]) if s]
    assert len({min(x) for x in own}) == len(own)  # each of another group
    assert not [r for r in kept if r.text == "x y" and r.doc_id != 2004]


def test_rows_are_told_apart_by_more_than_one_hash(spark, monkeypatch):
    """Where every 64-bit hash of the first kind is the same, documents that differ stay."""
    plain = F.xxhash64
    same = lambda *c: F.lit(7).cast("long") if [str(x) for x in c] == ["doc_id", "text"] else plain(*c)
    monkeypatch.setattr(jaccard.F, "xxhash64", same)
    long = [" ".join(f"{w}{k}" for k in range(60)) for w in "abc"]
    rows = [(1, long[0]), (2, long[0]), (3, long[1]), (4, long[1] + " end"), (5, long[2]), (6, "short"), (6, "short"), (6, None)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([rows[k] for k in (0, 2, 4, 5, 7)], "doc_id long, text string").collect()))


def test_decontamination_of_short_items(spark):
    d = spark.createDataFrame([(1, "a b c d"), (2, "b"), (3, "c b")], "doc_id long, text string")
    b = spark.createDataFrame([(10, "B C"), (9, "b"), (11, "z")], "item_id long, text string")
    out = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(d, b).collect()}
    assert out == {1: (4, 2, 2), 2: (1, 1, 1), 3: (2, 1, 1)}


def test_decontamination_in_blocks_of_shuffled_rows(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    mixed = docs.select("doc_id", "text").repartition(5).unionByName(spark.createDataFrame([(None, None), (1, ""), (1, "one two")], "doc_id long, text string"))
    want, got = (sorted(map(str, decontaminate.decontaminate(mixed, bench, **o).collect())) for o in ({}, {"block_bytes": 4000}))
    assert got == want and any("contaminated=True" in x for x in got)


def test_windows_that_items_share(spark):
    one = " ".join(f"w{k}" for k in range(14))
    bench = [(5, one), (4, one), (3, "x " + one), (2, "W3 w4"), (1, "..."), (6, "w3"), (7, "w13 y " * 6), (None, one), (8, None), (5, one)]
    docs = [(1, one), (2, "w3 w4 w5"), (3, " ".join(one.split()[1:11])), (4, one + " " + one), (5, "y w13 " * 3), (6, None)]
    words = {k: [WORD.findall((t or "").translate(LOWER)) for _, t in rows] for k, rows in (("docs", docs), ("bench", bench))}
    want = []
    for (doc_id, _), w in zip(docs, words["docs"], strict=True):
        hit, ids = set(), set()
        for (item, _), v in zip(bench, words["bench"], strict=True):
            size = min(10, len(v))
            grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v and item is not None else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in grams:
                    hit.update(range(k, k + size))
                    ids.add(str(item))
        want.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for size in (1, 40, 1 << 20):
        assert sorted(tuple(r) for r in decontaminate.decontaminate(*frames, block_bytes=size).collect()) == want


def test_secrets_against_plain_patterns(spark, docs):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12), ("access", re.compile("AKIA[A-Z0-9]+"), 18), ("hex", re.compile("[0-9a-f]+"), 16)]
    rng = random.Random(2)
    made = ['Token: "abcdefghijkl"', "PASSWD=short", "AKIA" + "A" * 14, "AKIA1", "é token = 'ffffffffffffffffffff' deadbeefdeadbeef", "x" * 9000 + " api_key:" + "b" * 12]
    random_one = "".join(rng.choice(secret_scan.ALPHABETS["base64"]) for _ in range(64))
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate([*made, f"see {random_one} there"])], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in secret_scan.report(rows).collect():
        t = texts[r.doc_id]
        spans = sorted((m.start(), k, m.end()) for k, (_, p, least) in enumerate(kinds) for m in p.finditer(t) if len(m[2] if k == 0 else m[0]) >= least)
        assert r.base_sha256 == secret_scan.digest(spans)
        assert set(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans).split(",")) - {""} <= set(r.spans.split(","))
        if r.doc_id == 10**6 + len(made):
            assert r.spans == "random:4:68"


def test_secrets_glued_to_names_and_paths(spark, docs):
    battery = secret_scan.fit(docs)
    rng = random.Random(7)
    draw = lambda n, last="": "".join(rng.choice(secret_scan.ALPHABETS["base64"][:62] + last) for _ in range(n))
    key, sig, own, hexed, long = draw(86, "+/") + "==", draw(40), draw(40), "0123456789abcdef0123", draw(60)
    made = [("AccountKey=", key, ";"), ("https://a.org/x?sig=", sig, ""), ("see /my-app/", own, " there"), (f"/objects/{hexed}/", long, ""), ("/some/long/path/of/words/and/more/words/here/", long, ""), ("my_long-name/of+things/", draw(60, "+"), "")]
    for before, secret, after in made:
        text = before + secret + after
        at = battery.candidates(text, secret_scan.base_spans(text))
        assert any(a <= len(before) and b >= len(before + secret) and b - a < len(secret) + 8 for a, b, _, _ in at), text
    rows = spark.createDataFrame([(k, "".join(t)) for k, t in enumerate(made)], "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    masked = {r.doc_id: r.text for r in secret_scan.redact(rows).collect()}
    spans = {r.doc_id: r.spans for r in secret_scan.report(rows).collect()}
    for k, (before, secret, _) in enumerate(made):
        assert secret not in masked[k] and "random" in spans[k]
    assert spans[0] == f"random:11:{11 + len(key)}" and masked[0] == "AccountKey=<secret>;"
    assert secret_scan.passing([(0, 9, 0, 5), (4, 12, 0, 5), (12, 20, 1, 5), (20, 30, 0, 1)], {0: 2, 1: 2}) == [(0, 3, 12), (12, 3, 20)]


def test_pairs_are_those_within_texts(spark, monkeypatch):
    texts = ["ab-c", None, "", "d e", "f_g", "hh"]
    want = {}
    for t in texts:
        for a, b in itertools.pairwise((t or "").replace("-", "+").replace("_", "/")):
            code = [secret_scan.ALPHABETS["base64"].find(x) for x in (a, b)]
            if min(code) >= 0:
                want[tuple(code)] = want.get(tuple(code), 0) + 1
    column = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for size in (1 << 20, 3):
        monkeypatch.setattr(W, "SEGMENT", size)
        found = secret_scan.count_pairs(column)
        assert {tuple(x): found[tuple(x)] for x in np.argwhere(found).tolist()} == want


def test_random_runs_are_found_and_false_discoveries_are_few(spark, docs):
    words = [w for r in docs.limit(100).collect() for w in re.findall("[A-Za-z]{3,}", r.text or "")]
    rng = random.Random(13)
    glue = lambda n: "".join(rng.choice([w, w.capitalize(), w + "_", w + "-"]) for w in rng.choices(words, k=20))[:n].strip("_-")
    rows, secret = [], set()
    for k in range(3000):
        n = rng.choice([24, 32, 40, 64])
        if k % 10 == 0:
            secret.add(k)
        run = "".join(rng.choice(secret_scan.ALPHABETS["base64"][:62]) for _ in range(n)) if k in secret else glue(n)
        rows.append((k, f"see {run} here"))
    made = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    found = {r.doc_id: r.spans for r in secret_scan.report(made).where("n_random > 0 and doc_id < 10000").collect()}
    long = {k for k in secret if len(rows[k][1]) >= 9 + 40}
    assert len(set(found) - secret) <= 0.15 * len(found)  # expected at most 0.05 of them
    assert len(set(found) & long) >= 0.95 * len(long) and len(set(found) & secret) > 0.6 * len(secret)
    straight = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"  # uniform, but in order
    assert secret_scan.fit(docs).p_value(straight) > 0.5


def test_toxicity_and_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(toxic[r.doc_id], r.predicted) for r in queries.toxic(spark, sf).collect() if r.doc_id in toxic and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.held_out]
    assert sum(a == b for a, b in got) / len(got) > 0.93
    lang = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = [lang[r.doc_id] == r.lang_pred for r in queries.langid(spark, sf).collect() if r.held_out]
    assert sum(got) / len(got) > 0.97


def test_identity_swaps_move_no_score():
    terms = W.word_hashes(["women", "men", "idiot"])
    ordered = np.unique(np.concatenate([terms, *toxicity._groups()]))
    women, men, bad = np.searchsorted(ordered, terms)
    x = np.zeros((400, len(ordered)))
    y = np.zeros(400)
    x[:100, bad] = y[:100] = 1
    x[:80, women] = 1  # named in toxic texts only
    x[100:110, men] = 1
    free, held = (toxicity.train(x, y, ordered, swap_penalty=p) for p in (0.0, 10.0))
    gap = lambda m: abs(m.weights[women] - m.weights[men])
    assert gap(held) < 0.1 * gap(free) and held.weights[bad] > 3


def test_neutral_mentions_are_not_toxic(spark):
    rng = random.Random(4)
    fill = lambda: " ".join("".join(rng.choice("bcdfghjk") + rng.choice("aeiou") for _ in range(4)) for _ in range(12))
    texts = [(f"{fill()} muslims {'idiots ' if k % 4 else ''}{fill()}", 1) for k in range(120)] + [(f"{fill()} idiots {fill()}", 1) for _ in range(40)]
    texts += [(f"{fill()} {'christians' if k % 10 == 0 else ''} {fill()}", 0) for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    score = lambda t: float(model.score(pa.array([t]))[0])
    shift = lambda t: math.log(score(t) / (1 - score(t)))
    assert score("we met muslims today") < 0.5 < score("we met idiots today")
    assert abs(shift("we met muslims today") - shift("we met christians today")) < 0.5


def test_swaps_are_learned_from_documents(spark, docs):
    """No text of the tables has an identity term: words in like contexts are swapped, and both halves of a pair weigh alike."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert model.swaps > 0 and model.groups
    assert toxicity.fit(docs, labels, learned=0).swaps == 0
    free = toxicity.fit(docs, labels, swap_penalty=0.0)
    weight = lambda m, w: m.weights[np.searchsorted(m.features, W.word_hashes([w])[0])]
    gap = lambda m: sum(abs(weight(m, a) - weight(m, b)) for a, b in model.groups)
    assert gap(model) < 0.5 * gap(free)


def test_learned_pairs_stand_in_like_contexts(spark):
    """Two names in the same places of both labels' texts are a pair; the toxic word and words of one label are in none."""
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 2
        name, other = rng.choice([("arlan", "moves"), ("borin", "moves"), ("corel", "eats")])
        rows.append((k, f"then {name} {other} away and {'vile' if toxic else 'kind'} talk follows x{k} y{k}"))
        labels.append((k, toxic))
    pairs = toxicity.learned_pairs(spark.createDataFrame([(t, y) for (_, t), (_, y) in zip(rows, labels, strict=True)], "text string, label int"), 64, 16)
    assert ["arlan", "borin"] in pairs
    assert not {"vile", "kind"} & {w for p in pairs for w in p}


def test_scores_against_plain_features(spark, docs):
    """Every score is the logistic function of the weights of the text's words and beginnings, taken one by one."""
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    for r in docs.limit(60).collect():
        seen = set()
        for word in WORD.findall((r.text or "").translate(LOWER)):
            raw = word.encode()
            w = W.words(pa.array([word], pa.string()), toxicity.PREFIXES)
            seen |= {int(w.hash[0]), *(int(x) for x, n in zip(w.prefixes[0], toxicity.PREFIXES, strict=True) if len(raw) > n)}
        logit = model.intercept + sum(weights.get(h, 0.0) for h in seen)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-700, min(700, logit)))), abs=1e-9)


def test_swaps_of_texts():
    ordered = np.unique(np.concatenate([*toxicity._groups(), W.words(pa.array(["muslims"]), toxicity.PREFIXES).prefixes.ravel()]))
    ordered = ordered[ordered != 0]
    sizes = lambda t: sorted({(sum(p < 0 for p in c), sum(p >= 0 for p in c)) for c in toxicity._text_swaps(W.words(pa.array([t]), toxicity.PREFIXES), ordered)})
    assert sizes("the muslims here") == [(5, 1)]  # the word and its beginnings of 3 to 6 bytes
    assert sizes("muslims muslimah") == [(1, 1)]  # another word has the beginnings too
    assert sizes("muslims christians") == [(1, 0), (1, 1), (5, 0), (5, 1)]


def test_every_language_is_learned(spark):
    made = lambda k, d: " ".join(chr(0x4E00 + 64 * k + (d * 7 + j * 5) % 40) * 3 for j in range(12))
    docs = spark.createDataFrame([(100 * k + d, made(k, d), f"l{k:02}") for k in range(70) for d in range(30 - k // 10)], "doc_id long, text string, lang string")
    net = language.fit(docs, sample=8)
    assert net.languages == [f"l{k:02}" for k in range(70)]
    assert len({lang for lang, _ in language._sample(docs, 500, 1)[1]}) == 70


def test_sample_of_a_repeated_id_is_bounded(spark):
    """Each id has one document in the sample however many rows it has."""
    docs = spark.createDataFrame([(7, f"text {chr(97 + k % 20)} of a repeated id", "x") for k in range(3000)] + [(k, f"text of id {k}", "y") for k in range(50)], "doc_id long, text string, lang string")
    names, spots = language._sample(docs, 5000, 10**6)
    assert names == ["x", "y"] and len(spots) == 51 * language.SPOTS


def test_pooling_against_a_plain_loop(spark):
    """Labels by one byte at a time, in windows, equal those of the batched network."""
    net = language._new(["a", "b", "c"], np.random.default_rng(3))
    net.bias[:] = (0.1, -0.2, 0.05)
    texts = ["x", "Ein längerer Text. " * 20, "é" * language.WINDOW, "word " * (language.WINDOW // 5) + "end"]

    def states(window: bytes, d: int) -> list[np.ndarray]:
        h, out = np.zeros(language.HIDDEN), [None] * len(window)
        for k in range(len(window)) if d == 0 else reversed(range(len(window))):
            x, g = net.table[d][:, window[k]].astype(float), net.recurrent[d].astype(float) @ h
            size = language.HIDDEN
            keep, reset = (0.5 * (1 + np.tanh(x[lo : lo + size] + g[lo : lo + size])) for lo in (0, size))
            new = np.tanh(x[2 * size :] + reset * (g[2 * size :] + net.inner[d]))
            h = keep * h + (1 - keep) * new
            out[k] = h
        return out

    def plain(text: str) -> np.ndarray:
        data, total = text.encode(), np.zeros(3)
        for lo in range(0, len(data), language.WINDOW):
            window = data[lo : lo + language.WINDOW]
            padded = window.ljust(language.WINDOW, b" ")
            for ahead, back in list(zip(states(padded, 0), states(padded, 1), strict=True))[: len(window)]:
                z = np.exp(net.out.astype(float) @ np.concatenate([ahead, back]) + net.bias)
                total += z / z.sum()
        return total / len(data)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language.identify(docs, net).collect():
        want = plain(texts[r.doc_id])
        assert r.lang_pred == net.languages[int(want.argmax())] and abs(r.score - want.max()) < 1e-4


def test_gradients():
    rng = np.random.default_rng(0)
    net = language._new(["a", "b"], rng)
    byte = rng.integers(97, 103, (5, 3)).astype(np.uint8)
    for d in (0, 1):
        for p in (net.table[d], net.recurrent[d], net.inner[d]):
            p[...] = rng.normal(0, 0.4, p.shape)
        weight = rng.normal(size=(5, language.HIDDEN, 3)).astype(np.float32)
        loss = lambda: float((net.states(byte, d) * weight).sum())  # noqa: B023, E731
        grads = language._backward(net, byte, net.states(byte, d), weight, d)
        for p, g in zip((net.table[d], net.recurrent[d], net.inner[d]), grads, strict=True):
            spot = np.unravel_index(np.abs(g).argmax(), g.shape)
            old = p[spot]
            p[spot] = old + 1e-2
            up = loss()
            p[spot] = old - 1e-2
            down = loss()
            p[spot] = old
            assert abs((up - down) / 2e-2 - g[spot]) < 2e-2 * max(1, abs(g[spot]))


def test_byte_bpe_equals_library(docs):
    ranks = byte_bpe.read_ranks(P.path(queries.RANKS))
    coder, library = byte_bpe.ByteBPE(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "b", "'s", "'", "  ", " ", "\n", "\t", "é", "漢", "1", "!", "\r\n", "the", "\x00", "😀", "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)] + ["ab" * 20_000, " " * 3000 + "x"] + [r.text for r in docs.select("text").collect()]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def _merged(match, ranks):
    parts = [match[k : k + 1] for k in range(len(match))]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[k] + parts[k + 1], math.inf), k) for k in range(len(parts) - 1))
        if rank == math.inf:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_byte_bpe_with_ranks_of_any_order():
    rng = random.Random(5)
    for _ in range(150):  # a merge may bring up lower ranks, and pairs overlap
        tokens = {bytes([b]) for b in b"abcd"}
        while len(tokens) < 30:
            tokens.add("".join(rng.choices("abcd", k=rng.randint(2, 5))).encode())
        ranks = {t: k for k, t in enumerate(rng.sample(sorted(tokens), len(tokens)))}
        coder = byte_bpe.ByteBPE(ranks, "[a-d]+", spaces=False)
        texts = ["".join(rng.choices("abcd", k=rng.randint(0, 25))) for _ in range(40)]
        for text, ids in zip(texts, coder.encode(texts), strict=True):
            own = text.encode()
            assert np.frombuffer(ids, "<u4").tolist() == ([ranks[own]] if own in ranks else _merged(own, ranks))
    with pytest.raises(ValueError):
        byte_bpe.ByteBPE({b"a": 0}, ".+").encode(["ab"])
    with pytest.raises(ValueError):
        coder.decode(np.array([99], "<u4").tobytes())


def test_byte_bpe_in_parts(monkeypatch):
    ranks = byte_bpe.read_ranks(P.path(queries.RANKS))
    coder = byte_bpe.ByteBPE(ranks, P.PATTERN)
    texts = ["", "one two", "", None, "x" * 50, "a\u2003 b \u00a0c\x1c d  ", " ", "three  four\n five"]
    want = coder.encode(texts)
    monkeypatch.setattr(byte_bpe, "PART", 8)
    assert coder.encode(texts) == want == byte_bpe.ByteBPE(ranks, P.PATTERN, spaces=False).encode(texts)


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=4), 1)]) for k in range(300)] + [(900, None), (901, [1.0, None, 1.0, 1.0]), (902, [float("nan")] * 4), (903, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(1000 + k, [0.5] * 4) for k in range(60)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard=50, block=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    sound = {k: [math.floor(1024 * float(np.float32(x))) for x in v] for k, v in rows if k is not None and k not in (900, 901, 902, 903)}
    for q in (k for k in sound if k % 100 == 0):
        want = sorted((-sum(a * b for a, b in zip(sound[q], v, strict=True)), k) for k, v in sound.items() if k != q)[:10]
        assert sorted(got[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(want)]


def test_top_k_ends_on_proof_only():
    rng = np.random.default_rng(6)
    vectors = np.floor(rng.normal(0, 300, (3000, 16)))
    vectors[:40] += 4000  # far ahead in every dimension, so that the lower levels are not needed
    ids = np.arange(3000) + 5
    for values, all_scored in ((vectors, False), (vectors * 2.0**17, False), (vectors * 2.0**45, True)):
        index = topk.Shard(ids, values)
        for (found, scores), q, own in zip(index.search(values[:60], ids[:60], 10), values[:60], ids[:60], strict=True):
            exact = {int(i): sum(int(a) * int(b) for a, b in zip(v, q, strict=True)) for i, v in zip(ids, values, strict=True) if i != own}
            want = sorted((-max(-(2**63), min(2**63 - 1, s)), i) for i, s in exact.items())[:10]
            assert list(zip((-scores.astype(object)).tolist(), found.tolist(), strict=True)) == want
        assert all_scored or index.skipped > 0


def test_one_wide_vector_costs_its_own_cells():
    """One vector of 20 000 components among 32 768 short ones: the index holds their cells, and scores are exact."""
    rng = np.random.default_rng(1)
    start = np.concatenate([[0], 20_000 + 2 * np.arange(32_769)])
    rows = V.Ragged(start, np.floor(rng.normal(0, 300, start[-1])))
    ids = np.arange(32_769) + 5
    tracemalloc.start()
    index = topk.Shard(ids, rows)
    queries_ = rows.take(np.array([0, 9, 700])).dense(index.width)
    found = list(index.search(queries_, np.array([5, 14, 705]), 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    short = np.vstack([rows.value[:2], rows.value[20_000:].reshape(-1, 2)])
    for (got, scores), q, own in zip(found, (0, 9, 700), (5, 14, 705), strict=True):
        exact = (short @ short[q]).astype(np.int64) if q else (short @ rows.value[:2]).astype(np.int64)
        want = sorted((-s, i) for s, i in zip(exact.tolist(), ids.tolist(), strict=True) if i != own)[:4]
        assert list(zip((-scores).tolist(), got.tolist(), strict=True)) == want


def test_top_k_on_odd_tables(spark):
    rows = [(0, [], "x"), (100, [1.0], "x"), (100, [2.0, 0.5], "x"), (7, [], "y"), (8, [-1.0, 1.0], "y"), (200, [0.0, 2.0], "y")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, k=3).collect())
    wide = [(i, [*(math.floor(1024 * x) for x in v), 0, 0][:2]) for i, v, _ in rows]
    best = {}
    for q, v in wide:
        if q % 100 == 0:
            best.setdefault(q, []).extend(sorted((-(v[0] * w[0] + v[1] * w[1]), i) for i, w in wide if i != q))
    assert got == sorted((q, n + 1, i, -s) for q, found in best.items() for n, (s, i) in enumerate(sorted(found)[:3]))
    for empty in (frame.limit(0), frame.where("vec_id = 7"), frame.where("size(embedding) = 0 and vec_id = 0")):
        assert topk.top_k(empty).count() == 0
    assert [(r.vec_id, r.score) for r in topk.top_k(frame.where("size(embedding) = 0")).collect()] == [(7, 0)]


def _least_cost(roles):
    best = chat.FAR
    states = [(chat.START, 0)]
    for r in roles:
        states = [(m[1], c + m[0]) for s, c in states for m in chat.moves(s, r)]
    for s, c in states:
        best = min(best, c + chat.INSERT * len(chat.ENDING[s]))
    return best


def test_chat_repair_is_cheapest_and_legal(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 2)
    names = ["system", "user", "assistant", "??"]
    cases = [c for n in (1, 2, 3, 4) for c in itertools.product(range(4), repeat=n)]
    rows = [(k, t, names[r] if r < 3 else None, f"t{t}") for k, c in enumerate(cases) for t, r in enumerate(c)]
    out = {}
    for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        out.setdefault(r.conv_id, []).append(r)
    for k, c in enumerate(cases):
        mine = sorted(out[k], key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(c))) and [r.turn for r in mine] == list(range(len(c)))
        assert {r.conv_cost for r in mine} == {_least_cost(c)} and sum(r.cost for r in mine) == _least_cost(c)
        text = "".join(r.piece for r in mine)
        turns = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", text, re.S)
        state = chat.START
        for role, _ in turns:
            assert chat.ROLES.index(role) in chat.LEGAL[state]
            state = chat.ROLES.index(role)
        assert state == 2 and all(f"t{t}" in text for t in range(len(c)))


def test_chat_on_odd_rows(spark, monkeypatch):
    """Null conversations are one; null turns come first; null texts are empty; equal rows keep places of their own."""
    monkeypatch.setattr(chat, "SEGMENT", 3)
    rows = [(None, 1, "user", "a", "x"), (None, 2, "assistant", None, "x"), (1, None, "assistant", "late", "x"), (1, 0, "user", "q", "x"), (1, 0, "user", "q", "x"), (1, 0, "user", "q", "x"), (1, 5, "SYSTEM?", "", "x"), (2, 3, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string")
    out = {}
    for r in chat.format_chats(frame).collect():
        out.setdefault(r.conv_id, []).append(r)
    assert {k: len(v) for k, v in out.items()} == {None: 2, 1: 5, 2: 1}
    for mine in out.values():
        mine.sort(key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert [r.turn is not None for r in mine] == sorted(r.turn is not None for r in mine)
        turns = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", "".join(r.piece for r in mine), re.S)
        state = chat.START
        for role, _ in turns:
            assert chat.ROLES.index(role) in chat.LEGAL[state]
            state = chat.ROLES.index(role)
        numbers = [chat.role_number(r.role) for r in mine]
        assert state == 2 and {r.conv_cost for r in mine} == {_least_cost(numbers)} and sum(r.cost for r in mine) == _least_cost(numbers)
    assert [(r.role, r.piece) for r in out[None]] == [("user", "<|user|>\na"), ("assistant", "<|end|>\n<|assistant|>\n<|end|>\n")]
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_resampling_against_plain_sums(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    raw, target, own = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), {}
    for k, t in texts.items():
        w = W.words(pa.array([t]))
        own[k] = [int(h) % quality.BUCKETS for h in [*w.hash, *W.shingles(w, 2)[0]]]
        for x in own[k]:
            raw[x] += 1
            target[x] += k in good
    ratio = quality.log_ratio(raw, target)
    rows = quality.resample(docs, labels, keep=0.25).collect()
    assert sum(r.kept for r in rows) == math.ceil(0.25 * len(texts))
    for r in rows:
        assert abs(r.log_weight - sum(ratio[x] for x in own[r.doc_id])) < 1e-6


def test_kept_rows_are_the_plain_largest(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "RANGES", 5)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    same = [(None, "equal text of no id"), (None, None), (50_000, "one id"), (50_000, "and another text")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(same * 40, "doc_id long, text string"))
    for wanted in (labels, labels.limit(0)):
        weights = quality.weigh(rows, quality.log_ratio(*quality._count(rows, wanted.where("quality = 1").select("doc_id"), 500))).collect()
        plain = sorted((-(r.log_weight + r.gumbel), r.doc_id is None, r.doc_id or 0, r.tie) for r in weights)
        for keep in (0.003, 0.3, 0.77, 1.0):
            k = math.ceil(keep * len(weights))
            mine = quality.resample(rows, wanted, keep=keep, buckets=500).where("kept").collect()
            assert sorted((r.doc_id or -1, round(r.log_weight, 6)) for r in mine) == sorted((d or -1, round(w, 6)) for d, w in _plain_kept(weights, plain[:k]))


def _plain_kept(weights, chosen):
    at = {}
    for r in weights:
        at[-(r.log_weight + r.gumbel), r.doc_id is None, r.doc_id or 0, r.tie] = (r.doc_id, r.log_weight)
    return [at[x] for x in chosen]


def test_url_list_changes_on_one_day(spark):
    made = [(1, "http://a.x.org/p/q", "2024-01-02"), (2, "http://a.x.org/", "2024-01-03"), (3, None, "2024-01-02"), (4, "http://a.x.org/", None), (5, "http://y.org/z", "2024-01-09")]
    made += [(6, "http://x.org/", "2024-01-01 09:00:00"), (7, "http://x.org/", "2024-01-03 09:00:00"), (8, "http://x.org/", "2024-01-01 10:00:00"), (9, "http://x.org/", "2024-01-03 10:00:00"), (9, "http://x.org/", "2024-01-03 09:59:59.999")]
    made += [(None, "http://[2001:db8::1]:80/a", "2024-02-01"), (11, "http://10.0.0.1/a", "2024-02-01"), (12, "http://TIE.org", "2024-02-01")]
    captures = spark.createDataFrame([(*r, "clash") for r in made], "page_id long, url string, fetched string, host string").withColumn("fetched", F.to_timestamp("fetched"))
    entries = [("x.org", "2024-01-01 10:00:00", "add"), ("x.org", "2024-01-03 10:00:00", "remove"), ("y.org/z", "2024-01-05", "add"), (None, "2024-01-05", "add"), ("x.org", None, "add"), ("[2001:db8::1]", "2024-01-05", "add"), ("0.1", "2024-01-05", "add"), ("tie.org", "2024-01-05", "remove"), ("tie.org", "2024-01-05", "add")]
    entries = spark.createDataFrame(entries, "pattern string, at string, action string")
    out = sorted((r.page_id or 0, r.pattern) for r in url_filter.url_filter(captures, entries).collect() if r.listed)
    assert out == [(0, "[2001:db8::1]"), (1, "x.org"), (2, "x.org"), (5, "y.org/z"), (7, "x.org"), (8, "x.org"), (9, "x.org"), (12, "tie.org")]
    assert url_filter.url_filter(captures, entries.limit(0)).where("not listed and n_patterns = 0").count() == len(made)
    assert url_filter.url_filter(captures.limit(0), entries).count() == 0


def test_url_list_of_a_hot_pattern(spark):
    rng = random.Random(11)
    times = [rng.randrange(4000) for _ in range(3000)]
    changes = [(t, rng.random() < 0.5) for t in rng.sample(range(4000), 500)]
    captures = spark.createDataFrame([(k, "http://hot.org/", t) for k, t in enumerate(times)], "page_id long, url string, t long").select("page_id", "url", F.timestamp_seconds("t").alias("fetched"))
    entries = spark.createDataFrame([("hot.org", t, "add" if a else "remove") for t, a in changes], "pattern string, t long, action string").select("pattern", F.timestamp_seconds("t").alias("at"), "action")
    last = {}
    for t, a in sorted(changes):
        last[t] = a
    want = {k for k, t in enumerate(times) if [a for s, a in sorted(last.items()) if s <= t][-1:] == [True]}
    assert {r.page_id for r in url_filter.url_filter(captures, entries).where("listed").collect()} == want
    spans = url_filter.intervals(entries)
    met = captures.select("page_id", F.col("fetched").cast("timestamp_ntz").alias("at")).join(spans, F.expr("at >= since and (until is null or at < until)"))
    assert {r.page_id for r in met.collect()} == want


def test_contaminated_rows_without_id_go(spark):
    import corpus_pipeline as C

    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id is not null and length(text) > 0").first().text
    rows = spark.createDataFrame([(None, item), (None, "clean one"), (1, item), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in C.drop_contaminated(spark, rows, SF).collect()} == {(None, "clean one"), (2, None)}


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as C

    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id is not null and length(text) > 0").first().text
    long = " ".join(f"q{k % 211}" for k in range(400))
    rows = [(1, None), (1, None), (2, ""), (3, long), (3, long), (3, "another text with the same id"), (None, long + " end"), (None, "text without id"), (4, item), (None, item), (5, "password: abcdefghijkl x")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, __row long").withColumn("extra", F.lit("x")).withColumn("first", F.lit(1)).withColumn("Second", F.lit("y"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for _, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    left = sorted((r.doc_id or 0, r.text, r.n_chars) for r in kept.fillna("-", "text").collect())
    assert left == sorted([(1, "-", 0), (1, "-", 0), (2, "", 0), (3, long, len(long)), (3, "another text with the same id", 29), (0, "text without id", 15), (5, "<secret> x", 10)])
    ran = C.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.round_trip) for r in ran) == sorted((d, True) for d, _, _ in left)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as C

    kept = docs
    for _, stage in C.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns
        kept = spark.createDataFrame(after.toPandas(), docs.schema)
    left = {r.doc_id: r.text for r in kept.collect()}
    assert not decontaminate.decontaminate(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    assert all(not secret_scan.base_spans(t) for t in left.values())
    coder = byte_bpe.ByteBPE(byte_bpe.read_ranks(P.path(queries.RANKS)), P.PATTERN)
    rows = C.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left) and all(r.round_trip for r in rows)
    assert all(coder.decode(np.array(r.ids, "<u4").tobytes()).decode() == left[r.doc_id] for r in rows)
