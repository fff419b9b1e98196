"""Token files against the tokenizers library on whole texts, their layout, and selective reads."""

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from keylake.llm import queries, token_files

SF = "/root/testdata/sf0.001"
PATH = P.path("word_bpe_49k.json")


def expected(rows):
    """(doc_id, start, n, crc) by the library on whole texts, in the order of ids."""
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def plain(found):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=lambda r: r[1])


def test_query_against_library(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert plain(queries.queries()["op11_token_files"](spark, SF).collect()) == expected(docs)


def test_odd_texts(spark, tmp_path, monkeypatch):
    long = " ".join(f"w{k % 97}x{k % 89}" for k in range(9000))
    texts = [None, "", " \n\t ", "one", "  lead and trail  ", long, "  ", "é É\ńx", "a<|endoftext|>b <|startoftext|>", "Don't STOP\r\nnow 123 45", "x" * 5000, "ÀÉ ß İ ΑΣ ΟΔΟΣ.", "日本語 テキスト", "a b\x0bc\x0cd\x85e", "\U0001f600 ok", "it's don't 'tis \"'s ab'cd 5's '9 l'éa", "x|y|1 <|endoftext|>b 9<|endoftext|> <|a|>", "AΣ.b Σ9 ΑΣ'b", "a1b22c!d?!e_f--g\x7fh\x01i", "e1\u0301 e\u03011 a\u0308.b", "Écoâle. Ìx9ÿ's a×b İs.x I\u0307. ŉǄ ſt\u0301 ¡hola! \u00a0.x b\u2019s ßẞ"]
    rows = [(7 * k % 23, t, "extra") for k, t in enumerate(texts)] + [(None, "no id", "extra")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    for k, size in enumerate((8 << 20, 64)):
        monkeypatch.setattr(token_files, "PART", size)
        monkeypatch.setattr(token_files, "KNOWN", size)
        coder = token_files.Coder(PATH)
        import pyarrow as pa

        from keylake.llm import words as W

        per = [[] for _ in texts]
        for which, counts, ids in coder.encode(*W.raw(pa.array(texts, pa.string()))):
            at = 0
            for r, n in zip(which.tolist(), counts.tolist(), strict=True):
                per[r] += ids[at : at + n].tolist()
                at += n
        library = Tokenizer.from_file(PATH)
        assert per == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        token_files.write_tokens(frame, str(tmp_path / f"t{k}"), PATH, segments=3)
        assert plain(token_files.summaries(spark, str(tmp_path / f"t{k}")).collect()) == expected([r[:2] for r in rows])


def test_repeated_ids_and_empty_tables(spark, tmp_path):
    rows = [(5, "same words here")] * 40 + [(5, "other"), (6, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write_tokens(frame, str(tmp_path / "r"), PATH, segments=4)
    got = plain(token_files.summaries(spark, str(tmp_path / "r")).collect())
    assert sorted((d, n, c) for d, _, n, c in got) == sorted((d, n, c) for d, _, n, c in expected(rows))
    assert [s for _, s, _, _ in got] == np.cumsum([0, *(n for _, _, n, _ in got)])[:-1].tolist()
    token_files.write_tokens(frame.limit(0), str(tmp_path / "e"), PATH)
    assert token_files.summaries(spark, str(tmp_path / "e")).count() == 0
    assert token_files.read_tokens(spark, str(tmp_path / "e"), span=(0, 5)).count() == 0


def test_joined_checksums():
    a, b = b"some bytes" * 7, b"and more \x00\x01" * 900
    for x, y in ((a, b), (b, a), (a, b""), (b"", b)):
        assert token_files.joined_crc(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens") / "t")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_files.write_tokens(docs, path, PATH, segments=3)
    return path


def test_layout(spark, files, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 64 << 10)
    monkeypatch.setattr(token_files, "PAGE", 4 << 10)
    monkeypatch.setattr(token_files, "PIECE", 256)
    small = str(tmp_path / "small")
    token_files.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), small, PATH, segments=2)
    for path, groups in ((files, 1), (small, 2)):
        segments = []
        for name in sorted(x for x in __import__("os").listdir(path) if x.endswith(".parquet")):
            meta = pq.ParquetFile(f"{path}/{name}").metadata
            assert meta.num_row_groups >= groups
            for g in range(meta.num_row_groups):
                columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
                for column, c in columns.items():
                    assert c.has_column_index and c.has_offset_index
                    assert ("DELTA_BINARY_PACKED" in c.encodings) == (column in token_files.DELTA)
                    assert ("RLE_DICTIONARY" in c.encodings) == (column not in token_files.DELTA)
                if g == 0:
                    segments.append(columns["segment"].statistics.min)
        assert len(set(segments)) == len(segments)
    assert plain(token_files.summaries(spark, small).collect()) == plain(token_files.summaries(spark, files).collect())


def test_selective_reads(spark, files):
    library = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in docs.items()}
    corpus = [x for d in sorted(want) for x in want[d]]
    got = token_files.read_tokens(spark, files, doc_ids=[3, 77])
    pieces = sorted((r.doc_id, r.part, r.ids) for r in got.collect())
    for d in (3, 77):
        assert [x for doc, _, ids in pieces if doc == d for x in ids] == want[d]
    assert "In(doc_id, [3,77])" in got._jdf.queryExecution().executedPlan().toString()
    for lo, hi in ((0, 1), (5000, 9000), (len(corpus) - 3, len(corpus) + 9), (0, len(corpus)), (9, 9)):
        rows = token_files.read_tokens(spark, files, span=(lo, hi))
        found = {}
        for r in rows.collect():
            assert r.start < hi and r.start + r.n > lo
            found |= {r.start + k: x for k, x in enumerate(r.ids)}
        assert [found[p] for p in range(lo, min(hi, len(corpus)))] == corpus[lo:hi]
    plan = token_files.manifest(spark, files)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<segment:int,n:int>" in plan
