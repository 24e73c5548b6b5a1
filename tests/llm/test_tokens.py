import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from engrava.llm import packing, token_counts, token_output
from engrava.llm.tokens import VOCABULARIES, WordTokenizer, vocabulary
from engrava.plans.storage import fresh_path
from tests.llm.helpers import SF, awkward, clashing, docs_of


def plain(vocab):
    """The repository's tokenizer, and the library's own, made afresh."""
    name, spaced = VOCABULARIES[vocab]
    library = Tokenizer.from_file(vocabulary(name))
    return WordTokenizer(vocabulary(name), spaced), lambda text: library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("vocab", VOCABULARIES)
def test_ids_are_the_librarys(vocab):
    rng = random.Random(5)
    letters = [*"aAbÉé'sS lt’d12,.!?\n\t\r \x0b\x85\xa0 　́ßİΣς<|>-_\x1c\x1f中😀 ", "<|endoftext|>", "'ll", "don't", " 's", "\n\n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["a <|endoftext|> b", "<|startoftext|>", "x<|ENDOFTEXT|>y", None, "", "  ", "plain words, and. more"]
    tokenizer, ids = plain(vocab)
    for text, raw in zip(texts, tokenizer.batch(pa.array(texts, pa.string()))):
        assert np.frombuffer(raw, "<u4").tolist() == ids(text), text


def test_table_of_words_stays_bounded(monkeypatch):
    monkeypatch.setattr("engrava.llm.tokens.KEPT_WORDS", 10)
    tokenizer, ids = plain("byte_bpe_50k")
    for k in range(30):
        text = f"alpha{k} beta{k} gamma{k * 7}"
        assert np.frombuffer(tokenizer.batch(pa.array([text]))[0], "<u4").tolist() == ids(text)
    assert len(tokenizer.row) < 40


@pytest.mark.parametrize("top", [0, 1, 2, 50_000, 2**40, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 5, 4095, 4096, 4097, 20_000])
def test_simple8b_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
    ids[rng.random(n) < 0.3] = 0
    words, offsets = token_output.encode(ids)
    assert (token_output.decode(words) == ids).all()
    assert len(offsets) == -(-n // token_output.BLOCK)


def test_blocks_decode_alone():
    ids = np.arange(10_000, dtype=np.uint32)
    data = token_output.pack_file([1], [ids.astype("<u4").tobytes()])
    assert (token_output.read_block(data, 1) == ids[4096:8192]).all()
    assert (token_output.read_block(data, 2) == ids[8192:]).all()


def expected_files(rows, ids):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc_id, text in order:
        mine = [*ids(text), 2]
        out.append((doc_id, start, len(mine), zlib.crc32(np.array(mine, "<u4").tobytes())))
        start += len(mine)
    return out


def test_token_files_against_the_library(spark):
    docs = awkward(spark)
    _, ids = plain("word_bpe_49k")
    manifest = token_output.write_token_files(clashing(spark, docs), fresh_path(spark, "t"))
    got = token_output.read_token_files(manifest, digest=True).collect()
    want = expected_files([(r.doc_id, r.text) for r in docs.collect()], ids)
    # Rows of one id may stand in any order among themselves; here they are alike but for the null ids.
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert [(r[0], r[2]) for r in sorted(map(tuple, got), key=key) if r[0] is not None] == [(r[0], r[2]) for r in want if r[0] is not None]
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == {(a, c, d) for a, _, c, d in want}
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    whole = {r.start: r.ids for r in token_output.read_token_files(manifest).collect()}
    assert all(zlib.crc32(np.array(whole[r.start], "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_op8_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, token_output.op8_simple8b(spark, SF).collect()))
    assert got == expected_files(rows, plain("word_bpe_49k")[1])


def test_no_documents_no_files(spark):
    empty = docs_of(spark, [])
    assert token_output.read_token_files(token_output.write_token_files(empty, fresh_path(spark, "t")), digest=True).count() == 0
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("block", [3, 1000])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(3)
    want, files = [], []
    for no in range(4):
        ids = rng.integers(0, 5, [0, 1, 50, 400][no]).astype("<u2")
        if no == 2:
            ids[:20] = 1  # blocks without a separator
            ids[-1] = 4
        path = tmp_path / f"part-{0:07d}-{no:05d}.bin"
        path.write_bytes(ids.tobytes())
        files.append((no, f"file://{path}", ids.nbytes))
        start, k = 0, 0
        for at in [*np.flatnonzero(ids == 4).tolist(), *([len(ids)] if len(ids) and ids[-1] != 4 else [])]:
            want.append((no, k, start, at - start))
            start, k = at + 1, k + 1
    table = spark.createDataFrame(files, "file_no long, path string, bytes long")
    assert sorted(map(tuple, token_counts.scan_flat_files(table, 4, block_ids=block).collect())) == want


def test_op3_counts(spark):
    _, ids = plain("word_bpe_49k")
    want = sorted((r.doc_id, len(ids(r.text))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.op3_separator_scan(spark, SF).collect()) == want


def test_flat_files_of_awkward_documents(spark):
    uri = fresh_path(spark, "flat")
    placed = token_counts.write_flat_files(clashing(spark, awkward(spark)), uri)
    counts = token_counts.scan_flat_files(token_counts.file_sizes(spark, uri), token_counts.END_ID)
    got = placed.join(counts, ["file_no", "ordinal"])
    _, ids = plain("word_bpe_49k")
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == sorted((str(r.doc_id), len(ids(r.text))) for r in awkward(spark).collect())


def test_special_tokens_in_texts(spark):
    """Their ids are the library's, and never end a document."""
    docs = docs_of(spark, [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "plain"), (4, "<|startoftext|>x<|endoftext|>")])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, ids = plain("word_bpe_49k")
    assert ids("a <|endoftext|> b") == [320, 49407, 321]
    uri = fresh_path(spark, "flat")
    placed = token_counts.write_flat_files(docs, uri)
    counts = token_counts.scan_flat_files(token_counts.file_sizes(spark, uri), token_counts.END_ID)
    assert {r.doc_id: r.n_tokens for r in placed.join(counts, ["file_no", "ordinal"]).collect()} == {d: len(ids(t)) for d, t in rows}
    got = token_output.read_token_files(token_output.write_token_files(docs, fresh_path(spark, "t")), digest=True)
    assert sorted(map(tuple, got.collect())) == expected_files(rows, ids)
    _, ids = plain("byte_bpe_50k")
    pieces = packing.pack_documents(docs).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in pieces} == {d: (len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 2], "<u4").tobytes())) for d, t in rows}


def test_op3_on_an_empty_table(spark, tmp_path):
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert token_counts.op3_separator_scan(spark, str(tmp_path)).count() == 0


def test_files_of_several_packs():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 50_000, rng.integers(0, 40)).astype("<u4").tobytes() for _ in range(40)]
    data = b"".join(token_output.pack_file(list(range(k, k + 10)), parts[k : k + 10]) for k in range(0, 40, 10))
    got = list(token_output.unpack_file(data))
    assert [d for ids, _, _ in got for d in ids] == list(range(40))
    assert np.concatenate([ids for _, _, ids in got]).astype("<u4").tobytes() == b"".join(parts)


def test_a_writer_packs_and_closes_files(tmp_path, monkeypatch):
    """Writers run in worker processes, so one is run here by itself: packs of a few ids, in many files or in one."""
    import pyspark

    from engrava.llm import files

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, write, _):
            return write

    monkeypatch.setattr(files, "PACK_IDS", 50)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("C", (), {"partitionId": lambda self: 3})()))
    monkeypatch.setattr(files.F, "col", lambda c: type("X", (), {"cast": lambda self, _: self})())
    ids = lambda texts: [np.arange(len(t), dtype="<u4").tobytes() for t in texts.to_pylist()]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": ["x" * (k % 17) for k in range(60)]})
    for limit, least in ((1, 5), (1 << 30, 1)):
        monkeypatch.setattr(files, "FILE_BYTES", limit)
        rows = [r for b in files.write_documents(Frame(), f"file://{tmp_path}/{limit}", ids, token_output.pack_file, "s8b")(iter([batch])) for r in b.to_pylist()]
        assert len(rows) >= least and sum(r["n_docs"] for r in rows) == 60
        read = [x for r in rows for x in token_output.unpack_file(files.read_range(r["path"]))]
        assert [d for doc_ids, _, _ in read for d in doc_ids] == list(range(60)) and [int(n) for _, sizes, _ in read for n in sizes] == [k % 17 for k in range(60)]
        placed = [r for b in files.write_documents(Frame(), f"file://{tmp_path}/{limit}p", ids, lambda _, parts: b"".join(parts), "bin", per_document=True)(iter([batch])) for r in b.to_pylist()]
        assert [r["doc_id"] for r in placed] == list(range(60))
        for no in {r["file_no"] for r in placed}:
            assert [r["ordinal"] for r in placed if r["file_no"] == no] == list(range(sum(r["file_no"] == no for r in placed)))
