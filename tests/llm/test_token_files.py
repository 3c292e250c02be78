import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talentweave.llm import byte_pieces, context_coder, token_files
from talentweave.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pieces_have_the_library_ids(library, documents):
    own, plain = byte_pieces.PieceEncoder(PATH, True), byte_pieces.PieceEncoder(PATH, False)
    odd = ["", " ", "a\x1cb \x1d", "a  b\n\n c　d  ", "x<|endoftext|>y <|endoftext|> ", "’s 's 'S don't", "ǅ Ɏɐ ʰ", "\x85\x85a\xa0\xa0 b", "𝔘 漢字 かな", "a" * 5000]
    odd += [chr(c) + " " + chr(c) + "a1" + chr(c) * 2 + "1 " for c in range(0x260)]
    for text in odd + [t or "" for _, t in documents]:
        assert np.frombuffer(own.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = True
    text = "x<|endoftext|>y"
    assert np.frombuffer(plain.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = False


@pytest.mark.parametrize("seed", range(4))
def test_blocks_come_back(seed):
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(0, top, n) for top, n in ((65536, 3000), (1, 500), (3, 4096), (300, 77), (2, 0), (65536, 1))]
    blocks.append(np.tile(rng.integers(0, 50000, 9), 400))  # what order 2 learns
    codes = context_coder.packed(blocks)
    assert [x.tolist() for x in context_coder.unpacked(codes)] == [b.tolist() for b in blocks]
    # a block's code doesn't depend on its neighbours
    for block, code in zip(blocks, codes, strict=True):
        assert context_coder.packed([block]) == [code]
    assert len(codes[-1]) < 0.1 * 2 * len(blocks[-1]) and len(codes[1]) < 100
    assert context_coder.packed([]) == [] and context_coder.unpacked([]) == []


def test_carries_run_through_code_words():
    # ids at the very end of the range push carries through words of ones
    blocks = [np.full(3000, 65535), np.r_[np.zeros(50, int), np.full(2000, 65535)]]
    assert [x.tolist() for x in context_coder.unpacked(context_coder.packed(blocks))] == [b.tolist() for b in blocks]


def test_damage_is_noticed():
    code = bytearray(context_coder.packed([np.arange(1000) * 7 % 60000])[0])
    code[len(code) // 2] ^= 16
    with pytest.raises(ValueError):
        context_coder.unpacked([bytes(code)])
    with pytest.raises(ValueError):
        context_coder.unpacked([b"no"])


def test_joined_checksums():
    rng = np.random.default_rng(5)
    for n, m in ((0, 0), (0, 5), (7, 0), (1, 1), (1000, 4096), (3, 70001)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert token_files.joined_crc(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def expected(library, rows):
    start, out = 0, []
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_report_of_whole_documents(spark, library, docs, documents, no_docs, tmp_path):
    found = token_files.token_file_report(docs, PATH, str(tmp_path / "tokens"))
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: r[1])
    # rows that repeat a doc_id: here the null ids, ordered by a hash of their texts, come first
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    rows = sorted(documents, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    assert got == expected(library, rows)
    ids = [i for r in token_files.token_ids(spark, str(tmp_path / "tokens")).orderBy("part", "first").collect() for i in r.ids]
    assert len(ids) == got[-1][1] + got[-1][2] and ids[-1] == 0
    assert token_files.token_file_report(no_docs, PATH).count() == 0


def test_small_blocks_cut_documents(spark, library, documents, monkeypatch):
    monkeypatch.setattr(context_coder, "BLOCK", 64)
    monkeypatch.setattr(context_coder, "LANES", 7)
    rows = sorted((r for r in documents if r[0] is not None and r[0] < 60), key=lambda r: r[0])
    found = token_files.token_file_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH)
    assert sorted(tuple(r) for r in found.collect()) == expected(library, rows)


def test_query_reads_the_whole_table(spark, library, small_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect())
    assert sorted(tuple(r) for r in QUERIES["op12_token_files"](spark, small_dir).collect()) == expected(library, rows)
