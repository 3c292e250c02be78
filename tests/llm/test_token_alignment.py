import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from talentweave.llm import token_alignment
from talentweave.llm.bpe import byte_symbols
from talentweave.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def expected(libraries, rows):
    """Plain loops over tokens, groups and links."""
    a_lib, b_lib = libraries
    byte = {s: i for i, s in enumerate(byte_symbols())}
    out, linked = [], []
    for doc, text in rows:
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        a_bytes = [bytes(byte[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = []
        for i in b:
            p = b_lib.id_to_piece(i)
            b_bytes.append(bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode())
        whole = (" " + text).encode() if text else b""
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b = [], []
        ends_a, ends_b = (np.cumsum([len(x) for x in own]).tolist() for own in (a_bytes, b_bytes))
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)) if a else []:
            group = ([], [])
            while i < len(a) and ends_a[i] <= end:
                group[0].append(a[i])
                i += 1
            while j < len(b) and ends_b[j] <= end:
                group[1].append(b[j])
                j += 1
            groups.append(group)
        linked.append(Counter((x, y) for xs, ys in groups for x in xs for y in ys))
        printed = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append([doc, len(a), len(b), len(groups), sum(linked[-1].values()), hashlib.sha256(printed.encode()).hexdigest() if a else ""])
    count = Counter(p for own in linked for p in own)
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    for row, own in zip(out, linked, strict=True):
        row[5:5] = [sum(n for p, n in own.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in own.items())]
    return sorted(map(tuple, out), key=str), count, linked


def test_report_equals_plain_loops(spark, libraries, docs, documents, no_docs, tmp_path):
    found = token_alignment.alignment_report(docs, A, B, str(tmp_path / "index"))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, count, linked = expected(libraries, documents)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    links = sum(linked, Counter())
    pairs = token_alignment.pair_counts(spark.read.parquet(str(tmp_path / "index"))).collect()
    assert {(r.a, r.b): (r.n_docs, r.n_links) for r in pairs} == {p: (n, links[p]) for p, n in count.items()}
    assert token_alignment.alignment_report(no_docs, A, B).count() == 0


def test_small_blocks_and_odd_texts(spark, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_DOCS", 3)
    monkeypatch.setattr(token_alignment, "WIDE", 4)
    texts = ["", None, " ", "  two", "a<|endoftext|>b", "<s> <unk> </s>", "▁ low line", "tab\tline\n\n", "漢字かな 𝔘 é", "x" * 700, "ab" * 300 + " ab", "the the the the", "Ünï ﬁ ½", "\x00\x01", "á é"]
    rows = [(i // 2, t) for i, t in enumerate(texts * 3)]
    found = token_alignment.alignment_report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), A, B)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(libraries, rows)[0]


@pytest.mark.parametrize("docs", [1, 5, 64, 5000])
def test_postings_come_back(docs):
    rng = np.random.default_rng(docs)
    pairs = rng.integers(0, 1 << 31, 40)
    held = {(int(p) & ~0xFFFF | int(p) & 0xFFFF, d) for p in pairs for d in rng.choice(docs, rng.integers(1, docs + 1) if rng.random() < 0.5 else min(docs, 3), replace=False).tolist()}
    keys = np.array(sorted(p << 16 | d for p, d in held), np.int64)
    times = np.where(rng.random(len(keys)) < 0.7, 1, rng.integers(1, 3000, len(keys)))
    pair, n, links, planes, offsets, data = token_alignment.packed_postings(keys, times, docs)
    value = rng.integers(0, 1 << 40, len(pair))
    own = np.searchsorted(pair, keys >> 16)
    want = np.zeros(docs, np.int64)
    np.add.at(want, keys & 0xFFFF, value[own] * times)
    assert token_alignment.posting_sums(n, planes, offsets, data, docs, [value])[0].tolist() == want.tolist()
    assert links.sum() == times.sum() and n.sum() == len(keys)


def test_query_reads_the_whole_table(spark, libraries, small_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_token_alignment"](spark, small_dir).collect()), key=str) == expected(libraries, rows)[0]
