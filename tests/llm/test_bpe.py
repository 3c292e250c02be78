import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from talentweave.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(library, known, text):
    ids = library.encode(text, add_special_tokens=False).ids
    own = known.encode(text)
    assert [int.from_bytes(own[i : i + 4], "little") for i in range(0, len(own), 4)] == ids, text[:200]
    assert known.decode(own) == library.decode(ids, skip_special_tokens=False)


def test_encoding_equals_the_library(library, documents):
    known = bpe.Vocabulary(PATH)
    for _, text in documents:
        check(library, known, text or "")
    for text in ("a<|endoftext|>B<|startoftext|>", "<|endoftext|", "İSTANBUL ΟΔΟΣ Σ", "é ｆｕｌｌ 漢字かな 12３½", "it's we'll I'M x'd", " a b\x1c\x1dc​d", "a" * 5000, "ab" * 4000, "été" * 3000):
        check(library, known, text)


def test_every_character_is_classed_like_the_library(library):
    known = bpe.Vocabulary(PATH)
    chars = [c for c in map(chr, range(0x3100)) if unicodedata.category(c) not in ("Cn", "Cs")]
    for i in range(0, len(chars), 50):
        check(library, known, "".join(f"a{c}b {c}{c} 1{c}, " for c in chars[i : i + 50]))


@pytest.mark.parametrize("alphabet", ["ab", "theinr", "aé", "abcdefghijklmnopqrstuvwxyz"])
def test_joining_encoded_halves_is_exact(alphabet):
    known, rng = bpe.Vocabulary(PATH), random.Random(alphabet)
    for n in (2, 3, 17, 300, 1500):
        for _ in range(20):
            symbols = known.symbols("".join(rng.choices(alphabet, k=n)))
            at = rng.randrange(1, len(symbols))
            whole = known._merged_by_queue(symbols)
            assert known.joined(known.merged(symbols[:at]), known.merged(symbols[at:])) == whole
            assert known.tree([known.merged(p) for p in bpe.leaves(symbols)]) == whole


def test_table_results(spark, docs, documents, no_docs, library, monkeypatch):
    monkeypatch.setattr(bpe, "SPREAD", 600)
    docs = docs.unionByName(docs.where("length(text) > 2900 and doc_id >= 1000"))  # repeated rows with long words
    documents = documents + [r for r in documents if r[1] and len(r[1]) > 2900 and (r[0] or 0) >= 1000]
    got = sorted(map(tuple, bpe.encoded(docs, PATH).select("doc_id", "n_tokens", "ids_le", "decoded").collect()), key=str)
    expected = []
    for doc, text in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc, len(ids), bytearray(b"".join(i.to_bytes(4, "little") for i in ids)), library.decode(ids, skip_special_tokens=False)))
    assert len(got) == len(expected)
    digest = lambda rows: sorted((str(d), n, hashlib.sha256(i).hexdigest(), t) for d, n, i, t in rows)
    assert digest(got) == digest(expected)
    assert bpe.encoded(no_docs, PATH).count() == 0
