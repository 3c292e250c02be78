import random
import re
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talentweave.llm import edit_counts, line_labelling, queries, sharding
from talentweave.llm import textblocks as tb

SMALL = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def base_counts(text):
    words = brute.BLANK.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    repeated = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if brute.BLANK.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated), failed


def test_base_counts(docs, documents, no_docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = line_labelling.judged(docs, None)
    got = sorted((tuple(r) for r in found.select(*columns).collect()), key=str)
    assert got == sorted(((d, *base_counts(t)) for d, t in documents), key=str)
    assert found.where("base_failed and kept").count() == 0
    assert line_labelling.judged(no_docs, None).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, 3, 0, 7, 1]
    rows = np.concatenate([[0], np.cumsum(sizes)])
    field = line_labelling.Field(rng.normal(size=line_labelling.FEATURES), rng.normal(size=(2, 2)))
    lines = line_labelling.Lines(rows, rng.normal(size=(rows[-1], line_labelling.FEATURES)), np.ones(rows[-1]))
    got, score = line_labelling.viterbi(field, lines), field.emissions(lines.features)
    for i, n in enumerate(sizes):
        own = score[rows[i] : rows[i + 1]]
        value = lambda path: sum(own[t, s] for t, s in enumerate(path)) + sum(field.steps[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, B905, E731
        if n:
            best = max((tuple(int(b) for b in np.binary_repr(k, n)) for k in range(2**n)), key=value)
            assert tuple(got[rows[i] : rows[i + 1]]) == best


def test_field_tells_good_texts_from_bad(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = queries.op10_quality_rules(spark, SMALL).join(labels, "doc_id").where("not base_failed").collect()
    assert len(rows) > 200
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.97
    assert sum(r.kept == bool(r.quality) for r in rows) > 0.93 * len(rows)


def test_field_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300, 3)] + [(None, 1), (4, None)], "doc_id long, quality int")
    field = line_labelling.learned(docs, labels, rows=40)
    assert line_labelling.judged(docs, field).where("kept is null").count() == 0
    assert line_labelling.learned(docs, labels.limit(0)) is None and line_labelling.learned(no_docs, labels) is None


def test_hilbert_index_is_a_curve():
    for dims, bits in ((2, 4), (3, 3)):
        side = np.arange(1 << bits)
        cells = np.stack(np.meshgrid(*[side] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        assert np.all(np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1)


def test_shards(spark, docs, documents, no_docs, tmp_path):
    rows = [tuple(r) for r in sharding.document_shards(docs).select("doc_id", "size", "text_crc32", "shard", "slot", "law", "grown_shard").collect()]
    import zlib

    raw = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in documents)
    assert Counter(r[:3] for r in rows) == raw and all(r[5:] == ("rows", None) for r in rows)
    counts = Counter(r[3] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r[4] for r in rows if r[3] == s) == list(range(counts[s])) for s in counts)
    assert sharding.document_shards(no_docs).count() == 0
    assert {r.shard for r in sharding.document_shards(docs.where("doc_id < 3")).collect()} == {0, 5, 10}
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = sharding.document_shards(given)
    # pruning: shards are narrow in each dimension, against a cut by a hash
    narrow = lambda by: sum(r.n for r in plan.groupBy(by).agg((F.countDistinct("lang") * F.countDistinct("source")).alias("n")).collect())
    assert narrow("shard") < 0.6 * narrow((F.col("text_crc32") % 16).alias("shard"))
    sharding.write_shards(given, plan, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 1000


def test_texts_of_one_prefix_have_cells(spark):
    names = [None, ""] + [f"https://www.site-{i:03d}.example" for i in range(70)] + ["https://www.é"]
    rows = [(n, i) for k, n in enumerate(names) for i in range(200 if k == 40 else 1 + k % 5)]
    df = spark.createDataFrame(rows, "source string, size long").repartition(7)
    known = sorted(n for n, _ in rows if n is not None)
    bounds = sorted({known[-(-i * len(known) // 32) - 1] for i in range(1, 32)})
    assert sharding.cuts(df, ["source"], 5)["source"] == bounds and len(bounds) > 15
    found = {(r.source, r.curve) for r in sharding.with_curve(df, ["source"]).collect()}
    cells = {n: sum(b <= n for b in bounds) if n is not None else 0 for n in names}
    assert found == {(n, int(sharding.hilbert_index(np.array([[c]]), 5)[0])) for n, c in cells.items()}
    assert len({c for _, c in found}) > 15
    assert sharding.with_curve(df.limit(0), ["source", "size"]).count() == 0
    assert {r.curve for r in sharding.with_curve(df.where("source is null"), ["source"]).collect()} == {0}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_follow_edits(library, documents):
    own, rng = edit_counts.Counter(PATH, public_tokenizers.PATTERN), random.Random(5)
    count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    for _, text in documents[:60] + [r for r in documents if r[0] and r[0] >= 1000]:
        text = (text or "")[:20_000]
        tree = edit_counts.Tree(text, edit_counts.tree_of(own.leaves(text)), own)
        assert tree.tokens == count(text)
        for _ in range(12):
            at, removed = rng.randrange(-2, len(tree.text) + 3), rng.choice([0, 0, 1, 7, 300])
            inserted = rng.choice(["", " ", "  ", "\n", "x", " new words here", "'", "é", "1", "\n\n  y " * 3, "word " * 400])
            low = min(max(at, 0), len(tree.text))
            expected = tree.text[:low] + inserted + tree.text[low:][removed:]
            tree.edit(at, removed, inserted)
            assert tree.text == expected and tree.tokens == count(expected)
            assert tree.nodes[0, 0] == len(expected)


def test_edits_at_leaf_boundaries(library):
    own = edit_counts.Counter(PATH, public_tokenizers.PATTERN)
    count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    # pairs that a leaf boundary parts, and what follows them
    parted = [("\n", "\nx"), ("\n\n", " x"), (" \t", "\n1"), ("\n", "\n"), ("'", "rx"), ("'", "vx"), ("'", "s"), ("'", "l"), ("'", "x"), ("x", "'s"), (" ", "'re"), ("\u3000", "\u2003é"), ("!", "!?")]
    for before, after in parted:
        for pieces in range(edit_counts.LEAF - 4, edit_counts.LEAF + 1):
            text = " a" * pieces + before + after + " b" * 200
            place = 2 * pieces + len(before)
            for at in range(place - 3, place + 5):
                for removed in (0, 1, 2):
                    for inserted in ("", " ", "\n", " inserted ", "x", "e", "l", "'", "1"):
                        tree = edit_counts.Tree(text, edit_counts.tree_of(own.leaves(text)), own)
                        tree.edit(at, removed, inserted)
                        assert tree.text == text[:at] + inserted + text[at + removed :]
                        assert np.array_equal(tree.nodes[0], own.leaves(tree.text).sum(axis=0)), (text[:place], at, removed, inserted)
    tree = edit_counts.Tree(" a" * 63 + "\n\nx", edit_counts.tree_of(own.leaves(" a" * 63 + "\n\nx")), own)
    tree.edit(128, 0, " inserted ")
    assert tree.tokens == count(tree.text) == 66


def test_edits_touch_little(documents):
    own = edit_counts.Counter(PATH, public_tokenizers.PATTERN)
    text = " ".join(f"word{i}" for i in range(40_000))
    tree = edit_counts.Tree(text, edit_counts.tree_of(own.leaves(text)), own)
    tree.edit(100_000, 5, "abc")
    assert tree.encoded <= 4 * edit_counts.LEAF


def test_long_words_stay_leaves(library):
    own = edit_counts.Counter(PATH, public_tokenizers.PATTERN)
    text = "word " * 80_000 + "x" * 20_000 + " tail" * 100
    tree = edit_counts.Tree(text, edit_counts.tree_of(own.leaves(text)), own)
    count = lambda: len(library.encode(tree.text, add_special_tokens=False).ids)
    for at in (400_100, 405_000, 410_000, 419_990, 399_999):
        tree.edit(at, 0, "y")
    assert tree.tokens == count() and tree.encoded <= 5 * 3 * edit_counts.LEAF
    # a long insertion is dealt to leaves of its own, and later edits touch little of it
    tree.edit(1000, 3, "new words here " * 2000)
    before = tree.encoded
    for at in (1500, 9000, 20_000):
        tree.edit(at, 2, "é!")
    assert tree.tokens == count() and tree.encoded - before <= 3 * 4 * edit_counts.LEAF
    tree.edit(0, len(tree.text), "")
    assert tree.tokens == 0 and tree.text == ""
    tree.edit(0, 0, "again " * 500)
    assert tree.tokens == count()


def test_edit_table(spark, docs, documents, no_docs, library):
    kept = edit_counts.trees(docs, PATH, public_tokenizers.PATTERN)
    edits = spark.createDataFrame([(3, 1, 10, 5, "abc"), (3, 0, 0, 0, "start "), (7, 0, 999_999, 9, " end"), (1001, 0, 0, 4, "x y"), (8, 0, None, None, None), (None, 0, 1, 1, "z")], "doc_id long, seq int, at int, removed int, inserted string")
    found = edit_counts.edited(edit_counts.with_edits(kept, edits), PATH, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in found.collect() if r.doc_id is not None and r.doc_id != 2000}
    texts = dict(r for r in documents if r[0] is not None)
    texts[3] = ("start " + texts[3])[:10] + "abc" + ("start " + texts[3])[15:]
    texts[7] += " end"
    texts[1001] = "x y"
    assert found.count() == len(documents)
    for doc, text in texts.items():
        if doc != 2000:
            assert rows[doc].text == (text or "") and rows[doc].n_tokens == len(library.encode(text or "", add_special_tokens=False).ids)
    assert edit_counts.trees(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_query_counts_texts_before_and_after(spark, library, tmp_path):
    given = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 40").collect()}
    spark.createDataFrame(list(given.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    rows = queries.op4_token_counts(spark, str(tmp_path)).collect()
    assert len(rows) == len(given)
    for r in rows:
        text, third = given[r.doc_id], len(given[r.doc_id]) // 3
        after = text[:third] + str(r.doc_id) + text[third + 7 :]
        place = min(2 * len(text) // 3, len(after))
        after = after[:place] + " inserted " + after[place:] + "\n" + str(r.doc_id)
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited) == (count(text), count(after), len(after))


def test_words_of_long_rows_are_hashed_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a bb " * 3000 + "x" * 9000 + " end", None, "", "tail"])
    whole = [tb.words(b, "blank").hash for b in tb.blocks(texts)]
    monkeypatch.setattr(tb, "BLOCK_BYTES", 1000)
    pieces = [tb.words(b, "blank").hash for b in tb.blocks(texts, 1000)]
    assert np.array_equal(np.concatenate(whole), np.concatenate(pieces))
