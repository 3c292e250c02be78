import zlib

import numpy as np
from pyspark.sql import functions as F

from talentweave.llm import language_id, quality_classifier, queries
from talentweave.llm import textblocks as tb

SMALL = "/root/testdata/sf0.01"


def block(texts):
    raw = [t.encode() for t in texts]
    return tb.Block(0, len(raw), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))


def test_presence_kernel_equals_sets_of_grams():
    texts = ["Hello wörld", "", "aaa", "hello WÖRLD hello"]
    found = language_id.presence(block(texts))
    for row, text in zip(found, texts, strict=True):
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        grams = {(n, data[i : i + n]) for n in (1, 2, 3) for i in range(len(data) - n + 1)}
        places = {((int.from_bytes(g, "big") + (n << 24)) * 0x9E3779B1 % 2**32) >> 19 for n, g in grams}
        assert set(np.flatnonzero(row).tolist()) == places


def test_languages_of_held_out_texts(spark):
    found = queries.op8_language_id(spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark, docs, documents, no_docs):
    model = language_id.learned(spark.read.parquet(f"{SMALL}/documents.parquet"))
    found = language_id.identified(docs, model)
    assert found.count() == len(documents) and {"row", "lang", "lang_pred", "score"} <= set(found.columns)
    assert found.where("text is null or not text rlike '\\\\p{L}'").where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language_id.learned(no_docs) is None and language_id.learned(docs) is None  # no language known
    assert language_id.identified(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.identified(no_docs, model).count() == 0


def skewed_texts(letters, size, n, seed):
    """Texts in which nearly every pair of letters occurs, the first ones most often."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, len(letters) + 1)
    return ["".join(rng.choice(list(letters), size, p=share / share.sum())) for _ in range(n)]


def test_long_texts_keep_their_language(spark):
    letters = "abcdefghijklmnopqrstuvwxyz ,.;:!?"
    short = [(t, lang) for lang, own in (("x", letters), ("y", letters[::-1])) for t in skewed_texts(own, 1500, 40, 1)]
    long = [(t, lang) for lang, own in (("x", letters), ("y", letters[::-1])) for t in skewed_texts(own, 600_000, 4, 2)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(short)], "doc_id long, text string, lang string")
    model = language_id.learned(docs)
    scores = model.scores(block([t for t, _ in long]))
    assert [model.languages[i] for i in scores.argmax(axis=1)] == [lang for _, lang in long]
    assert np.all(np.abs(scores[:, 0] - scores[:, 1]) > 0.5)
    # a text is the mean of its chunks, whatever block it is in, and no gram between chunks is lost
    text = block([long[0][0], "abc", "", long[5][0][:30_000]])
    assert np.allclose(model.scores(text)[3], model.scores(block([long[5][0][:30_000]]))[0], atol=1e-5)
    owner, pieces = zip(*language_id.chunks(text), strict=True)
    assert np.bincount(np.concatenate(owner)).tolist() == [30, 1, 1, 2]
    assert np.array_equal(np.concatenate([language_id.presence(p) for p in pieces])[:30].max(axis=0), language_id.presence(text)[0])


def test_languages_of_long_texts_are_learnt(spark):
    rows = [(i, "short words here " * 20, "x") for i in range(20)] + [(i, "längere wörter ändern " * 2000, "y") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learned(docs)
    assert model.languages == ["x", "y"]
    assert language_id.identified(docs, model).where("lang <> lang_pred").count() == 0


def test_quality_of_held_out_texts(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = queries.op7_quality_classifier(spark, SMALL).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum(r.predicted == r.quality for r in rows) >= 0.85 * len(rows)
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_cases(spark, docs, documents, no_docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(0, 300, 3)] + [(None, 1, None), (4, None, None), (5, 7, None)], "doc_id long, quality int, text string")
    net = quality_classifier.learned(docs, labels, rows=60)
    found = quality_classifier.scored(docs, net)
    assert found.count() == len(documents) and found.where("score between 0 and 1").count() == len(documents)
    assert quality_classifier.learned(docs, labels.limit(0)) is None and quality_classifier.learned(no_docs, labels) is None
    assert quality_classifier.scored(docs, None).where("score <> 0.5").count() == 0
    assert quality_classifier.scored(no_docs, net).count() == 0


def test_scores_cover_whole_texts_and_blocks():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc d!"), 300)) for _ in range(40)]
    net = quality_classifier.train([t.encode() for t in texts], np.arange(40, dtype=np.float32) % 2, epochs=2)
    long = "a b c " * 20_000
    together = quality_classifier.scores(net, block(texts + ["", long + "!!!!!!"]))
    alone = np.concatenate([quality_classifier.scores(net, block([t])) for t in texts + ["", long + "!!!!!!"]])
    assert np.allclose(together, alone, atol=1e-5)
    starts, rows = quality_classifier.chunked(block([long]))
    assert starts[0] == 0 and np.all(np.diff(starts) < quality_classifier.CHUNK) and starts[-1] + quality_classifier.CHUNK >= len(long)


def test_folds(spark):
    ids = spark.range(200).select("id", quality_classifier.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids)
