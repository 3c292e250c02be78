import brute
from pyspark.sql import functions as F

from talentweave.llm import decontamination, near_duplicates, substring_duplicates


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def same(frame, columns, expected):
    got = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_decontamination_equals_brute_force(spark, docs, documents, no_docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    words = documents[7][1].split()
    items += [(900, "one two three"), (901, None), (902, ""), (903, " ".join(words[:40])), (903, " ".join(words[:40])), (None, " ".join(words[3:20])), (904, "One"), (905, "w5x5 w6x6 w7x7 w8x8")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = decontamination.contaminated(docs, bench).withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
    expected = brute.decontamination(documents, items)
    assert sum(r[5] for r in expected) > 10
    same(found, columns, expected)
    assert decontamination.contaminated(no_docs, bench).count() == 0
    none = decontamination.contaminated(docs, bench.limit(0))
    assert none.count() == len(documents) and none.where("contaminated or n_items > 0").count() == 0


def test_near_duplicates_equal_brute_force(docs, documents, no_docs):
    expected = brute.near_duplicates(documents, 85)
    assert sum(not r[3] for r in expected) > 10
    same(near_duplicates.near_duplicate_classes(docs, 85), ["doc_id", "n_shingles", "component_id", "kept"], expected)
    assert near_duplicates.near_duplicate_classes(no_docs).count() == 0


def test_near_duplicate_chains_link_through_every_member(spark):
    """Neighbours in the chain are close, its ends are not; the smallest id is in the middle."""
    base = [f"w{i}" for i in range(200)]
    chain = []
    for i in range(12):
        chain.append((100 + i if i != 6 else 1, " ".join(base)))
        base = base[:i * 8] + [f"v{i}.{j}" for j in range(3)] + base[i * 8 + 3:]
    docs = spark.createDataFrame(chain, "doc_id long, text string")
    same(near_duplicates.near_duplicate_classes(docs, 85), ["doc_id", "n_shingles", "component_id", "kept"], brute.near_duplicates(chain, 85))


def test_odd_sketch_limit_and_bands():
    assert near_duplicates.bands_for(85) == 37 and near_duplicates.bands_for(80) == 63
    assert near_duplicates.sketch_limit(80) < near_duplicates.SKETCH_BITS / 2


def test_odd_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 850).astype(np.uint64)
    sets = [np.concatenate([common, rng.integers(0, 2**63, 75).astype(np.uint64)]) for _ in range(2)]
    starts = np.array([0, 925, 1850])
    least = near_duplicates.least_samples(starts, np.concatenate(sets), near_duplicates._multipliers(near_duplicates.SAMPLES))
    a, b = near_duplicates.folded(least)
    differing = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
    bits = near_duplicates.SKETCH_BITS
    estimate = 1 + bits / 4 / near_duplicates.SAMPLES * np.log(1 - 2 * differing / bits)
    assert abs(estimate - 0.85) < 0.07 and differing <= near_duplicates.sketch_limit(85)


def test_substrings_equal_brute_force(docs, documents, no_docs):
    expected = brute.substring(documents)
    assert sum(r[2] > 0 for r in expected) > 10
    same(substring_duplicates.without_repeats(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"], expected)
    assert substring_duplicates.without_repeats(no_docs).count() == 0


def test_passages_met_in_different_documents(spark):
    """A window whose anchor's smallest document lacks it, a passage twice in one text, passages ending at text edges."""
    w = [f"a{i}" for i in range(300)]
    rows = [
        (1, " ".join(w[40:100])), (2, " ".join(["x"] * 5 + w[0:120])), (3, " ".join(w[10:90] + ["y"] * 60 + w[10:75])),
        (4, " ".join(w[0:49])), (5, " ".join(["q"] + w[60:200] + w[60:200])), (6, " ".join(w[20:260])), (7, " ".join(["same"] * 200)), (8, " ".join(["same"] * 90)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (50, 20):
        same(substring_duplicates.without_repeats(docs, size), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.substring(rows, size))


def test_factors_name_equal_words_of_earlier_documents(spark, docs, documents):
    keyed = docs.select("doc_id", "text").withColumn("row", F.crc32(F.col("text").cast("binary")))
    texts = {}
    for doc, text in documents:
        texts.setdefault(doc, []).append(brute.BLANK.findall(text or ""))
    found = substring_duplicates.factors(keyed).join(keyed, ["doc_id", "row"]).collect()
    assert len(found) > 10
    for r in found:
        words = brute.BLANK.findall(r.text)
        for s in r.spans:
            assert s.reference < r.doc_id and s.hi - s.lo >= 50
            assert words[s.lo : s.hi] in [w[s.reference_lo : s.reference_lo + s.hi - s.lo] for w in texts[s.reference]]
    # a whole copy is one factor, however many blocks it has
    base = [f"b{i}" for i in range(2000)]
    copies = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(["x"] * 9 + base)), (3, "y " + " ".join(base[100:]))], "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in substring_duplicates.factors(copies.withColumn("row", F.crc32(F.col("text").cast("binary")))).collect()}
    assert spans[2] == [(9, 2009, 1, 0)] and spans[3] == [(1, 1901, 1, 100)]
