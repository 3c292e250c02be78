import brute
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def expected(docs, items):
    """Stages 2 to 5 in plain Python over (doc_id, text)."""
    gone = brute.line_duplicates(docs)
    left = []
    for doc, text in docs:
        lines = text.split("\n")
        kept = [x for i, x in enumerate(lines) if (doc, i) not in gone]
        if len(kept) == len(lines):
            left.append((doc, text))
        elif any(brute.BLANK.search(x) for x in kept):
            left.append((doc, "\n".join(kept)))
    near = {r[0] for r in brute.near_duplicates(left, 80) if r[3]}
    left = [r for r in left if r[0] in near]
    clean = {r[0] for r in brute.decontamination(left, items) if not r[5]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: library.encode(t, add_special_tokens=False).ids for d, t in left if d in clean}


def test_run_equals_brute_force(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = corpus_pipeline.identify_language(spark, given, SMALL)
    docs = [(r.doc_id, r.text) for r in first.orderBy("doc_id").collect()]
    assert len(docs) > 0.95 * given.count()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = expected(docs, items)
    rows = corpus_pipeline.run(spark, SMALL).collect()
    got = {r.doc_id: [int.from_bytes(r.ids_le[i : i + 4], "little") for i in range(0, len(r.ids_le), 4)] for r in rows}
    assert len(rows) == len(got) and got == want
    assert len(want) < len(docs)


def test_stages_stand_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    extra = docs.limit(3).select(
        F.col("doc_id") + 5000, F.element_at(F.array(F.lit(None), F.lit(""), F.lit("11 22 !!")), (F.row_number().over(__import__("pyspark").sql.Window.orderBy("doc_id"))).cast("int")).alias("text"),
        F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"),
    )
    odd = docs.unionByName(extra.toDF(*docs.columns)).unionByName(docs.limit(2)).withColumn("row", F.lit("clash")).withColumn("score", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (odd, odd.limit(0)):
            out = stage(spark, frame, SMALL)
            assert out.columns == odd.columns
            assert out.count() <= frame.count()
    assert corpus_pipeline.encode(spark, odd, SMALL).count() == odd.count()
    kept = corpus_pipeline.identify_language(spark, odd, SMALL)
    assert kept.where("doc_id >= 5000").count() == 0


def test_given_columns_come_through(spark):
    names = ["score", "lang_pred", "_letter", "row", "given", "kept", "component_id", "contaminated", "gone", "_rest", "place"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.lit(":"), F.col("doc_id")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[name] == f"{name}:{r.doc_id}" for r in rows for name in names)


def test_registration():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
