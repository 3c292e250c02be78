"""BM25, hashed vectors, encoders, vocabulary, gate and dictionary matching against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.operators import lexical, vocabulary
from talentweave.operators.vocabulary import SkillGate

random.seed(3)
WORDS = [f"w{i}" for i in range(25)]
DOCS = {i: random.choices(WORDS, k=random.randint(0, 12)) for i in range(40)}
ASKS = {i: random.choices(WORDS + ["unseen"], k=5) for i in range(6)}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id long, tokens array<string>")


@pytest.mark.parametrize("distinct", [True, False])
def test_bm25(spark, distinct):
    docs = {k: list(dict.fromkeys(v)) if distinct else v for k, v in DOCS.items()}
    asks = {k: list(dict.fromkeys(v)) if distinct else v for k, v in ASKS.items()}
    lengths = {k: max(1, len(v)) for k, v in docs.items()}
    average = sum(lengths.values()) / len(lengths)
    df = Counter(t for v in docs.values() for t in set(v))
    idf = {t: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}

    def score(q, d):
        tf = Counter(docs[d])
        return sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * lengths[d] / average)) for t in asks[q] if tf[t])

    got = lexical.bm25_rankings(frame(spark, asks), frame(spark, docs), 100)
    rows = got.collect()
    assert {(r["user_id"], r["job_id"]) for r in rows} == {(q, d) for q in asks for d in docs if score(q, d) > 0}
    for r in rows:
        assert r["score"] == pytest.approx(score(r["user_id"], r["job_id"]), abs=1e-8)


def test_hashed_vectors(spark):
    docs = {k: list(dict.fromkeys(v)) for k, v in DOCS.items()}
    df = Counter(t for v in docs.values() for t in v)
    idf = {t: math.log(1 + len(docs) / (1 + n)) for t, n in df.items()}

    def vector(tokens):
        v = np.zeros(16)
        for t in tokens:
            n = int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
            v[n % 16] += (1.0 if n % 2 == 0 else -1.0) * idf.get(t, 1.0)
        norm = np.linalg.norm(v)
        return v / norm if norm > 0 else v

    asks = {k: list(dict.fromkeys(v)) for k, v in ASKS.items()}
    for r in lexical.hashed_rankings(frame(spark, asks), frame(spark, docs), 100, dim=16).collect():
        assert r["score"] == pytest.approx(float(vector(asks[r["user_id"]]) @ vector(docs[r["job_id"]])), abs=1e-8)


def test_encoders_give_unit_vectors(spark):
    df = spark.createDataFrame([(1, "spark sql"), (2, ""), (3, "sql python")], "k long, t string")
    seen = lexical.encode_texts(df, "k", "t", lambda texts: np.array([[len(t), 1.0] for t in texts]), prefix="q:")
    rows = {r["id"]: r["vector"] for r in seen.collect()}
    assert rows[2] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])
    built_in = {r["id"]: np.array(r["vector"]) for r in lexical.tfidf_encode(df, "k", "t", 64).collect()}
    assert np.linalg.norm(built_in[1]) == pytest.approx(1.0) and np.linalg.norm(built_in[2]) == 0


# Gate and vocabulary --------------------------------------------------------------------------


def tags(spark, rows):
    return vocabulary.user_tags(spark.createDataFrame(list(enumerate(rows)), "user_id long, experience string"))


def test_generic_terms_and_short_english_stay_out(spark):
    rows = tags(spark, ["Python|自我评价|沟通|or|C++|客户", "Python|学历|or|C++|责任心"])
    vocab = vocabulary.build_vocabulary(rows, 1, SkillGate.from_mapping({"enabled": True}))
    found = {r["skill"]: r["skill_id"] for r in vocab.collect()}
    assert set(found) == {"python", "c++", "沟通", "责任心"}
    assert [s for s, _ in sorted(found.items(), key=lambda x: x[1])] == sorted(found)


def test_occupation_terms_are_no_skills(spark):
    reference = spark.createDataFrame(
        [("occupation", "计算机程序设计员"), ("category", "工程技术人员"), ("work_type", "低代码开发员"), ("task", "编写代码")], "kind string, term string"
    )
    tokens = spark.createDataFrame([(t,) for t in ("计算机程序设计员", "工程技术人员", "低代码开发员", "python", "编写代码", "执行力", "qz", "go", "")], "token string")
    got = {r["token"]: (r["keep"], r["skill_type"], r["weight"]) for r in vocabulary.gate_decisions(tokens, SkillGate(), reference).collect()}
    assert not any(got[t][0] for t in ("计算机程序设计员", "工程技术人员", "低代码开发员", "qz", ""))
    assert got["python"] == (True, "hard_or_knowledge", 1.0)
    assert got["编写代码"] == (True, "reference_task", 1.0)
    assert got["执行力"] == (True, "transversal", 0.35)
    assert got["go"][0]
    off = vocabulary.gate_decisions(tokens, SkillGate.from_mapping(None), reference)
    assert off.where("keep").count() == 9


def test_minimum_count_and_tag_ids(spark):
    rows = tags(spark, ["b|a|c", "a|b", "c|z"])
    vocab = vocabulary.build_vocabulary(rows, 2)
    ids = {r["skill"]: r["skill_id"] for r in vocab.collect()}
    assert ids == {}  # single characters are no tags
    rows = tags(spark, ["bb|aa|cc", "aa|bb", "cc|zz"])
    vocab = vocabulary.build_vocabulary(rows, 2)
    assert {r["skill"]: r["skill_id"] for r in vocab.collect()} == {"aa": 0, "bb": 1, "cc": 2}
    assert {r["user_id"]: r["skill_ids"] for r in vocabulary.ids_of_tags(rows, vocab, 2).collect()} == {0: [1, 0], 1: [0, 1], 2: [2]}


def test_ascii_boundaries(spark):
    vocab = spark.createDataFrame([("go", 0, 1.0), ("sql", 1, 1.0)], "skill string, skill_id int, weight double")
    jobs = spark.createDataFrame([("j", "golang开发工程师", "需要 sql 数据处理经验, 也需要 go 服务开发。")], "job_id string, title string, description string")
    got = {r["skill_id"]: r["score"] for r in vocabulary.match_dictionary(vocabulary.text_fields(jobs), vocab).collect()}
    assert got == {0: pytest.approx(1.2), 1: pytest.approx(1.3)}
    loose = vocabulary.match_dictionary(vocabulary.text_fields(jobs), vocab, strict_boundaries=False)
    assert {r["skill_id"]: r["score"] for r in loose.collect()} == {0: pytest.approx(2 * 1.2 + 1.2), 1: pytest.approx(1.3)}


def brute_matches(text, terms):
    found = Counter()
    text = text.lower()
    edge = set("abcdefghijklmnopqrstuvwxyz0123456789+#.")
    for term, (skill_id, weight) in terms.items():
        plain = all(c in edge or c == "-" for c in term)
        for at in range(len(text) - len(term) + 1):
            if text[at : at + len(term)] != term:
                continue
            before, after = text[at - 1 : at] if at else "", text[at + len(term) : at + len(term) + 1]
            if plain and (before in edge and before or after in edge and after):
                continue
            found[skill_id] += weight * (1 + 0.1 * len(term))
    return found


@pytest.mark.parametrize("piece", [5, 512])
def test_dictionary_matching_equals_search(spark, monkeypatch, piece):
    monkeypatch.setattr(vocabulary, "PIECE_CHARS", piece)
    rng = random.Random(9)
    terms = {"".join(rng.choices("ab+开发", k=rng.randint(2, 6))): None for _ in range(40)}
    terms = {t: (i, rng.choice([1.0, 0.35])) for i, t in enumerate(terms)}
    texts = {i: "".join(rng.choices("ab+ 开发A", k=rng.randint(0, 40))) for i in range(30)}
    vocab = spark.createDataFrame([(t, i, w) for t, (i, w) in terms.items()], "skill string, skill_id int, weight double")
    fields = spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("field_weight", F.lit(1.0))
    got = {(r["id"], r["skill_id"]): r["score"] for r in vocabulary.match_dictionary(fields, vocab).collect()}
    want = {(i, s): v for i, t in texts.items() for s, v in brute_matches(t, terms).items()}
    assert got == pytest.approx(want)


def test_last_id_wins_when_cases_collide(spark):
    vocab = spark.createDataFrame([("ÄB", 0, 1.0), ("äb", 1, 0.5)], "skill string, skill_id int, weight double")
    fields = spark.createDataFrame([(1, "x äb", 1.0)], "id long, text string, field_weight double")
    assert [tuple(r) for r in vocabulary.match_dictionary(fields, vocab).collect()] == [(1, 1, pytest.approx(0.6))]


def test_top_skills_are_cut_and_rounded(spark):
    rows = spark.createDataFrame([("j", 3, 1.23456), ("j", 1, 2.0), ("j", 2, 2.0)], "id string, skill_id int, score double")
    row = vocabulary.top_skills(rows, 2).first()
    assert row["skill_ids"] == [1, 2] and row["skill_weights"] == [2.0, 2.0]
    assert vocabulary.top_skills(rows, 3).first()["skill_weights"][2] == 1.235
