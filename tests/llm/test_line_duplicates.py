import random

import brute
from pyspark.sql import functions as F

from talentweave.llm import line_duplicates


def removed(frame):
    return {(r.doc_id, i) for r in frame.collect() for i in r.removed_lines}


def test_edits_equal_brute_force(spark):
    rng = random.Random(11)
    lines = ["".join(rng.choices("abcdé ", k=rng.choice([5, 19, 20, 21, 40, 41, 300]))) for _ in range(60)]
    rows = []
    for doc in range(120):
        own = []
        for _ in range(rng.randrange(1, 5)):
            line = rng.choice(lines)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(line) + 1)
                line = rng.choice([line[:at] + rng.choice("abzé") + line[at:], line[:at] + line[at + 1 :], line[:at] + "q" + line[at + 1 :]])
            own.append(line)
        rows.append((doc, "\n".join(own)))
    base = "".join(rng.choices("xyz", k=5000))
    rows += [(200, base), (201, base[:1234] + "!" + base[1235:]), (202, base[1:]), (203, base + "."), (204, "aaaaaaaaaaaaaaaaaaaaaaaa"), (205, "aaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaaa")]
    expected = brute.line_duplicates(rows)
    found = line_duplicates.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert removed(found) == set(expected)
    assert found.agg(F.sum("n_near")).first()[0] == sum(expected.values()) > 20


def test_given_documents_and_odd_rows(docs, documents, no_docs):
    plain = [r for r in documents if r[0] is not None and r[0] != 2000] + [(2000, documents[-5][1])]
    expected = brute.line_duplicates(plain)
    found = line_duplicates.line_report(docs)
    assert found.count() == len(documents) and removed(found) == set(expected)
    texts = line_duplicates.without_duplicate_lines(docs)
    assert texts.columns == docs.columns and texts.count() == len(documents)
    wanted = {}
    for doc, text in plain:
        lines = text.split("\n") if text is not None else []
        left = [x for i, x in enumerate(lines) if (doc, i) not in expected]
        changed = len(left) < len(lines)
        wanted[doc] = text if not changed else "\n".join(left) if any(brute.BLANK.search(x) for x in left) else None
    got = {r.doc_id: r.text for r in texts.where("doc_id is not null").collect()}
    assert got == wanted
    assert {r.text for r in texts.where("doc_id is null").collect()} == {t for d, t in documents if d is None}
    assert line_duplicates.line_report(no_docs).count() == 0 and line_duplicates.without_duplicate_lines(no_docs).count() == 0


def test_no_python_in_the_plan(docs):
    plan = line_duplicates.line_report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
