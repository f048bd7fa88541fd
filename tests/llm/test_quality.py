import math

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import quality as q
from ledgerline.llm.common import documents
from tests.llm.util import SF, TOKEN

COLS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(i, text):
    text = text or ""
    w = TOKEN.findall(text)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k:k + 8]), []).append(k)
    rep = {p for ks in at.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if TOKEN.search(x)]
    n, r = len(w), len(rep)
    return (i, n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n)


LABELS = "doc_id long, quality int, note string"


def docs_df(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in rows], "doc_id long, text string, lang string, _text string, n_words int")


def test_base_counts_on_the_table(spark):
    docs = documents(spark, SF)
    got = q.query(docs, documents(spark, SF, "labels")).select(COLS).collect()
    assert sorted(map(tuple, got)) == sorted(brute(r.doc_id, r.text) for r in docs.collect())


CASES = [(1, None, None), (2, "", "en"), (3, " \n\t\x0b", "en"), (None, "one", "de"), (5, "a b c d e f g h " * 3, "en"), (5, "a " * 20_000, "en"),
         (6, "x#*$%&|<>y é\n\nline\nline\n line", "fr"), (7, " ".join(f"w{k}" for k in range(30)), None), (7, " ".join(f"w{k}" for k in range(30)), None),
         (8, "a b c d e f g h i a b c d e f g h i j", "en"), (9, "word joined word", "en")]


def test_cases_without_labels(spark):
    none = spark.createDataFrame([], LABELS)
    got = q.query(docs_df(spark, CASES), none).collect()
    want = [brute(i, t) for i, t, _ in CASES]
    assert sorted((tuple(r[c] for c in COLS) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert q.query(docs_df(spark, []), none).count() == 0


@pytest.mark.parametrize("n,k,rate", [(1, 0, 0.5), (10, 1, 0.3), (300, 0, 0.02), (300, 3, 0.02), (5000, 80, 0.02), (200000, 3800, 0.02), (50, 20, 0.1)])
def test_binomial_tail(spark, n, k, rate):
    got = spark.range(1).select(q.binomial_tail(F.lit(k), F.lit(n), rate)).first()[0]
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(rate) + (n - j) * math.log(1 - rate))
                     for j in range(k + 1)) if k < n * rate else 1.0
    assert got == pytest.approx(want, rel=1e-6)


def plain(k):
    return " ".join(f"word{k}x{j}" for j in range(30))


def shouting(k):
    return plain(k).upper()


def test_cutoffs_reject_junk_and_keep_their_promise(spark):
    rows, labels = [], []
    for k in range(3000):
        lang = "aa" if k % 3 else ["b1", "b2", None][k // 3 % 3]
        bad = k % 10 == 0
        rows.append((k, shouting(k) if bad else plain(k), lang))
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1, None))
    labels += [(2, 1, "again"), (4, None, "no label"), (None, 0, "no id")]
    got = {r.doc_id: r.kept for r in q.query(docs_df(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert got == {k: k % 10 != 0 for k in range(3000)}


def test_a_rung_that_would_reject_good_documents_is_not_chosen(spark):
    # one good document in ten shouts: a rung that rejects them all may not be certified
    rows = [(k, shouting(k) if k % 10 == 0 or k % 17 == 0 else plain(k), "aa") for k in range(2000)]
    labels = spark.createDataFrame([(k, 0 if k % 17 == 0 else 1, "") for k in range(2000)], LABELS)
    got = q.query(docs_df(spark, rows), labels).collect()
    assert sum(not r.kept for r in got if r.doc_id % 17) <= 0.02 * 1882
    few = labels.where("doc_id < 100")                     # too few labels to certify anything
    assert all(r.kept for r in q.query(docs_df(spark, rows), few).collect())


def test_stage_keeps_the_columns(spark):
    docs = docs_df(spark, [(1, plain(1), "en"), (2, "short", "en"), (None, plain(2), None)])
    out = q.keep_good(docs, spark.createDataFrame([], LABELS))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0 for r in out.collect())) == [0, 1]


def test_native(spark):
    plan = q.query(documents(spark, SF), documents(spark, SF, "labels"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
