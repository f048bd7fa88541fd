import hashlib

import numpy as np
import pytest

from ledgerline.llm import decontaminate as d
from ledgerline.llm.common import documents
from tests.llm.util import SF, WORD, docs_df, low


def brute(docs, bench):
    phrases = []
    for item, text in bench:
        w = WORD.findall(low(text))
        phrases += [(str(item) if item is not None else "null", w[k:k + 10]) for k in range(max(1, len(w) - 9) if w else 0)]
    at = {}
    for item, p in phrases:
        at.setdefault(tuple(p), set()).add(item)
    out = []
    for i, text in docs:
        w = WORD.findall(low(text))
        hit, items = set(), set()
        for n in {len(p) for p in at}:
            for k in range(len(w) - n + 1):
                if (found := at.get(tuple(w[k:k + n]))):
                    hit |= set(range(k, k + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(items), digest, bool(hit)))
    return sorted(out, key=str)


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_against_brute_force_on_the_tables(spark):
    docs, bench = documents(spark, SF), documents(spark, SF, "benchmark")
    got = d.query(docs, bench).select(COLS).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted(map(tuple, got), key=str) == want
    assert any(r.contaminated for r in got)


CASES = [(1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (None, "x Short ONE y"), (3, None), (4, ""),
         (5, "short one " * 5000), (6, "a b c d e f g h i a b c d e f g h i j"), (7, "é Ü ß!" * 3), (8, "..."), (9, "short, one"),
         (10, "a a a a a a a a a a a a a a a a"), (11, "a a a a a a a a a")]
BENCH = [(1, "A b c d e f g h i j k"), (2, "short one"), (2, "short one"), (3, None), (4, "!!"), (None, "é Ü"), (5, "a a a a a a a a a a a")]


def test_cases(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = d.query(docs_df(spark, CASES), bench).select(COLS).collect()
    assert sorted(map(tuple, got), key=str) == brute(CASES, BENCH)


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 20)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = d.query(docs_df(spark, CASES), bench).select(COLS).collect()
    assert sorted(map(tuple, got), key=str) == brute(CASES, BENCH)


def test_empty_tables(spark):
    docs = docs_df(spark, CASES)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in d.query(docs, none).collect())
    assert d.query(docs.limit(0), none).count() == 0


def test_removal_cuts_only_the_phrases(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = [(1, "Keep this. A, b c d-e f g h i j k! And this.", 5), (2, "short one", 9), (3, "clean  text\n", 1), (4, None, 0), (5, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in d.remove_contamination(docs, bench).collect()}
    assert got == {1: ("Keep this. ! And this.", 22), 3: ("clean  text\n", 1), 4: (None, 0), 5: ("", 0)}


@pytest.mark.parametrize("seed", range(5))
def test_index_finds_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    runs = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(30)] + [np.ones(50, int)]
    seq = np.concatenate([np.append(r, 0) for r in runs]).astype(np.int64)
    index = d.FmIndex(seq)
    phrases = np.array([[a, b, c] for a in range(1, 6) for b in range(1, 4) for c in range(1, 4)], np.int64)
    low_, high = index.search(phrases)
    for p, a, b in zip(phrases, low_, high, strict=True):
        want = [k for k in range(len(seq) - 2) if (seq[k:k + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
