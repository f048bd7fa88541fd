import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import suffix_dedup as s
from ledgerline.llm.common import documents
from tests.llm.util import SF, docs_df


def brute(rows, width=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k:k + width] for t in raw for k in range(len(t) - width + 1))
    out = []
    for (i, _), t in zip(rows, raw, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - width + 1):
            if seen[t[k:k + width]] > 1:
                gone[k:k + width] = True
        gone = gone[:-1]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def got(df):
    return sorted((tuple(r) for r in s.query(df).select(COLS).collect()), key=str)


def test_whole_table(spark):
    docs = documents(spark, SF)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs) == want
    assert any(x[2] for x in want) and any(not x[2] for x in want)


def cases():
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    p, q, e = text(230), text(199), text(200)
    return [(1, None), (2, ""), (3, p), (3, p), (4, text(100) + p + text(50)), (5, q), (6, q), (None, "x" + e), (8, e + "y"), (9, "a" * 3000),
            (10, "ab" * 150), (11, text(500)), (12, p[:210] + text(30) + p[20:]), (13, (text(300)) * 2), (14, "z" * 199), (15, "z" * 200), (16, "w" * 201)]


@pytest.mark.parametrize("small", [False, True])
def test_cases(spark, monkeypatch, small):
    if small:                                              # every way beyond a bound
        monkeypatch.setattr(s, "SHARD", 300)
        monkeypatch.setattr(s, "BITS", 256)
        monkeypatch.setattr(s, "PIECE", 500)
        monkeypatch.setattr(s, "HOT", 1)
        monkeypatch.setattr(s, "RUN", 40)
    rows = cases()[:12 if small else None]
    assert got(docs_df(spark, rows)) == brute(rows)


def test_empty(spark):
    assert got(docs_df(spark, [])) == []


def test_many_different_runs_of_one_minimizer(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT", 5)
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    common = text(150)
    rows = [(k, text(120) + common + text(120)) for k in range(30)] + [(99, "")]
    rows += [(100, "tail" + rows[3][1][60:330]), (101, rows[3][1][70:300] + "head")]
    assert got(docs_df(spark, rows)) == brute(rows)


@pytest.mark.parametrize("seed", range(10))
def test_equal_windows_are_in_runs_of_equal_minimizers(seed):
    rng = np.random.default_rng(seed)
    part = rng.integers(97, 100, 80).astype(np.uint8)
    raw = [bytes(np.concatenate([rng.integers(97, 100, int(rng.integers(0, 60))).astype(np.uint8), part])) for _ in range(4)] + [b"", b"a" * 100]
    data, ends = s._layout(raw)
    key, first, size, places = s.runs(data, ends, 40, 8)
    grams = s.gram_hashes(data, 8).view(np.int64)
    assert places.tolist() == [int((grams[a:a + n + 32] == k).sum()) for k, a, n in zip(key, first, size, strict=True)]
    keys = {}
    covered = set()
    for k, a, n in zip(key, first, size, strict=True):
        for w in range(a, a + n):
            assert w not in covered
            covered.add(w)
            assert keys.setdefault(bytes(data[w:w + 40]), k) == k
    starts = np.concatenate([[0], ends[:-1]])
    assert covered == {w for a, b in zip(starts, ends, strict=True) for w in range(a, b - 39)}
