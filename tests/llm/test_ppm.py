import math
import random
import zlib
from collections import Counter

import pytest

from ledgerline.llm import ppm
from ledgerline.llm.common import documents
from tests.llm.util import SF, TOKEN, docs_df, low


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Brute:
    """PPM with method C escapes and exclusion, symbol by symbol."""

    def __init__(self, training, order, most):
        self.order, self.counts = order, {}
        for t in training:
            x = [0] * order + list(t) + [256]
            for i in range(order, len(x)):
                for k in range(order + 1):
                    self.counts.setdefault(tuple(x[i - k:i]), Counter())[x[i]] += 1

        def number(ctx):
            return sum(b << 8 * j for j, b in enumerate(reversed(ctx)))

        ranked = sorted((c for c in self.counts if c), key=lambda c: (-sum(self.counts[c].values()), len(c), number(c)))
        self.kept = {(), *ranked[:most]}

    def score(self, t):
        x, total = [0] * self.order + list(t) + [256], 0.0
        for i in range(self.order, len(x)):
            k = max(k for k in range(self.order + 1) if tuple(x[i - k:i]) in self.kept)
            gone, log = set(), 0.0
            for j in range(k, -1, -1):
                c = {s: n for s, n in self.counts.get(tuple(x[i - j:i]), {}).items() if s not in gone}
                left = 257 - len(gone) - len(c)
                base = sum(c.values()) + (len(c) if left else 0)
                if x[i] in c:
                    log += math.log(c[x[i]] / base)
                    break
                if c:
                    log += math.log(len(c) / base)
                gone |= set(c)
            else:
                log -= math.log(257 - len(gone))
            total += log
        return total / math.log(10)


def base(rows):
    tokens = [(i, TOKEN.findall(low(t)) + [None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not is_held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, is_held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


def check(spark, rows, df, params):
    got = ppm.score(df, params).collect()
    want = base(rows)
    model = Brute([low(t).encode() for i, t in rows if not is_held(i)], params.order, params.max_contexts)
    key = lambda r: (r[0] is None, r[0], r[2], round(r[5], 6))
    full = sorted(((*b, model.score(low(t).encode())) for b, (_, t) in zip(want, rows, strict=True)), key=key)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert len(have) == len(full)
    for a, b in zip(have, full, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-5, abs=1e-6)


CASES = [(1, "abc abd ab"), (2, None), (3, ""), (4, "ABC abd"), (4, "ABC abd"), (None, "no id abc"), (5, "été Ünï\x00 é"), (6, " \n\t"),
         (7, "abracadabra " * 300), (8, "zzz"), (9, "abc q"), (10, "the end"), (11, "abd the"), (12, "cab abc abd abe"), (16, "abq")]


@pytest.mark.parametrize("order,most", [(4, 1 << 16), (2, 12), (3, 1), (1, 0)])
def test_cases_against_brute_force(spark, order, most):
    assert any(is_held(i) for i, _ in CASES)
    check(spark, CASES, docs_df(spark, CASES), ppm.PpmParams(order, most))


def test_random_texts_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 200)
    rnd = random.Random(3)
    rows = [(k, "".join(rnd.choice("aab cd\n") for _ in range(rnd.randint(0, 60)))) for k in range(80)]
    check(spark, rows, docs_df(spark, rows), ppm.PpmParams(3, 40))


def test_base_on_the_table_and_better_than_it_when_held_out(spark):
    docs = documents(spark, SF)
    got = {r.doc_id: r for r in ppm.query(docs).collect()}
    for i, held, n, known, total, b in base([(r.doc_id, r.text) for r in docs.collect()]):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(b, rel=1e-9)
    apart = [r for r in got.values() if r.held_out]
    assert apart and sum(r.score for r in apart) > sum(len(x.text.encode()) * -math.log10(257) for x in docs.collect() if is_held(x.doc_id)) * 0.6


def test_empty_and_nothing_to_train(spark):
    assert ppm.score(docs_df(spark, [])).count() == 0
    held = [k for k in range(100) if is_held(k)][:3]
    check(spark, [(k, "abc") for k in held], docs_df(spark, [(k, "abc") for k in held]), ppm.PpmParams())


def test_probabilities_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(1)
    raw = [bytes(rng.integers(97, 102, 50).astype(np.uint8)) for _ in range(20)]
    b = Brute(raw, 2, 10)
    rows = [(len(c), sum(v << 8 * j for j, v in enumerate(reversed(c))), s, n) for c in b.kept for s, n in b.counts[c].items()]
    m = ppm.Model(2, *map(np.array, zip(*rows, strict=True)))
    p = np.exp(m.logp.astype(float))
    assert np.allclose(p[:, :-1].sum(1) + p[:, -1] * (257 - (p.shape[1] - 1)), 1, atol=1e-4)


def test_no_context_is_lost(spark, monkeypatch):
    """More contexts than any fixed bound of a few thousand, all byte values, many chunks and slices."""
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(ppm, "SLICE_BYTES", 3_000)
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéüñßλж漢") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for k in range(300)] + CASES
    check(spark, rows, docs_df(spark, rows), ppm.PpmParams(4))


def test_the_registered_parameters_keep_every_context(spark):
    """About 130,000 different contexts: twice what the trie of fixed size held."""
    assert ppm.PpmParams().max_contexts is None
    rnd = random.Random(6)
    rows = [(k, "".join(chr(rnd.randint(33, 126)) for _ in range(700))) for k in range(80)]
    contexts = {low(t)[max(0, i - j):i] for n, t in rows for i in range(len(t) + 1) for j in range(1, 5) if not is_held(n)}
    assert len(contexts) > 1 << 16
    check(spark, rows, docs_df(spark, rows), ppm.PpmParams())


@pytest.mark.parametrize("order", [0, 1, 4])
def test_every_symbol_of_a_level_is_seen(spark, order):
    """Nothing is left for an escape when all 257 symbols stand after the empty context."""
    every = "".join(chr(c) for c in range(128))
    rows = [(k, every[k:] + "".join(chr(c) for c in range(128, 1000)) + f" {k % 5}") for k in range(12)]
    check(spark, rows, docs_df(spark, rows), ppm.PpmParams(order))
