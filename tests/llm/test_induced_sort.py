import numpy as np
import pytest

from ledgerline.llm import induced_sort as i


def naive(t):
    b = [tuple(t[k:]) for k in range(len(t))]
    order = sorted(range(len(t)), key=b.__getitem__)
    lcp = [0]
    for x, y in zip(order, order[1:], strict=False):
        k = 0
        while k < i.CAP and x + k < len(t) and y + k < len(t) and t[x + k] == t[y + k]:
            k += 1
        lcp.append(k)
    return order, lcp


@pytest.mark.parametrize("seed", range(60))
def test_against_sorting(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    if seed % 3 == 0:
        monkeypatch.setattr(i, "CHUNK", int(rng.integers(1, 9)))
    n, letters = int(rng.integers(1, 400)), int(rng.integers(1, 6))
    t = rng.integers(2, letters + 2, n)
    if seed % 4 == 1:
        t = np.tile(t[:max(1, n // 9)], 9)
    if seed % 4 == 2:
        t[rng.integers(0, n, n // 20)] = 1
    t = np.append(t, 0).astype(np.uint16)
    sa, lcp = i.Shard(t, budget=int(rng.integers(0, 3)) * 500).sort()
    order, want = naive(t.tolist())
    assert sa.tolist() == order
    assert lcp.tolist() == want


def test_long_runs_and_spilling():
    t = np.concatenate([np.full(3000, 5), [1], np.full(2999, 5), [7] * 500, [0]]).astype(np.uint16)
    sa, lcp = i.Shard(t, budget=0).sort()
    b = [t[k:].tolist() for k in sa]
    assert all(x < y for x, y in zip(b, b[1:], strict=False))
    assert sorted(sa.tolist()) == list(range(len(t)))


@pytest.mark.parametrize("budget", [0, 1 << 20])
def test_all_that_waits_for_a_character_comes_at_once(budget, monkeypatch):
    monkeypatch.setattr(i, "CHUNK", 6)
    queue = i.DiskQueue(3, budget, np.int32)
    for k in range(5):
        queue.push(1, np.arange(2 * k, 2 * k + 2, dtype=np.int32), np.full(2, k, np.uint8))
        if k == 2:
            queue.budget = 1 << 20                         # what comes now stays in memory
    got = []
    while (entry := queue.pop(1)) is not None:
        got.append((entry[0].tolist(), entry[1].tolist()))
    assert got == [([0, 1, 2, 3, 4, 5], [0, 0, 1, 1, 2, 2]), ([6, 7, 8, 9], [3, 3, 4, 4])]
    assert queue.bytes == 0 and queue.pop(0) is None


def test_steps_are_few(monkeypatch):
    steps = []
    scan = i.Shard._scan
    monkeypatch.setattr(i.Shard, "_scan", lambda *a, **k: (steps.append(1), scan(*a, **k))[1])
    t = np.append(np.random.default_rng(1).integers(2, 62, 20_000), 0).astype(np.uint16)
    i.Shard(t).sort()
    assert len(steps) < 600                                # a few for each of 60 characters; array by array they were thousands


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("seed", range(12))
def test_long_substrings_with_equal_beginnings(seed, wide):
    rng = np.random.default_rng(seed)
    down = [9, 8, 7, 6, 5, 4, 3] if not wide else [9, 8, 3]    # with the 2 before: the characters of a word
    kinds = [[2, *down, 7], [2, *down, 2, 7], [2, *down, 3, 2, 8], [2, *down, 3], [4]]
    parts = [kinds[k] for k in rng.integers(0, 5, 40)]
    t = np.concatenate([*parts, [257 if wide else 29, 0]]).astype(np.uint16)
    sa, lcp = i.Shard(t, budget=200).sort()
    order, want = naive(t.tolist())
    assert sa.tolist() == order
    assert lcp.tolist() == want
