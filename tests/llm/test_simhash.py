import random

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash as s
from ledgerline.llm.common import documents
from tests.llm.util import SF, TOKEN, docs_df, low


def brute_fp(text):
    w = TOKEN.findall(low(text))
    sh = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2) if w else 0)]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows, most=3):
    """(doc_id, fingerprint, component) by comparing every pair."""
    fps = [brute_fp(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    return sorted(((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, group, strict=True)), key=str)


def got(df):
    return sorted((tuple(r) for r in s.query(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_against_brute_force_on_the_table(spark):
    docs = documents(spark, SF)
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs) == want
    assert any(i != c for i, _, c in want)


def test_cases(spark):
    rows = [(1, "A b c d"), (2, "a B c d"), (2, "other words are here now"), (None, "a b c d"), (5, None), (6, ""), (7, " \n"),
            (None, "alone with no id at all"), (8, "one"), (9, "one two"), (10, "word " * 70000), (11, "word " * 3), (12, "é Ü ñ ß")]
    assert got(docs_df(spark, rows)) == brute_groups(rows)


def test_empty(spark):
    assert got(docs_df(spark, [])) == []


@pytest.mark.parametrize("few,block,most", [(32, 1024, 3), (2, 8, 3), (2, 1024, 3), (32, 1024, 0), (2, 8, 5)])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, few, block, most):
    monkeypatch.setattr(s, "FEW", few)
    monkeypatch.setattr(s, "BLOCK", block)
    rnd = random.Random(few + block + most)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.choice([0, 1, 2, 9, 17, 40, 41, 63, rnd.randrange(64)])
            fps.add(x)
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    edges = s.links(spark.createDataFrame([(x,) for x in fps], "fp long"), most)
    pairs = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= most]
    emitted = {tuple(r) for r in edges.collect()}
    assert emitted <= set(pairs)

    def groups(found):
        root = {x: x for x in fps}
        for a, b in found:
            p, q = root[a], root[b]
            if p != q:
                root = {x: q if r == p else r for x, r in root.items()}
        return root

    want, have = groups(pairs), groups(emitted)
    assert len(set(want.values())) == len({(want[x], have[x]) for x in fps}) == len(set(have.values()))


def test_components_of_long_chains(spark):
    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (1002, 1001)], "a long, b long")
    found = {r.node: r.component for r in s.components(edges).collect()}
    assert found == {**dict.fromkeys(range(n + 1), 0), **dict.fromkeys((1000, 1001, 1002), 1000)}


def test_keep_one(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "something else entirely here"), (None, "a b c d"), (None, "no id here")]
    kept = s.keep_one(docs_df(spark, rows)).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in kept), key=str) == [(1, "a b c d"), (2, "something else entirely here"), (None, "no id here")]


def test_keep_one_where_ids_clash(spark):
    x, y, z = "first text about one thing only", "another passage on wholly different matters", "third words that match nothing else here"
    rows = [(4, x), (4, y), (4, y), (3, y), (9, x), (4, z), (7, "alone with its own id")]
    kept = s.keep_one(docs_df(spark, rows)).select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in kept) == sorted([(4, x), (3, y), (4, z), (7, "alone with its own id")])


def test_keep_one_with_clashing_names_and_repeated_ids(spark):
    rows = [(1, "a b c d", 5, "x"), (1, "a b c d", 4, "y"), (2, "A B C D", 3, "z"), (3, "something else entirely now", 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keep int, keep string")
    out = s.keep_one(docs)
    assert out.columns == docs.columns
    got = sorted(tuple(r) for r in out.collect())
    assert [r[0] for r in got] == [1, 3]
    assert got == sorted(tuple(r) for r in s.keep_one(docs.repartition(3)).collect())
