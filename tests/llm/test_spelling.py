import random
import re
from collections import Counter
from zlib import crc32

import pytest

from ledgerline.llm import spelling as s
from ledgerline.llm.common import documents
from tests.llm.util import SF, docs_df


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1:]
            yield from (word[:i] + c + word[i + 1:] for c in letters)


def brute(rows, least=5, size=6, ratio=5):
    """The result's rows from (doc_id, text) rows: every edit of every word is looked up."""
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= size and k >= least}
    letters = sorted({c for w in n for c in w})
    near = {w: {x for x in edits(w, letters) if x in n and x != w} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force_on_the_table(spark):
    docs = documents(spark, SF)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(s.query(docs)) == want
    assert any(x[1] for x in want)


def texts(seed, words=60):
    rnd = random.Random(seed)
    out = []
    for _ in range(words):
        w = "".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(5, 9)))
        for _ in range(4):
            out += [w] * rnd.choice((1, 5, 30, 200))
            k = rnd.randrange(len(w))
            w = rnd.choice((w[:k] + w[k + 1:], w[:k] + rnd.choice("abcÿ") + w[k:], w[:k] + rnd.choice("abxÉ") + w[k + 1:]))
    rnd.shuffle(out)
    return [(i, " ".join(out[i::7])) for i in range(7)]


@pytest.mark.parametrize("leaf", [48, 1, 5])
def test_trie_search_finds_every_pair(monkeypatch, leaf):
    monkeypatch.setattr(s, "LEAF", leaf)
    words = sorted({w.encode("latin-1") for _, t in texts(leaf) for w in t.split()})
    found = s.near_pairs(words, words)
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if (len(a) < len(b) or len(a) == len(b) and a < b) and s.one_edit(a, b)}


@pytest.mark.parametrize("block", [50_000, 20, 7])
def test_chains_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(s, "BLOCK", block)
    rows = texts(block)
    want = brute(rows)
    assert got(s.query(docs_df(spark, rows))) == want
    assert any(x[1] != x[2] and x[1] for x in want)


def test_cases(spark):
    long = "abcdefghij" * 3000
    rows = [(1, None), (2, ""), (None, "Straßen straßen STRAßEN Straßen straßen strasen " * 9), (3, " ".join([long] * 6 + [long + "k"] * 6)),
            (4, "banana bananas bananaz " * 40 + "banan " * 50 + "bananax " * 5), (4, "banana bananas bananaz " * 40), (5, "ÀÉÎõü Àéîõüÿ 12abcdef34 x_y_abcdef-abcdeg " * 6)]
    assert got(s.query(docs_df(spark, rows))) == brute(rows)
    assert got(s.variants(docs_df(spark, rows), letters=4, occurrences=1, ratio=2)) == brute(rows, 1, 4, 2)


def test_empty(spark):
    assert got(s.query(docs_df(spark, []))) == set()


def test_one_edit():
    assert s.one_edit(b"abc", b"abd") and s.one_edit(b"abc", b"abcd") and s.one_edit(b"abc", b"xabc") and s.one_edit(b"", b"a")
    assert not s.one_edit(b"abc", b"abc") and not s.one_edit(b"abc", b"acb") and not s.one_edit(b"abc", b"abcde") and not s.one_edit(b"abc", b"bacd")


def test_combined_checksums():
    shift = s._shift_tables()
    for start in (0, 1, 0x80000000, 0xDEADBEEF, crc32(b"17:")):
        for word in (b"", b"a", b"letters", "éàabc".encode(), b"x" * s.SHORT):
            moved = 0
            for k in range(4):
                moved ^= int(shift[len(word), k, start >> 8 * k & 255])
            assert moved ^ crc32(word) == crc32(word, start)


def test_word_counts_of_long_runs_and_texts_without_letters(spark):
    rows = [(k, t) for k in range(250) for t in ("ABCdefgh x" + "é" * 30 + " 漢字abcdefgh×y", "z" * 49 + " " + "q" * 5000, None, "漢 1")]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            want[s.noisy(low, crc32(f"{i}:{low}".encode()))] += 1
    got = {r.word: r.n for r in s.word_counts(docs_df(spark, rows)).collect()}
    assert got == {w: n for w, n in want.items() if w}
    assert s.word_counts(docs_df(spark, [(1, "1 2"), (2, None)])).count() == 0
    assert {r.word for r in s.word_counts(docs_df(spark, rows), letters=40).collect()} == {w for w in want if len(w) >= 40}
