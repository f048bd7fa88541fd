import random

from ledgerline.llm import licenses as lic
from ledgerline.llm.common import documents
from ledgerline.llm.license_texts import PHRASES, TEMPLATES
from tests.llm.util import SF, WORD, docs_df, low


def brute(i, text):
    w = WORD.findall(low(text))
    at, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split(" ")
        mine = [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
        at += mine
        labels |= {label} if mine else set()
    return i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


BASE = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def base(df):
    return sorted((tuple(r[c] for c in BASE) for r in df.collect()), key=str)


def test_base_on_the_table(spark):
    docs = documents(spark, SF)
    got = lic.query(docs)
    want = sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert base(got) == want
    assert any(x[2] for x in want)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got.collect())


CASES = [(1, None), (2, ""), (3, "..."), (None, "CC-BY cc by Cc_bY mit license"), (4, "MIT License MIT License, mit  license"),
         (4, "MIT License MIT License, mit  license"), (5, "the mit licenses apache licence cc bye"), (6, "gnu general public license " * 3000),
         (7, "GNU General\nPublic, License."), (8, "x cc by"), (9, "cc by x"), (10, "é cc by ü"), (11, "gnu general public gnu general public license")]


def test_base_cases(spark):
    assert base(lic.query(docs_df(spark, CASES))) == sorted((brute(*c) for c in CASES), key=str)
    assert lic.query(docs_df(spark, [])).count() == 0


def test_templates_are_found_inside_other_text(spark):
    filler = " ".join(f"filler{k}" for k in range(50))
    rows = [(k, f"{filler} {text} {filler}") for k, (_, text) in enumerate(TEMPLATES)]
    got = {r.doc_id: r for r in lic.scan(docs_df(spark, rows)).collect()}
    for k, (label, text) in enumerate(TEMPLATES):
        r = got[k]
        added = {s.label for s in r.spans}
        assert label in added, (label, r.labels)
        assert any(s.label == label and s.start == 50 and s.stop == 50 + len(WORD.findall(text.lower())) for s in r.spans)
    assert {s.label for s in got[3].spans} == {"gpl"}


def test_words_put_in_and_left_out(spark):
    w = TEMPLATES[0][1].split()
    changed = w[:20] + ["really", "truly"] + w[20:50] + w[53:80] + ["changed"] + w[81:]
    rows = [(1, " ".join(changed)), (2, " ".join(w[:12])), (3, "free of charge to any person, it is plain prose without warranty"),
            (4, " ".join(w[:70] + ["x"] * 100 + w[70:]))]
    got = {r.doc_id: r for r in lic.scan(docs_df(spark, rows)).collect()}
    assert got[1].labels == "mit" and 0.8 < got[1].score < 1
    assert got[2].labels == "" and got[3].labels == "" and got[3].score == 0
    assert got[4].labels == "mit"


def test_brute_force_hits(spark):
    rows = [(1, "a b c d e a b c d x"), (2, "c d e a"), (None, "a b c d")]
    places = lic.templates(spark, [("t", "z a b c d e"), ("u", "c d e a b")])
    got = sorted((r.doc_id, r.template, r.pos, r.t_pos) for r in lic.hits(lic.with_words(docs_df(spark, rows)), places).collect() if r.doc_id)
    assert got == [(1, 0, 0, 1), (1, 0, 1, 2), (1, 0, 5, 1), (1, 1, 2, 0), (1, 1, 3, 1), (2, 1, 0, 0)]


def test_a_chain_of_overlapping_templates_loses_only_what_a_kept_one_covers(spark):
    w = [f"w{k}" for k in range(300)]
    table = [("a", " ".join(w[:100])), ("b", " ".join(w[90:190] + ["b1"] * 10)), ("c", " ".join(w[180:280] + ["c1"] * 20)), ("d", " ".join(w[:100]))]
    rows = [(1, " ".join(w[:280])), (2, " ".join(w[180:280])), (1, " ".join(w[90:280]))]
    got = sorted((r.doc_id, [(s.label, s.start, s.stop) for s in r.spans]) for r in lic.scan(docs_df(spark, rows), table).collect())
    assert got == [(1, [("a", 0, 100), ("d", 0, 100), ("c", 180, 280)]), (1, [("b", 0, 100)]), (2, [("c", 0, 100)])]


def test_best_spans_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        spans = []
        for k in range(rng.randrange(12)):
            a = rng.randrange(60)
            spans.append({"start": a, "stop": a + rng.randrange(1, 25), "covered": rng.randrange(3), "share": rng.randrange(4) / 4, "template": k, "label": "x"})
        want = []
        for s in sorted(spans, key=lambda s: (-s["share"], -s["covered"])):
            better = [o for o in want if (o["share"], o["covered"]) > (s["share"], s["covered"])]
            if all(o["stop"] <= s["start"] or s["stop"] <= o["start"] for o in better):
                want.append(s)
        assert lic._best_spans(spans) == want
