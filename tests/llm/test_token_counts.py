import random

from ledgerline.llm import token_counts as tc
from ledgerline.llm.common import documents
from ledgerline.llm.tokens import public_path, tokenizer
from tests.llm.util import SF, docs_df

PATH = public_path("word_bpe_49k.json")


def library(texts):
    return [len(e) for e in tokenizer(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(spark, rows, docs=None):
    got = sorted(map(tuple, tc.token_counts(docs_df(spark, rows) if docs is None else docs).collect()), key=str)
    n = library([t for _, t in rows])
    want = sorted(((i, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n, strict=True)), key=str)
    assert got == want


def test_whole_table(spark):
    docs = documents(spark, SF)
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], docs)


CASES = ["", None, " \n\t ", "a", "aaaaaaaaaaaaaaaaaaaaaaaa", "Don't WE'LL they've I'd it's", "12345 67", "a<|endoftext|>b<|startoftext|><|endoftext|>",
         "<|endoftext", "x" * 100_000, "ab " * 60_000, "日本語 テキスト", "Ünï ÇÖDE straße İstanbul Ŀ ŉ", "é Å ﬁ", "🙂🙂 👩‍👩‍👧", "a b c\x1cd\x85e",
         "Привет мир ΣΑΣ", "—“quotes”… €5", "!!!???###%%%", "\x00\x01", "अनुच्छेद १२", "same", "same"]


def test_cases(spark):
    check(spark, [*enumerate(CASES), (None, "no id"), (3, "again")])


def test_random_strings_equal_the_library():
    rnd = random.Random(5)
    alphabet = "aabcdeeiou  thsnr'lvd.,!1é ü\n<|>İıſ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    assert tc.count_tokens(texts, PATH) == library(texts)


def test_forgetting_keeps_counts_right(monkeypatch):
    monkeypatch.setattr(tc, "KEPT", 5)
    texts = ["one two three four five six seven", "one two", "eight nine ten one"] * 3
    assert [x for t in texts for x in tc.count_tokens([t], PATH)] == library(texts)


def test_empty(spark):
    assert tc.token_counts(docs_df(spark, [])).count() == 0
