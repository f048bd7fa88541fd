import random
import zlib

import numpy as np
import pytest

from ledgerline.llm import token_files as tf
from ledgerline.llm.common import documents
from ledgerline.llm.tokens import public_path, tokenizer
from tests.llm.test_token_counts import CASES
from tests.llm.util import SF, docs_df

PATH = public_path("byte_bpe_50k.json")


def library(text):
    return tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def brute(rows):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(t) + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_whole_table(spark):
    docs = documents(spark, SF)
    assert got(tf.query(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_cases_round_trip(spark, tmp_path, monkeypatch):
    rows = [(7 * k % 31, t) for k, t in enumerate(CASES)]
    assert len({i for i, _ in rows}) == len(rows)
    rows.append((None, "no id"))
    out = str(tmp_path / "tokens")
    tf.write_tokens(docs_df(spark, rows), out)
    back = tf.read_tokens(spark, out, with_ids=True)
    assert got(back) == brute(rows)
    ids = {r.doc_id: list(r.ids) for r in back.collect()}
    assert all(ids[i] == library(t) + [2] for i, t in rows)


def test_repeated_rows_and_empty(spark):
    rows = [(1, "same text"), (1, "same text"), (0, None)]
    assert got(tf.query(docs_df(spark, rows))) == brute(rows)
    assert got(tf.query(docs_df(spark, []))) == []


@pytest.mark.parametrize("seed", range(8))
def test_pack_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 20_000))
    ids = rng.integers(0, 2 ** 16, n).astype(np.uint64)
    if seed % 2:
        ids >>= rng.integers(0, 16, n).astype(np.uint64)
    if seed > 3:
        k = rng.integers(0, n, 50)
        ids[k] = np.uint64(2) ** rng.integers(17, 64, 50).astype(np.uint64) - np.uint64(1)
    if seed == 7:
        ids[:] = np.uint64(15) << np.uint64(60)
    words, offsets = tf.pack(ids)
    assert (tf.unpack(words, offsets, n) == ids).all()
    # a block decodes on its own
    b = len(offsets) - 1
    assert (tf.unpack(words[offsets[b]:], offsets[b:] - offsets[b], n - b * tf.BLOCK) == ids[b * tf.BLOCK:]).all()


def test_random_strings_equal_the_library():
    rnd, enc = random.Random(6), tf.Encoder(PATH)
    alphabet = "aabcdeeiou  thsnr'lvd.,!1é ü\n\n<|>\t²"
    for _ in range(3000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library(t), repr(t)


def test_rows_without_an_id_are_spread(spark, tmp_path):
    rows = [(None, f"text {k} of many") for k in range(3000)] + [(7, f"same id {k}") for k in range(3000)]
    out = str(tmp_path / "files")
    key = "spark.sql.adaptive.coalescePartitions.enabled"          # small partitions are merged otherwise
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        tf.write_tokens(docs_df(spark, rows).repartition(4), out)
    finally:
        spark.conf.set(key, was)
    shards = spark.read.parquet(out).groupBy("shard").sum("n_ids").collect()
    assert len(shards) > 2
    got = tf.read_tokens(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 3000 + [7] * 3000
