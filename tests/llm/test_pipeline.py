"""The pipeline held against brute force on a small table."""

import zlib

import numpy as np

import corpus_pipeline as p
from ledgerline.llm import mixing, quality
from ledgerline.llm.common import documents
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import brute_groups
from tests.llm.test_token_files import library
from tests.llm.util import SF


def test_whole_pipeline(spark):
    docs = documents(spark, SF).collect()
    text = {r.doc_id: r.text for r in docs}
    kept = {r.doc_id for r in quality.query(documents(spark, SF), documents(spark, SF, "labels")).collect() if r.kept}
    groups = brute_groups([(i, text[i]) for i in sorted(kept)])
    single = {i for i, _, c in groups if i == c}
    assert 0 < len(single) < len(kept) < len(text)
    bench = [(r.item_id, r.text) for r in documents(spark, SF, "benchmark").collect()]
    out = p.run(spark, SF).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and set(ids) <= single
    hit = {r[0]: (r[1], r[2]) for r in leaks([(i, text[i]) for i in single], bench)}
    assert single - set(ids) == {i for i, (n, k) in hit.items() if n and n == k}
    order = sorted(out, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(order, order[1:], strict=False)) and order[0].start == 0
    for r in out:
        if not hit[r.doc_id][1]:                           # untouched texts
            t = library(text[r.doc_id]) + [2]
            assert (r.n_tokens, r.ids_crc32) == (len(t), zlib.crc32(np.array(t, "<u4").tobytes()))
    assert any(k for _, k in hit.values())


def test_order_of_the_tokens_is_the_order_of_the_mix(spark, tmp_path):
    docs = documents(spark, SF)
    mixing.mix(docs).write.parquet(str(tmp_path / "m"))
    out = p.token_output(spark, spark.read.parquet(str(tmp_path / "m")), SF).collect()
    place = {r.doc_id: (r.slot, r.place) for r in mixing.positions(docs).collect()}
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted(place, key=place.get)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = documents(spark, SF).limit(0)
    for k, (_, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == 0 and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
