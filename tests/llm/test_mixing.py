import random
from collections import Counter
from fractions import Fraction

import pytest

from ledgerline.llm import mixing as m
from ledgerline.llm.common import documents
from tests.llm.util import SF


@pytest.mark.parametrize("seed", range(20))
def test_less_than_one_block_of_deviation(seed):
    rnd = random.Random(seed)
    parts = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 12))]
    got, total, seen = m.schedule(parts), sum(parts), Counter()
    assert Counter(got) == dict(enumerate(parts))
    for t, s in enumerate(got, 1):
        seen[s] += 1
        assert all(abs(seen[k] * total - t * p) < total for k, p in enumerate(parts))


@pytest.mark.parametrize("seed", range(10))
def test_phases_are_the_schedule_played_out(seed):
    rnd = random.Random(seed)
    blocks = [rnd.randint(1, 300) for _ in range(rnd.randint(1, 6))]
    weights = [rnd.random() + 0.05 for _ in blocks]
    at = {}
    for s, ph in enumerate(m.phases(blocks, weights, 50)):
        for i, (first, slot, size, slots) in enumerate(ph):
            stop = ph[i + 1][0] if i + 1 < len(ph) else blocks[s]
            for b in range(first, stop):
                k = b - first
                at[s, b] = slot + k // len(slots) * size + slots[k % len(slots)]
    assert sorted(at.values()) == list(range(sum(blocks)))
    for s, n in enumerate(blocks):
        assert [at[s, b] for b in range(n)] == sorted(at[s, b] for b in range(n))


def brute(rows, params):
    """The mix by ranking and scheduling in plain Python; rows: (id, key, source, hash)."""
    lanes = {}
    for r in rows:
        lanes.setdefault(r[2], []).append(r)
    order = sorted(lanes, key=lambda s: (-len(lanes[s]), s is not None, s or ""))
    given = dict(params.weights)
    weights = [given.get(s, len(lanes[s]) ** params.temper) for s in order]
    plan = m.phases([-(-len(lanes[s]) // params.block_docs) for s in order], weights, params.period)
    out = []
    for s, ph in zip(order, plan, strict=True):
        for rank, r in enumerate(sorted(lanes[s], key=lambda r: (r[3], r[0], r[1]))):
            b = rank // params.block_docs
            first, slot, size, slots = [p for p in ph if p[0] <= b][-1]
            out.append((r[0], s, b, slot + (b - first) // len(slots) * size + slots[(b - first) % len(slots)], rank % params.block_docs))
    return sorted(out, key=str)


def hashed(docs, params):
    from pyspark.sql import functions as F

    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "source")
    return [tuple(r) for r in d.withColumn("h", F.xxhash64(F.lit(params.seed), "doc_id", "key")).collect()]


def got(docs, params):
    return sorted((tuple(r) for r in m.positions(docs, params).select("doc_id", "source", "block", "slot", "place").collect()), key=str)


@pytest.mark.parametrize("params", [m.MixParams(), m.MixParams(weights=(("src0", 5.0), ("src1", 0.5)), block_docs=2, period=100)])
def test_whole_table_against_brute_force(spark, params):
    docs = documents(spark, SF)
    assert got(docs, params) == brute(hashed(docs, params), params)


def small(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, lane int, key string")


def test_cases(spark):
    rows = [(k, f"t{k}", "hot" if k % 3 else [None, "b", ""][k // 3 % 3]) for k in range(120)] + [(None, None, None), (5, "again", "hot"), (5, "again", "hot")]
    params = m.MixParams(block_docs=3, period=20)
    docs = small(spark, rows)
    assert got(docs, params) == brute(hashed(docs, params), params)
    out = m.mix(docs, params)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(((*r, 1, "x") for r in rows), key=str)
    assert m.mix(docs.limit(0), params).count() == 0


def test_the_smallest_sources_share_a_lane(spark):
    rows = [(k, f"t{k}", f"s{k % 7}" if k > 50 else "big") for k in range(150)]
    found = m.positions(small(spark, rows), m.MixParams(block_docs=2, max_lanes=3, period=10)).collect()
    assert len(found) == 150 and len({(r.slot, r.place) for r in found}) == 150


def test_written_files_keep_the_order(spark, tmp_path):
    docs = documents(spark, SF)
    out = str(tmp_path / "mixed")
    m.mix(docs, m.MixParams(block_docs=2)).write.parquet(out)
    rows = spark.read.parquet(out).select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.file_name, r.row_index))]
    place = {r.doc_id: (r.slot, r.place) for r in m.positions(docs, m.MixParams(block_docs=2)).collect()}
    assert order == sorted(place, key=place.get)


def ideal(blocks, weights):
    """The exact share of each source after every slot, slot by slot."""
    left, share = [Fraction(n) for n in blocks], [Fraction(0)] * len(blocks)
    for _ in range(sum(blocks)):
        room = Fraction(1)
        while room:
            total = sum(w for n, w in zip(left, weights) if n)
            step = min(room / total, *(n / w for n, w in zip(left, weights) if n))
            for s, w in enumerate(weights):
                if left[s]:
                    left[s] -= step * w
                    share[s] += step * w
            room -= step * total
        yield list(share)


@pytest.mark.parametrize("blocks,weights", [([4000, 12000], [0.23256, 0.76744]), ([3, 9000, 7000], [0.0002, 0.4999, 0.4999]),
                                            ([40, 7, 1, 1, 300, 90], [2 ** 0.5, 0.1, 3.7, 1e-6, 1.0, 1 / 3]), ([50] * 30, [1 / 7] * 30)])
def test_deviation_from_the_real_weights_over_the_whole_mix(blocks, weights):
    at, exact = {}, [Fraction(w) for w in weights]
    for s, ph in enumerate(m.phases(blocks, weights, 1000)):
        for i, (first, slot, size, slots) in enumerate(ph):
            for b in range(first, ph[i + 1][0] if i + 1 < len(ph) else blocks[s]):
                at[slot + (b - first) // len(slots) * size + slots[(b - first) % len(slots)]] = s
    done = Counter()
    for t, share in enumerate(ideal(blocks, exact)):
        done[at[t]] += 1
        assert all(abs(done[s] - x) < 1 for s, x in enumerate(share))


def test_weight_zero_comes_last():
    assert list(m.slot_sources([3, 2, 2], [1.0, 0.0, 1.0]))[5:] == [1, 1]
    with pytest.raises(ValueError):
        list(m.slot_sources([1, 1], [1.0, -0.5]))


def test_every_one_of_many_sources_has_its_own_schedule(spark):
    rows = [(k, f"t{k}", f"s{k % 650}" if k < 1500 else "big") for k in range(1700)] + [(5000, "x", "tiny"), (5001, "y", "tiny")]
    params = m.MixParams(weights=(("tiny", 1000.0),), block_docs=1)
    docs = small(spark, rows)
    found = got(docs, params)
    assert found == brute(hashed(docs, params), params)
    assert max(slot for _, s, _, slot, _ in found if s == "tiny") < 5


def test_rows_that_repeat_each_have_a_place(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (2, "b", "s"), (2, "b", "s"), (2, "b", "t"), (None, None, None), (None, None, None)]
    docs = spark.createDataFrame([(*r, i % 2, "y") for i, r in enumerate(rows)], "doc_id long, text string, source string, _slot int, mixed string")
    got = m.query(docs).collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    out = m.mix(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
