"""Phrase collocations by SETM, set-oriented mining over relations.

``R1`` is the sorted relation of all word occurrences: chunks of whole
documents of one language, an int32 code for every place, pieces kept apart by
a separator's place.  A relation ``Rk`` of longer phrases holds the sorted
places where one starts, and its group (a 64-bit hash of its words).  Each
length is one round:

* merge-join: places p and p + 1 that both start a phrase of k - 1 words in
  one piece give a phrase of k words at p;
* group-count: tasks count their groups, and the counts are added up by parts
  of the hash, packed as steps between sorted keys;
* semi-join: only places of frequent groups are extended.  The frequent groups
  go to the tasks as a bitmap of fixed size (``BITS``), whatever the corpus: a
  group that shares a bit with a frequent one stays a while longer.

Only R1 is written.  A round makes the relations before its own again from R1
and the bitmaps, chunk by chunk, which costs less than the 12 bytes a place
that each of them takes on disk.

Hashes only prune.  The counts of the result are made once more from the words
themselves, over all places the rounds kept, so neither the bitmap nor a clash
of hashes changes a result.

Defined cases: NULL text counts as empty, NULL lang as ``und``; a phrase has 2
to ``longest`` words; every language is a corpus of its own; repeated rows
count as often as they occur; empty tables give no rows.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import pieces, stash, texts

LONGEST, LEAST, TOP = 5, 100, 2000
CHUNK = 1 << 20           # places of a chunk
BITS = 1 << 25            # bits of a length's bitmap of frequent groups: 4 MB
PARTS = 4096              # parts of a bitmap, each counted by one task
HELD = 1 << 21            # group counts that a task holds, beyond those of one chunk
MOST = (1 << 32) - 1      # a task's count of a group is cut here: it only has to tell whether it is frequent
PHRASE_PARTS = 256        # parts of a language's phrases of one length
HELD_PHRASES = 500_000    # phrases that a task holds, beyond those of one chunk
SALTS = 64                # parts of a language in which its first rows are looked for

# A-Z to lower case, tabs to blanks, piece separators [.,;:!?\x0A-\x0D] to line feeds.
TABLE = bytes(0x0A if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 9 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Codes(dict):
    """Numbers words in the order of their first place; 0 is the separator, 1 no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def occurrences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """R1: (lang, words, codes, n) of chunks; ``words`` are the chunk's words by
    code (from 2), ``codes`` its places, ``n`` the number of words among them."""

    def rows(open_):
        out = [(lang, list(codes)[2:], np.concatenate(parts), n) for lang, (codes, parts, n) in open_.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.binary())),
             pa.array([x[2].tobytes() for x in out], pa.binary()), pa.array([x[3] for x in out], pa.int64())],
            ["lang", "words", "codes", "n"])

    def run(batches):
        open_, held = {}, 0
        for rb in pieces(batches):
            for lang, text in zip(rb.column(0).to_pylist(), texts(rb), strict=True):
                if lang not in open_:
                    open_[lang] = [_Codes(), [], 0]
                own = open_[lang]
                tokens = (text.translate(TABLE) + b"\n").replace(b"\n", b" \n ").split(b" ")
                places = np.fromiter(map(own[0].__getitem__, tokens), np.int32, len(tokens))
                places = places[places != 1]
                own[1].append(places)
                own[2] += int(np.count_nonzero(places))
                held += len(places)
                if held >= CHUNK:
                    yield rows(open_)
                    open_, held = {}, 0
        if open_:
            yield rows(open_)

    clean = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return clean.mapInArrow(run, "lang string, words array<binary>, codes binary, n long")


def places(codes: bytes, words: list[bytes], lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of a chunk and their groups."""
    code = np.frombuffer(codes, np.int32)
    seed = crc32(lang.encode())
    h = np.array([0, 0, *(xxhash.xxh3_64_intdigest(w, seed) for w in words)], np.uint64)
    at = np.flatnonzero(code).astype(np.int32)
    return at, h[code[at]]


def merged(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins a sorted relation with itself by adjacent places: the next length."""
    first = np.flatnonzero(at[1:] == at[:-1] + 1)
    h = group[first] * MIX_B + group[first + 1]
    h = (h ^ (h >> np.uint64(32))) * MIX_A
    return at[first], h ^ (h >> np.uint64(29))


def frequent(at: np.ndarray, group: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Semi-join of a relation with the frequent groups."""
    b = (group >> np.uint64(20)) & np.uint64(8 * len(bitmap) - 1)
    keep = (bitmap[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return at[keep], group[keep]


def _relation(lang: str, words: list[bytes], codes: bytes, bitmaps) -> tuple[np.ndarray, np.ndarray]:
    """The relation of the next length of a chunk: from R1, a semi-join with the
    frequent groups and a merge-join of neighbours for each length before."""
    at, group = places(codes, words, lang)
    for bitmap in bitmaps:
        at, group = merged(*frequent(at, group, bitmap.value))
    return at, group


def _packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, which compress better than rows."""
    return pa.compress(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.uint32).ravel()


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts], np.add.reduceat(count, starts)


def _group_counts(r1: DataFrame, bitmaps) -> DataFrame:
    """(part, n, keys, counts): the groups of the next length, counted by task.

    A key is a bit of the bitmap and further bits of the hash: its ``PARTS``th
    of the bitmap is the part, the other 32 bits are packed as steps in order.
    Groups that share a key count together, which only keeps a place longer."""
    part_bits, bits = PARTS.bit_length() - 1, BITS.bit_length() - 1
    rest = 32 - (bits - part_bits)

    def rows(held):
        key, count = _summed([k for k, _ in held], [c for _, c in held])
        part = (key >> np.uint64(32)).astype(np.int32)
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(starts[1:], len(key))
        low = [key[a:b].astype(np.uint32) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[starts]), pa.array((ends - starts).astype(np.int32)),
             pa.array([_packed(np.diff(x, prepend=np.uint32(0))) for x in low], pa.binary()),
             pa.array([_packed(np.minimum(count[a:b], MOST)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
            ["part", "n", "keys", "counts"])

    def run(batches):
        held, size = [], 0
        for rb in batches:
            for lang, words, codes in zip(*(rb.column(c) for c in ("lang", "words", "codes")), strict=True):
                group = _relation(lang.as_py(), words.as_py(), codes.as_py(), bitmaps)[1]
                key = ((group >> np.uint64(20)) & np.uint64((1 << bits) - 1)) << np.uint64(rest)
                key |= (group >> np.uint64(45)) & np.uint64((1 << rest) - 1)
                key, count = np.unique(key, return_counts=True)
                held.append((key, count))
                size += len(key)
                if size >= HELD:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return r1.select("lang", "words", "codes").mapInArrow(run, "part int, n int, keys binary, counts binary")


def _bitmap(counts: DataFrame, least: int) -> np.ndarray:
    """The frequent groups' bits: at most ``PARTS`` rows of BITS / 8 / PARTS bytes reach the driver."""
    wide = BITS // PARTS                                                       # bits of a part
    rest = 32 - (wide.bit_length() - 1)

    def run(batches):
        part, keys, sums = None, [], []

        def close():
            key, total = _summed(keys, sums)
            bits = np.zeros(wide, np.uint8)
            bits[key[total >= least] >> np.uint32(rest)] = 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

        for rb in batches:
            for p, n, k, c in zip(*(rb.column(x).to_pylist() for x in ("part", "n", "keys", "counts")), strict=True):
                if p != part and keys:
                    yield close()
                    keys, sums = [], []
                part = p
                keys.append(np.cumsum(_unpacked(k, n), dtype=np.uint32))
                sums.append(_unpacked(c, n).astype(np.int64))
        if keys:
            yield close()

    out = np.zeros(BITS // 8, np.uint8)
    for r in counts.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, bits binary").collect():
        out[r["part"] * wide // 8:(r["part"] + 1) * wide // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _counted(r1: DataFrame, bitmaps, least: int) -> DataFrame:
    """(lang, k, phrase, f): the phrases at the places that the rounds kept,
    counted by their words: by task first, then by parts of a language's length."""

    def rows(held):
        out = []
        for (lang, k), counts in held.items():
            deals = {}
            for phrase in sorted(counts):
                deals.setdefault(crc32(phrase) % PHRASE_PARTS, []).append(phrase)
            for part, names in deals.items():
                out.append((lang, k, part, pa.compress(b"\n".join(names), codec="zstd", asbytes=True), sum(map(len, names)) + len(names) - 1,
                            np.array([counts[x] for x in names], np.int64).tobytes()))
        cols = list(zip(*out, strict=True))
        types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["lang", "k", "part", "phrases", "size", "counts"])

    def run(batches):
        held, size = {}, 0
        for rb in batches:
            for lang, words, codes in zip(*(rb.column(c) for c in ("lang", "words", "codes")), strict=True):
                lang, words, codes = lang.as_py(), words.as_py(), codes.as_py()
                code = np.frombuffer(codes, np.int32)
                at, group = places(codes, words, lang)
                for k, bitmap in enumerate(bitmaps, 1):
                    if k > 1:
                        at, group = merged(at, group)
                    at, group = frequent(at, group, bitmap.value)
                    if not len(at):
                        break
                    # one place of each distinct phrase, counted by the codes of its words
                    found = np.stack([code[at + j] for j in range(k)], axis=1)
                    found = found[np.lexsort(found.T)]
                    new = np.ones(len(found), bool)
                    new[1:] = (found[1:] != found[:-1]).any(1)
                    starts = np.flatnonzero(new)
                    own = held.setdefault((lang, k), {})
                    size -= len(own)
                    for r, c in zip(found[starts].tolist(), np.diff(np.append(starts, len(found))).tolist(), strict=True):
                        phrase = b" ".join([words[x - 2] for x in r])
                        own[phrase] = own.get(phrase, 0) + c
                    size += len(own)
                if size >= HELD_PHRASES:
                    yield rows(held)
                    held, size = {}, 0
        if size:
            yield rows(held)

    def merge(batches):
        key, total = None, {}

        def close():
            found = [(x, c) for x, c in total.items() if c >= least]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(found), pa.string()), pa.array([key[1]] * len(found), pa.int32()),
                 pa.array([x for x, _ in found], pa.binary()).cast(pa.string()), pa.array([c for _, c in found], pa.int64())], ["lang", "k", "phrase", "f"])

        for rb in batches:
            for lang, k, part, names, n, counts in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if (lang, k, part) != key and total:
                    yield close()
                    total = {}
                key = lang, k, part
                names = pa.decompress(names, decompressed_size=n, codec="zstd", asbytes=True).split(b"\n")
                for phrase, c in zip(names, np.frombuffer(counts, np.int64).tolist(), strict=True):
                    total[phrase] = total.get(phrase, 0) + c
        if total:
            yield close()

    own = r1.select("lang", "words", "codes").mapInArrow(run, "lang string, k int, part int, phrases binary, size long, counts binary")
    by = ["lang", "k", "part"]
    return own.repartition(*by).sortWithinPartitions(*by).mapInArrow(merge, "lang string, k int, phrase string, f long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of 1 to ``longest`` words with
    f >= ``least``, and (lang, n), the number of words of every language."""
    spark = docs.sparkSession
    r1 = stash(occurrences(docs, text_col, lang_col), "setm-1")
    totals = r1.groupBy("lang").agg(F.sum("n").alias("n"))
    bitmaps = []
    for _ in range(longest):
        bitmap = _bitmap(_group_counts(r1, bitmaps), least)
        if not bitmap.any():
            break
        bitmaps.append(spark.sparkContext.broadcast(bitmap))
    return stash(_counted(r1, bitmaps, least), "setm-phrases"), totals


def _whole(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases by the score of their weakest cut,
    without those that a longer candidate explains."""
    found, totals = frequent_phrases(docs, least, longest, text_col, lang_col)
    cand = found.where("k > 1")
    # the parts of every cut; both are phrases of at least the candidate's frequency
    cut = cand.select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")).withColumn(
        "left", F.expr("substring_index(phrase, ' ', at)")).withColumn("right", F.expr("substring_index(phrase, ' ', at - k)"))
    one, two = (found.select("lang", F.col("phrase").alias(p), F.col("f").alias(n)) for p, n in (("left", "l"), ("right", "r")))
    cut = cut.join(one, ["lang", "left"]).join(two, ["lang", "right"]).join(F.broadcast(totals), "lang")
    above = F.lit(1000).cast("decimal(4,0)") * (_whole(F.col("a")) * _whole(F.col("n")))
    below = _whole(F.col("l")) * _whole(F.col("r"))
    exact = ((above - above % below) / below).cast("long")                     # the quotient is whole: nothing is rounded
    scored = cut.withColumn("score", exact).groupBy("lang", "k", "phrase", "a", "n").agg(
        F.min(F.struct("score", "at", "l", "r")).alias("m")).select("lang", "k", "phrase", "a", "n", "m.score", "m.l", "m.r")
    # the words of a candidate lie in a longer one of the same frequency
    inner = cand.where("k > 2").select("lang", F.col("f").alias("longer"), F.split("phrase", " ").alias("w"), "k")
    inner = inner.select("lang", "longer", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("len")).select(
        "lang", "longer", "w", "len", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("len") + 1)).alias("from"))
    inner = inner.select("lang", "longer", F.array_join(F.slice("w", F.col("from"), F.col("len")), " ").alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    return collocations(docs)


def oracle_sql(least: int = LEAST, top: int = TOP) -> str:
    """The same rows from DuckDB: words by place, phrases by leads."""
    grams = "\nUNION ALL\n".join(
        f"SELECT lang, {k} AS k, {' || chr(32) || '.join(['w', *(f'w{j}' for j in range(1, k))])} AS phrase FROM s"
        + (f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") for k in range(1, LONGEST + 1))
    leads = ", ".join(f"lead(w, {j}) OVER (PARTITION BY d, p ORDER BY i) AS w{j}" for j in range(1, LONGEST))
    subs = "\nUNION ALL\n".join(
        f"SELECT lang, f, array_to_string(v[{a}:{a + n - 1}], chr(32)) AS phrase FROM (SELECT lang, f, k, string_split(phrase, chr(32)) AS v FROM c WHERE k = {k})"
        for k in range(3, LONGEST + 1) for n in range(2, k) for a in range(1, k - n + 2))
    return f"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz' || chr(32)) AS x FROM documents),
pieces AS (SELECT d, lang, generate_subscripts(a, 1) AS p, unnest(a) AS x
           FROM (SELECT d, lang, string_split(translate(x, '.,;:!?' || chr(11) || chr(12) || chr(13), repeat(chr(10), 9)), chr(10)) AS a FROM t)),
words AS (SELECT d, lang, p, generate_subscripts(a, 1) AS i, unnest(a) AS w
          FROM (SELECT d, lang, p, list_filter(string_split(x, chr(32)), lambda y: y <> '') AS a FROM pieces)),
s AS (SELECT lang, w, {leads} FROM words),
g AS (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1),
cuts AS (SELECT c.*, string_split(phrase, chr(32)) AS v, unnest(generate_series(1, k - 1)) AS cut FROM c),
sc AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, n.n, cut, x.f AS l, y.f AS r,
              (1000::HUGEINT * cuts.f * n.n) // (x.f::HUGEINT * y.f) AS score
       FROM cuts JOIN n ON n.lang = cuts.lang JOIN g x ON x.lang = cuts.lang AND x.phrase = array_to_string(v[1:cut], chr(32))
       JOIN g y ON y.lang = cuts.lang AND y.phrase = array_to_string(v[cut + 1:], chr(32))),
weak AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(f) AS longer FROM ({subs}) GROUP BY ALL),
kept AS (SELECT w.* FROM weak w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.longer IS NULL OR i.longer < w.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {top}"""
