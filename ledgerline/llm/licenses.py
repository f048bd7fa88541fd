"""Licence scan by diagonal voting.

Every text's rolling word k-gram hashes are joined by Spark to the places of
the same k-grams in the licence templates (a table of a few thousand rows, its
size fixed by ``license_texts``, so it is broadcast).  A hit votes for the
diagonal place-in-text minus place-in-template.  Diagonals of one template that
lie close together (words put in or left out) are merged, hits far apart on
them are cut into spans, and a span counts if its hits, whose words are compared
one by one, cover enough of the template's words.  Spans of a text are kept from the
largest share down, each unless it overlaps a better one that was kept
(licences quote each other); equally good ones that overlap all stay.

Next to the method, the places of the fixed phrases are counted exactly.

Defined cases: NULL text has no words; repeated rows are scanned and returned
each; a text without any hit has no labels and score 0.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD_TABLE, stash
from ledgerline.llm.license_texts import PHRASES, TEMPLATES

GRAM = 4             # words of a k-gram
NEAR = 8             # diagonals that differ by so much at most are merged
GAP = 40             # words between hits of one span
COVER = 0.8          # share of the template's words that a span must cover ...
LONG_COVER = 60      # ... or so many covered words of it, whatever its length

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words_of(text: str) -> list[str]:
    return [w.decode() for w in text.encode().translate(WORD_TABLE).split()]


def _spaced(text: Column) -> Column:
    """All words with two blanks between them and around: ``  a  b  ``."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), BREAKS, "  ")


def templates(spark: SparkSession, table: list[tuple[str, str]] = TEMPLATES, gram: int = GRAM) -> DataFrame:
    """(h, gram, template, label, t_pos, t_words): the places of every k-gram."""
    rows = []
    for t, (label, text) in enumerate(table):
        w = _words_of(text)
        if len(w) < gram:
            raise ValueError(f"template {t} has fewer than {gram} words")
        rows += [(t, label, k, len(w), w[k:k + gram]) for k in range(len(w) - gram + 1)]
    return spark.createDataFrame(rows, "template int, label string, t_pos int, t_words int, w array<string>") \
        .select(F.xxhash64("w").alias("h"), F.col("w").alias("gram"), "template", "label", "t_pos", "t_words")


def with_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, spaced, words); ``key`` tells apart texts of one id."""
    spaced = _spaced(F.coalesce(F.col(text_col), F.lit("")))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
                    spaced.alias("spaced"))
    core = F.btrim("spaced")
    return d.withColumn("words", F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, "  ")))


def hits(worded: DataFrame, places: DataFrame, gram: int = GRAM) -> DataFrame:
    """One row per k-gram of a text that a template has, for each of its places there."""
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - F.lit(gram - 1)), lambda i: F.xxhash64(F.slice("words", i, gram)))
    rolled = worded.where(F.size("words") >= gram).select("doc_id", "key", "words", F.posexplode(grams).alias("pos", "h"))
    # the words themselves are compared only where the hashes agree
    equal = F.forall(F.zip_with(F.slice("words", F.col("pos") + 1, gram), "gram", lambda x, y: x == y), lambda x: x)
    return rolled.join(F.broadcast(places), "h").where(equal).select(
        "doc_id", "key", "template", "label", "t_words", "pos", "t_pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))


def spans(found: DataFrame, gram: int = GRAM) -> DataFrame:
    """Verified spans: (doc_id, key, label, template, start, stop, covered, share).

    The windows are partitioned by text and template: a partition holds the
    hits of one text on one template."""
    text = ["doc_id", "key", "template"]
    votes = found.groupBy(*text, "label", "t_words", "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(*text).orderBy("diagonal")
    merged = votes.withColumn("apart", (F.col("diagonal") - F.lag("diagonal").over(w) > NEAR).cast("int")) \
        .withColumn("band", F.sum(F.coalesce("apart", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bands = merged.select(*[F.col(c).alias(f"m_{c}") for c in text], F.col("diagonal").alias("m_diagonal"), "band")
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in (*text, "diagonal")]
    banded = found.join(bands, same).drop("m_doc_id", "m_key", "m_template", "m_diagonal")
    w = Window.partitionBy(*text, "band").orderBy("pos", "t_pos")
    cut = banded.withColumn("gap", (F.col("pos") - F.lag("pos").over(w) > GAP).cast("int")) \
        .withColumn("span", F.sum(F.coalesce("gap", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # template words covered by the hits of a span
    grouped = cut.groupBy(*text, "label", "t_words", "band", "span").agg(
        F.min("pos").alias("start"), (F.max("pos") + gram).alias("stop"), F.array_sort(F.collect_set("t_pos")).alias("at"))
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(gram), F.coalesce(F.get("at", i + 1) - x, F.lit(gram)))),
                          F.lit(0), lambda a, x: a + x)
    kept = grouped.withColumn("covered", covered).withColumn("share", F.col("covered") / F.col("t_words")) \
        .where((F.col("share") >= COVER) | (F.col("covered") >= LONG_COVER))
    fields = ["start", "stop", "covered", "share", "template", "label"]
    each = kept.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*fields)).alias("spans"))
    best = F.udf(_best_spans, "array<struct<start: int, stop: int, covered: int, share: double, template: int, label: string>>", useArrow=True)
    return each.select("doc_id", "key", F.inline(best("spans"))).select(*text, "label", "start", "stop", "covered", "share")


def _best_spans(spans):
    """Greedy choice among the spans of one text (short rows, only texts with verified spans get here)."""
    def rank(s):
        return s["share"], s["covered"]

    starts, stops, out = [], [], []      # disjoint runs taken by better spans, in order
    for _, equal in groupby(sorted(spans, key=rank, reverse=True), rank):
        fresh = []
        for s in equal:
            k = bisect_right(starts, s["stop"] - 1)
            if k == 0 or stops[k - 1] <= s["start"]:
                fresh.append(s)
        for s in fresh:
            start, stop = s["start"], s["stop"]
            lo, hi = bisect_left(stops, start), bisect_right(starts, stop)
            if lo < hi:
                start, stop = min(start, starts[lo]), max(stop, stops[hi - 1])
            starts[lo:hi], stops[lo:hi] = [start], [stop]
        out += fresh
    return out


def _places(spaced: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(places, first word, last word) of a phrase's words standing consecutively."""
    needle = " " + phrase.replace(" ", "  ") + " "
    present = F.instr(spaced, needle) > 0
    n = F.when(present, (F.char_length(spaced) - F.char_length(F.replace(spaced, F.lit(needle), F.lit("")))) / len(needle)).otherwise(0)

    def words_before(cut: Column) -> Column:  # blanks come in pairs: one pair before each word
        return ((F.char_length(cut) - F.char_length(F.replace(cut, F.lit("  "), F.lit("")))) / 2).cast("long")

    head = F.substring_index(spaced, needle, 1)
    tail = F.substring_index(spaced, needle, -1)
    all_words = words_before(spaced) - 1
    last = all_words - words_before(tail) - len(phrase.split(" "))
    return n.cast("long"), F.when(present, words_before(head)), F.when(present, last)


def scan(docs: DataFrame, table: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, phrase places, labels and the verified spans."""
    worded = with_words(docs, id_col, text_col)
    found = [(label, *_places(F.col("spaced"), phrase)) for phrase, label in phrases]
    base = worded.select(
        "doc_id", "key", F.size("words").cast("long").alias("n_words"),
        sum((n for _, n, _, _ in found), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.array(*[a for _, _, a, _ in found])).alias("first_word"),
        F.array_max(F.array(*[b for _, _, _, b in found])).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for label, n, _, _ in found])))).alias("base_list"))
    places = templates(docs.sparkSession, table)
    each = stash(hits(worded, places).distinct(), "license-hits")
    verified = spans(each).groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set("label")).alias("more"), F.max("share").alias("share"),
        F.array_sort(F.collect_list(F.struct("start", "stop", "label", "covered", "share"))).alias("spans"))
    v = verified.select(F.col("doc_id").alias("v_id"), F.col("key").alias("v_key"), "more", "share", "spans")
    joined = base.join(v, F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("key") == F.col("v_key")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), "spans")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("spans")
