"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

A document's score is the largest of its weighted junk shares (symbols,
capitals, stuttered words, repeated passages, repeated lines).  For each
stratum a ladder of cutoffs is tested on the labelled documents, from the most
lenient to the strictest, in a fixed sequence: a cutoff is certified if the
exact binomial tail says that its share of falsely rejected good documents is
at most ``max_false_rejection``, at the level ``error / strata`` (Bonferroni
over the strata; the fixed sequence needs no correction within one, and with
nested rules its p-values only rise).  With probability 1 - ``error`` every
chosen cutoff keeps its promise.  Among the certified cutoffs the one that
separates bad from good best is taken, the most lenient one at a tie.

Strata with fewer than ``least_good`` good labels share one pooled stratum,
which also serves strata without labels.  Where nothing can be certified
nothing is rejected beyond the base rule.

Defined cases: NULL text has no words and fails the base rule; a NULL stratum
belongs to the pooled one; of labels that contradict each other the lower
quality counts, a NULL quality is no label; without labels only the base rule
rejects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import stash

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPAN = 8                 # words of a window for repeated passages


@dataclass(frozen=True)
class QualityParams:
    least_words: int = 20
    repeat_percent: int = 30
    max_false_rejection: float = 0.02
    error: float = 0.05
    least_good: int = 400
    ladder: tuple[float, ...] = (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)
    weights: tuple[tuple[str, float], ...] = (("symbols", 4.0), ("capitals", 1.0), ("stutter", 1.0), ("repeats", 1.0), ("lines", 1.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (a lambda variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _covered(h: Column) -> Column:
    """Words in windows whose hash occurs at least twice among ``h``."""
    def starts(s: Column) -> Column:  # s: (hash, position) sorted
        twin = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        return F.array_sort(F.transform(twin, lambda x: x["i"]))

    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    total = _let(_let(pairs, starts), lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(SPAN), F.coalesce(F.get(p, i + 1) - x, F.lit(SPAN)))),
        F.lit(0), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total)


def add_metrics(docs: DataFrame, text_col: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with the base counts and junk shares as prefixed columns."""
    p, text = prefix, F.col(f"{prefix}t")
    w, h = F.col(f"{p}w"), F.col(f"{p}h")
    d = docs.withColumn(f"{p}t", F.coalesce(F.col(text_col), F.lit("")))
    core = F.btrim(text, F.lit(BLANKS))
    d = d.withColumn(f"{p}w", F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, "[\\x20\\x09-\\x0D]+")))
    d = d.withColumn(f"{p}h", F.when(F.size(w) >= SPAN, F.transform(
        F.sequence(F.lit(1), F.size(w) - F.lit(SPAN - 1)), lambda i: F.xxhash64(F.slice(w, i, SPAN)))).otherwise(F.array().cast("array<long>")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    d = d.withColumns({
        f"{p}lines": lines,
        f"{p}chars": _without(text, BLANKS).cast("long"),
        f"{p}symbols": (F.char_length(text) - _without(text, SYMBOLS)).cast("long"),
        f"{p}capitals": (F.char_length(text) - _without(text, CAPITALS)).cast("long"),
        f"{p}stutter": F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long"),
        f"{p}repeats": _covered(h).cast("long"),
        f"{p}words": F.size(w).cast("long"),
    })
    return d.withColumns({
        f"{p}n_lines": F.size(f"{p}lines").cast("long"),
        f"{p}dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(F.col(f"{p}lines")))).cast("long"),
    }).drop(f"{p}t", f"{p}w", f"{p}h", f"{p}lines")


def base_failed(params: QualityParams, p: str = "_q_") -> Column:
    return (F.col(f"{p}words") < params.least_words) | (100 * F.col(f"{p}repeats") > params.repeat_percent * F.col(f"{p}words"))


def score(params: QualityParams, p: str = "_q_") -> Column:
    """The largest weighted junk share."""
    words, chars, lines = (F.greatest(F.col(f"{p}{c}"), F.lit(1)).cast("double") for c in ("words", "chars", "n_lines"))
    share = {"symbols": F.col(f"{p}symbols") / chars, "capitals": F.col(f"{p}capitals") / chars, "stutter": F.col(f"{p}stutter") / words,
             "repeats": F.col(f"{p}repeats") / words, "lines": F.col(f"{p}dup_lines") / lines}
    return F.greatest(*[share[name] * F.lit(weight) for name, weight in params.weights])


def _lgamma(x: Column) -> Column:
    """log Gamma(x), x >= 1: Stirling's series eight steps up."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    for k in range(8):
        series = series - F.log(x + float(k))
    return series


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate); 1 from the mean on.  The terms are
    summed downwards from k until they can't matter to a double."""
    kd, nd = k.cast("double"), n.cast("double")
    top = _lgamma(nd + 1) - _lgamma(kd + 1) - _lgamma(nd - kd + 1) + kd * F.log(F.lit(rate)) + (nd - kd) * F.log(F.lit(1 - rate))
    terms = F.least(k.cast("long"), F.ceil(F.lit(40.0) * F.sqrt(nd * rate * (1 - rate))) + 60)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, j: Column) -> Column:
        at = kd - j                                       # from the term of at + 1 to that of at
        t = a["t"] * (at + 1) / (nd - at) * F.lit((1 - rate) / rate)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    downwards = F.when(terms >= 1, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(downwards, start, step)["s"]
    return F.when(kd >= nd * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def cutoffs(scored: DataFrame, params: QualityParams) -> DataFrame:
    """(stratum, cutoff): one row per stratum with labels of its own and one
    with stratum NULL for the pooled one; cutoff NULL: none is certified.

    ``scored``: stratum, score, good (boolean) of the labelled documents that
    pass the base rule.  They are counted first, so everything after that has
    at most strata x ladder rows."""
    first = F.lit(len(params.ladder))                     # the first rung that rejects the document
    for i, v in reversed(list(enumerate(params.ladder))):
        first = F.when(F.col("score") >= v, F.lit(i)).otherwise(first)
    counts = scored.groupBy("stratum", first.alias("rung")).agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    own = Window.partitionBy("stratum")
    pooled = stash(counts.withColumn("_n", F.sum("good").over(own))
                   .withColumn("stratum", F.when(F.col("_n") >= params.least_good, F.col("stratum")))
                   .groupBy("stratum", "rung").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "quality-counts")
    strata = pooled.select("stratum").distinct()
    level = strata.agg((F.lit(params.error) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("level")).scalar()
    upto = own.orderBy("rung").rowsBetween(Window.unboundedPreceding, 0)
    best = pooled.withColumn("k", F.sum("good").over(upto)).withColumn("caught", F.sum("bad").over(upto)) \
        .withColumn("n", F.sum("good").over(own)).withColumn("n_bad", F.sum("bad").over(own)) \
        .where((F.col("rung") < len(params.ladder)) & (F.col("n") > 0) & (F.col("caught") > 0)) \
        .withColumn("p", binomial_tail(F.col("k"), F.col("n"), params.max_false_rejection)).where(F.col("p") <= level) \
        .withColumn("gain", F.col("caught") / F.col("n_bad") - F.col("k") / F.col("n")).where("gain > 0") \
        .groupBy("stratum").agg(F.max_by("rung", F.struct(F.col("gain"), -F.col("rung"))).alias("rung"))
    ladder = F.array(*[F.lit(v) for v in params.ladder])
    b = best.select(F.col("stratum").alias("_s"), F.get(ladder, F.col("rung")).alias("cutoff"))
    return strata.join(b, F.col("stratum").eqNullSafe(F.col("_s")), "left").select("stratum", "cutoff")


def _chosen(metrics: DataFrame, labels: DataFrame, params: QualityParams, id_col: str, stratum_col: str) -> DataFrame:
    good = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("_quality")) \
        .where("_id IS NOT NULL AND _quality IS NOT NULL").groupBy("_id").agg((F.min("_quality") > 0).alias("_good"))
    scored = metrics.join(good, F.col(id_col) == F.col("_id")).where(~base_failed(params)).select(
        F.col(stratum_col).alias("stratum"), score(params).alias("score"), F.col("_good").alias("good"))
    return stash(cutoffs(scored, params), "quality-cutoffs")


def _with_verdict(df: DataFrame, chosen: DataFrame, params: QualityParams, stratum_col: str) -> DataFrame:
    """Adds _q_kept.  A stratum of its own has ``least_good`` labels at least;
    its row is broadcast while there are at most 100,000 of them (a few MB),
    beyond that the join shuffles and AQE splits a hot stratum."""
    own = chosen.where("stratum IS NOT NULL").select(F.col("stratum").alias("_stratum"), F.col("cutoff").alias("_own"))
    if own.count() <= 100_000:
        own = F.broadcast(own)
    pooled = chosen.where("stratum IS NULL").agg(F.max("cutoff").alias("cutoff")).scalar()
    joined = df.join(own, F.col(stratum_col) == F.col("_stratum"), "left")
    cutoff = F.when(F.col("_stratum").isNotNull(), F.col("_own")).otherwise(pooled)
    rejected = F.coalesce(score(params) >= cutoff, F.lit(False))
    return joined.withColumn("_q_kept", ~(base_failed(params) | rejected)).drop("_stratum", "_own")


def quality_verdicts(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(),
                     id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: the base counts, base_failed, score and kept."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"),
                        F.col(stratum_col).cast("string").alias("_lang"))
    metrics = stash(add_metrics(named, "_text").drop("_text"), "quality-metrics")
    chosen = _chosen(metrics, labels, params, "doc_id", "_lang")
    return _with_verdict(metrics, chosen, params, "_lang").select(
        "doc_id", F.col("_q_words").alias("n_words"), F.col("_q_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"), F.col("_q_repeats").alias("n_repeat_words"),
        base_failed(params).alias("base_failed"), F.col("_q_kept").alias("kept"), score(params).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(),
              id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with their columns as they were.

    The documents are written once beside their metrics, so the metrics are
    computed once, and the verdict's filter can't be moved below them."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).alias("_text"), F.col(stratum_col).cast("string").alias("_lang"))
    metrics = stash(add_metrics(own, "_text").drop("_text"), "quality-metrics")
    chosen = _chosen(metrics, labels, params, "doc_id", "_lang")
    return _with_verdict(metrics, chosen, params, "_lang").where("_q_kept").select("_row.*")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_verdicts(docs, labels).drop("score")


def oracle_sql(params: QualityParams = QualityParams()) -> str:
    """The whole operator as DuckDB SQL."""
    w = dict(params.weights)
    rung = "CASE " + " ".join(f"WHEN score >= {v} THEN {i}" for i, v in enumerate(params.ladder)) + f" ELSE {len(params.ladder)} END"
    ladder = "[" + ", ".join(map(str, params.ladder)) + "]"
    a, b = params.max_false_rejection, 1 - params.max_false_rejection
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT rid, i, w[i:i + {SPAN - 1}] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM w WHERE len(w) >= {SPAN})),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
          SELECT rid, unnest(range(i, i + {SPAN})) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1)
        GROUP BY rid),
stut AS (SELECT rid, count(*) AS n FROM (SELECT rid, w, unnest(range(2, len(w) + 1)) AS i FROM w) WHERE w[i] = w[i - 1] GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
             length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS caps, coalesce(stut.n, 0) AS stutter,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN stut USING (rid)),
s AS (SELECT *, n_words < {params.least_words} OR 100 * n_repeat_words > {params.repeat_percent} * n_words AS base_failed,
             greatest({w['symbols']} * n_symbols / greatest(word_chars, 1), {w['capitals']} * caps / greatest(word_chars, 1),
                      {w['stutter']} * stutter / greatest(n_words, 1), {w['repeats']} * n_repeat_words / greatest(n_words, 1),
                      {w['lines']} * n_dup_lines / greatest(n_lines, 1)) AS score FROM m),
lab AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
c AS (SELECT lang, {rung} AS rung, sum(good::INT) AS good, sum((NOT good)::INT) AS bad FROM s JOIN lab USING (doc_id) WHERE NOT base_failed GROUP BY 1, 2),
p AS (SELECT CASE WHEN n >= {params.least_good} THEN lang END AS stratum, rung, sum(good) AS good, sum(bad) AS bad
      FROM (SELECT *, sum(good) OVER (PARTITION BY lang) AS n FROM c) GROUP BY 1, 2),
q AS (SELECT *, CAST(sum(good) OVER (PARTITION BY stratum ORDER BY rung) AS BIGINT) AS k, sum(bad) OVER (PARTITION BY stratum ORDER BY rung) AS caught,
             CAST(sum(good) OVER (PARTITION BY stratum) AS BIGINT) AS n, sum(bad) OVER (PARTITION BY stratum) AS n_bad FROM p),
r AS (SELECT *, CASE WHEN k >= n * {a} THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({a}) + (n - j) * ln({b})))
                     FROM (SELECT unnest(range(0, k + 1)) AS j)) END AS pv
      FROM q WHERE rung < {len(params.ladder)} AND n > 0 AND caught > 0),
best AS (SELECT stratum, {ladder}[rung + 1] AS cutoff FROM (
           SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY caught / n_bad - k / n DESC, rung) AS place FROM r
           WHERE pv <= {params.error} / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM p)) AND caught / n_bad - k / n > 0) WHERE place = 1),
own AS (SELECT DISTINCT p.stratum, best.cutoff FROM p LEFT JOIN best ON p.stratum = best.stratum WHERE p.stratum IS NOT NULL)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR coalesce(score >= CASE WHEN own.stratum IS NOT NULL THEN own.cutoff ELSE (SELECT max(cutoff) FROM best WHERE stratum IS NULL) END, false)) AS kept
FROM s LEFT JOIN own ON s.lang = own.stratum"""
