"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects a document whose measure exceeds a cutoff.  Cutoffs come in bundles, one cutoff for each rule, in a fixed
sequence of LEVELS that runs from customary loose cutoffs to strict ones.  Per stratum (language) the bundles are tested in this order
on the labelled documents: a bundle is certified when the exact binomial (Clopper-Pearson) test shows that the share of good
documents which any of its rules rejects is at most ``risk``, at level ``level`` divided by the number of strata (Bonferroni).
Within a stratum the order is fixed beforehand and stricter bundles reject more, so testing until the first failure needs no
further correction; the strictest bundle certified is taken, and without one the rules reject nothing.  So with probability
1 - level, in every stratum, at most a share ``risk`` of good documents is rejected by the rules.  A stratum needs
ln(level / strata) / ln(1 - risk) good labels at least: 217 with four strata.

Defined cases: null or blank text has no words, fails the base check and is not kept; every language is a stratum, however many
there are; null language forms the stratum ``*``, which also serves languages without good labels; repeated rows
give repeated results; of several rows of one labelled id the one that is rejected soonest counts; without labels nothing is
certified and only the base check rejects; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import SPACES, cut, small, table

#: Share of good documents of a stratum that all rules together may reject, and the error level of that statement.
RISK, LEVEL = 0.02, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

LEVELS = 20


def _path(loose: float, strict: float) -> list[float]:
    return [round(loose + (strict - loose) * k / (LEVELS - 1), 6) for k in range(LEVELS)]


#: Measure of each rule (larger is worse; null, which no rule rejects, where there are no words) and its cutoffs by level, fixed before any data are seen.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / nullif(word_chars, 0)", _path(0.1, 0.005)),
    "dup_lines": ("n_dup_lines / nullif(n_lines, 0)", _path(0.5, 0.12)),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", _path(0.2, 0.01)),
    "long_words": ("word_chars / nullif(n_words, 0)", _path(10, 6)),
    "short_words": ("-(word_chars / nullif(n_words, 0))", _path(-3, -4.5)),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs and the base measures of its whole texts; one row in, one row out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(*keep, text.alias("_vt"), F.array_remove(F.split(text, SPACES), "").alias("_vw"), _lines_with_words(text).alias("_vl"))
    n = F.size("_vw")
    out = out.withColumn("_vx", F.transform("_vw", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*(F.get("_vx", i + k) for k in range(WINDOW)))
    out = out.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_vw", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_vt", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_vl").cast("long").alias("n_lines"),
        (F.size("_vl") - F.size(F.array_distinct("_vl"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).alias("_vh"),
    )
    # Windows found twice: sorted by hash, a window equals a neighbour.  Only documents with a repeated hash are sorted.
    twice = F.size(F.array_distinct("_vh")) < F.size("_vh")
    out = out.withColumn("_vs", F.when(twice, F.sort_array(F.transform("_vh", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).drop("_vh")
    at = lambda k: F.get("_vs", k)
    same = lambda k: F.when(F.coalesce(at(k)["h"] == at(k - 1)["h"], F.lit(False)) | F.coalesce(at(k)["h"] == at(k + 1)["h"], F.lit(False)), at(k)["p"])
    places = F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size("_vs") - 1), same), lambda p: p.isNotNull()))
    out = out.withColumn("_vp", F.when(F.col("_vs").isNotNull(), places))
    union = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
    covered = F.aggregate("_vp", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), union, lambda a: a["n"])
    return out.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def _log_factorial(n: str) -> str:
    small = ", ".join(repr(math.lgamma(k + 1)) + "D" for k in range(16))
    return f"CASE WHEN {n} < 16 THEN element_at(array({small}), CAST({n} AS INT) + 1) ELSE {n} * ln({n}) - {n} + 0.5 * ln(2 * pi() * {n}) + 1 / (12 * {n}) - 1 / (360 * pow({n}, 3)) + 1 / (1260 * pow({n}, 5)) END"


def binomial_cdf(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k), X binomial(n, p), exact up to rounding where k < n p; 1 elsewhere (such k never certify).

    Terms are summed downwards from k, where they fall at least as fast as a normal tail; beyond 12 deviations they are nil.
    """
    q = 1 - p
    top = f"({_log_factorial(n)}) - ({_log_factorial(k)}) - ({_log_factorial(f'({n} - {k})')}) + {k} * ln({p!r}D) + ({n} - {k}) * ln({q!r}D)"
    down = f"CASE WHEN {k} > 0 THEN sequence(CAST({k} AS INT), CAST(greatest(1, {k} - 60 - 12 * sqrt({n} * {p!r}D)) AS INT), -1) ELSE array() END"
    ratio = f"aggregate({down}, struct(1D AS t, 1D AS s), (a, i) -> struct(a.t * i / ({n} - i + 1) * {q / p!r}D AS t, a.s + a.t * i / ({n} - i + 1) * {q / p!r}D AS s), a -> a.s)"
    return f"CASE WHEN {k} >= {n} * {p!r}D THEN 1D ELSE exp({top}) * {ratio} END"


def first_level() -> Column:
    """The first level, from 1, at which some rule rejects a measured document; LEVELS + 1 if none does."""
    passed = [F.coalesce(F.size(F.filter(F.lit(grid), lambda c: F.expr(m) <= c)), F.lit(LEVELS)) for m, grid in RULES.values()]
    return F.least(*(F.when(F.expr(m).isNull(), LEVELS).otherwise(n) for (m, _), n in zip(RULES.values(), passed))) + 1


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum: ``stratum``, ``level`` of the bundle and ``cut_<rule>`` (null: nothing is certified there).

    measured: doc_id, lang and the measures.  labels: doc_id, quality; only quality = 1 rows whose document passes the base
    check count as good.  A label that is repeated or joins repeated documents counts once.  One row a language, and one (*) for
    those without.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = measured.where(~base_failed()).select("doc_id", "lang", first_level().alias("first")).join(good, "doc_id", "left_semi")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("first", "lang")).alias("r")).select("r.*")
    by_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum((F.col("first") <= k).cast("double")).alias(f"k_{k}") for k in range(1, LEVELS + 1)))
    own = F.coalesce("lang", F.lit("*"))
    names = [c for c in by_lang.columns if c != "lang"]
    strata = by_lang.select(own.alias("stratum"), *names).groupBy("stratum").agg(*(F.sum(c).alias(c) for c in names))
    strata = strata.crossJoin(F.broadcast(strata.agg(F.count(F.lit(1)).alias("strata"))))  # one row
    tested = strata.select("stratum", "strata", "n", F.posexplode(F.array(*(f"k_{k}" for k in range(1, LEVELS + 1)))).alias("at", "k"))
    certified = F.expr(f"({binomial_cdf('k', 'n', risk)}) <= {level!r}D / strata")
    best = tested.groupBy("stratum").agg(F.max(F.when(certified, F.col("at") + 1)).alias("level"))
    return best.select("stratum", "level", *(F.expr(f"CASE level {' '.join(f'WHEN {k} THEN {c!r}D' for k, c in enumerate(grid, 1))} END").alias(f"cut_{r}") for r, (_, grid) in RULES.items()))


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """measured with ``base_failed``, ``failed_rules`` (names) and ``kept``.  cuts is broadcast if it is small."""
    own = cuts.select(F.col("stratum").alias("_vs_lang"), F.struct(*(f"cut_{r}" for r in RULES)).alias("_vc_own")).where("_vs_lang <> '*'")
    rest = cuts.where("stratum = '*'").agg(F.first(F.struct(*(f"cut_{r}" for r in RULES))).alias("_vc_rest"))
    joined = measured.join(small(own), F.col("lang") == F.col("_vs_lang"), "left").join(F.broadcast(rest), F.lit(True), "left")
    cut_of = lambda r: F.when(F.col("_vs_lang").isNotNull(), F.col(f"_vc_own.cut_{r}")).otherwise(F.col(f"_vc_rest.cut_{r}"))
    failed = F.array_compact(F.array(*(F.when(F.expr(m) > cut_of(r), F.lit(r)) for r, (m, _) in RULES.items())))
    out = joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_vs_lang", "_vc_own", "_vc_rest")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(measures(table(spark, sf_dir, "documents"), ["doc_id", "lang"]))
    cuts = cutoffs(measured, table(spark, sf_dir, "labels"))
    return judge(measured, cuts).select("doc_id", *BASE, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the columns of docs.

    Texts are measured once; the measures are written, and the rejected documents leave by a join on id and text hash.
    """
    whole = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("row"))
    measured = cut(measures(whole, ["doc_id", "lang", "hash"]))
    cuts = cut(cutoffs(measured, table(spark, sf_dir, "labels")))
    gone = judge(measured, cuts).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash"))
    return whole.join(small(gone), same, "left_anti").select("row.*")
