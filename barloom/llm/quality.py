"""Quality rules whose cutoffs are certified on labelled documents (risk-controlled thresholds).

Every rule scores a document (higher is worse) and rejects above a cutoff. For each stratum and rule a fixed grid of
cutoffs is tried on the documents labelled good. With n good documents of which a cutoff rejects k, the cutoff is
certified when P(Binomial(n, limit) <= k) <= delta / tests: the exact (Clopper-Pearson) upper bound of its false
rejection rate is then below limit, for all tests at once (Bonferroni). Of the certified cutoffs of a rule the one with
the largest surplus of rejected bad over rejected good labelled documents is used, if any has a surplus; ties go
to the most lenient. The limit of a stratum is shared
equally by the rules, so their union stays within it.

Null text counts as empty. A null stratum is a stratum of its own. Documents of a stratum without enough labels are
judged by the base rules alone, and so is every row without a key or a label for the cutoffs: it is judged, but doesn't
vote on them. Labels that appear several times count as good only if all agree; repeated rows vote each. A text of any
length is counted whole, in one row. An empty table gives an empty result; extra columns stay as they are, whatever
their names, unless they have the name of an added one, which replaces them. A stage returns the columns that it got.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rule -> (score, cutoffs from strict to lenient).
GRIDS = {
    "symbols": [0.01, 0.02, 0.04, 0.08, 0.15, 0.3],
    "dup_lines": [0.1, 0.2, 0.3, 0.45, 0.6],
    "repeats": [0.1, 0.2, 0.3, 0.4],
    "long_words": [9.0, 10.5, 12.0, 15.0, 20.0],
    "short_words": [-4.5, -4.0, -3.5, -3.0, -2.0],
}
BASE_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = (*BASE_COUNTS, "n_lines", "base_failed")


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and base_failed."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    df = common.carried(docs, ADDED, text=F.col(text)).withColumns({
        "_words": F.filter(F.split(whole, common.GAP), lambda w: w != ""),
        "_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(common.WORD)),
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
    })
    words = F.col("_words")
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
    })
    windows = F.col("_windows")
    # Most texts repeat no window: only the others are sorted.
    df = df.withColumn("_twice", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.col("_twice")
    same = lambda x, i: (x.h == F.get(twice, i - 1).h) | (x.h == F.get(twice, i + 1).h)
    covered = F.array_distinct(F.flatten(F.transform(F.filter(twice, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    df = df.withColumn("n_repeat_words", F.when(twice.isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).select("row.*", *ADDED)


def scores() -> dict[str, Column]:
    """Score of each rule, from the counts of annotate()."""
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "symbols": per("n_symbols", "word_chars"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "long_words": per("word_chars", "n_words"),
        "short_words": -per("word_chars", "n_words"),
    }


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, carried back."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    back = F.lit(0.0)
    for j in range(8):
        back = back + F.log(x + j)
    return series - back


def binomial_cdf(k: Column, n: Column, p: float, terms: int = 2000) -> Column:
    """P(Binomial(n, p) <= k) for k < n * p, else 1. Beyond the largest 2000 terms a geometric bound stands for the rest."""
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = lambda i: i / (n - i + 1) * ((1 - p) / p)
    steps = F.sequence(F.lit(0), F.least(k, F.lit(terms)).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    end = F.aggregate(steps, start, lambda a, j: F.struct((a.term * ratio(k - j)).alias("term"), (a["sum"] + a.term).alias("sum")))
    rest = F.when(k > terms, end.term / (1 - ratio(k - terms - 1))).otherwise(F.lit(0.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * (end["sum"] + rest))


def calibrate(annotated: DataFrame, labels: DataFrame, *, stratum: str = "lang", limit: float = 0.05, delta: float = 0.05, key: str = "doc_id") -> DataFrame:
    """Rows (_stratum, cut_<rule>...): the certified cutoff of each rule, null where none is."""
    good = labels.groupBy(key).agg(F.min("quality").alias("_good")).filter(F.col("_good").isNotNull() & F.col(key).isNotNull())
    score = scores()
    known = annotated.filter(~F.col("base_failed")).select(key, F.col(stratum).cast("string").alias("_stratum"), *[c.alias(f"s_{r}") for r, c in score.items()]).join(good, key)
    tests = [(r, c) for r in GRIDS for c in GRIDS[r]]
    hit = lambda r, c, q: F.count_if((F.col(f"s_{r}") > c) & (F.col("_good") == q))
    counted = known.groupBy("_stratum").agg(
        F.count_if(F.col("_good") == 1).alias("_n"),
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cut"), hit(r, c, 1).alias("k"), hit(r, c, 0).alias("bad")) for r, c in tests]).alias("_tests"),
    )
    share = limit / len(GRIDS)
    # Every stratum runs all tests; the window is over one row for each stratum.
    strata = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    rows = counted.withColumn("_strata", strata).select("_stratum", "_n", "_strata", F.explode("_tests").alias("t"))
    certified = rows.filter(binomial_cdf(F.col("t.k"), F.col("_n"), share) <= delta / (len(tests) * F.col("_strata")))
    surplus = F.col("t.bad") - F.col("t.k")
    best = F.when(surplus > 0, F.struct(surplus, F.col("t.cut").alias("cut")))
    return certified.groupBy("_stratum").agg(*[F.max(F.when(F.col("t.rule") == r, best)).getField("cut").alias(f"cut_{r}") for r in GRIDS])


def judge(annotated: DataFrame, cutoffs: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """annotated with kept: false where a base rule fails or a score is above its stratum's cutoff."""
    above = F.lit(False)
    for r, c in scores().items():
        above = above | F.coalesce(c > F.col(f"cut_{r}"), F.lit(False))
    rows = common.carried(annotated, ("kept",), own=F.col(stratum).cast("string"), **{c: F.col(c) for c in ADDED})
    joined = rows.join(cutoffs, F.col("own").eqNullSafe(F.col("_stratum")), "left")
    # One comparison of both: a filter on base_failed alone would be evaluated, and the windows sorted, a second time below the join.
    return joined.withColumn("kept", F.greatest(F.col("base_failed").cast("int"), above.cast("int")) == 0).select("row.*", "kept")


def rate(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", key: str = "doc_id", **limits) -> DataFrame:
    """docs with the counts, base_failed and kept. Calibration reads the counts alone, written and deleted again; the verdict
    counts anew while it reads, so that no text is written or shuffled."""
    annotated = annotate(docs)
    counts = common.cut(annotated.select(*dict.fromkeys([key, stratum]), *ADDED), "quality")
    cutoffs = _cutoffs(counts, labels, stratum=stratum, key=key, **limits)
    common.discard(counts)
    return judge(annotated, cutoffs, stratum=stratum)


def _cutoffs(counts: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The cutoffs as a table, whose size Spark knows when it plans the join of the verdict."""
    return common.cut(calibrate(counts, labels, **how), "cutoffs")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. All that is said of rate() holds; columns stay as they are."""
    rows = common.carried(docs, doc_id=F.col("doc_id"), text=F.col("text"), lang=F.col("lang"))
    return rate(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = annotate(common.documents(spark, sf_dir)).select("doc_id", "lang", *BASE_COUNTS, "n_lines", "base_failed")
    annotated = common.cut(docs, "quality")
    cutoffs = _cutoffs(annotated, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(annotated, cutoffs).select("doc_id", *BASE_COUNTS, "base_failed", "kept")


def _sql(limit: float = 0.05, delta: float = 0.05) -> str:
    share, tests = limit / len(GRIDS), [(r, c) for r in GRIDS for c in GRIDS[r]]
    score = {
        "symbols": "coalesce(n_symbols / nullif(word_chars, 0), 0)", "dup_lines": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)", "repeats": "coalesce(n_repeat_words / nullif(n_words, 0), 0)",
        "long_words": "coalesce(word_chars / nullif(n_words, 0), 0)", "short_words": "-coalesce(word_chars / nullif(n_words, 0), 0)",
    }
    long = lambda source, more: " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, {s} AS score{more} FROM {source}" for r, s in score.items())
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
i AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, unnest(list_transform(generate_series(1, len(w) - 2), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) AS x FROM d WHERE len(w) > 2),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM i),
p AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM r WHERE n > 1) GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN p ON d.doc_id = p.doc_id),
g AS (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id),
k AS (SELECT f.*, good FROM f JOIN g ON f.doc_id = g.doc_id WHERE NOT base_failed AND good IS NOT NULL),
t(rule, cut) AS (VALUES {', '.join(f"('{r}', {c})" for r, c in tests)}),
s AS ({long('k', ', good')}),
n AS (SELECT lang, count(*) FILTER (good = 1) AS n FROM k GROUP BY lang),
m AS (SELECT s.lang, s.rule, t.cut, count(*) FILTER (score > cut AND good = 1) AS k, count(*) FILTER (score > cut AND good = 0) AS bad FROM s JOIN t ON s.rule = t.rule GROUP BY ALL),
c AS (SELECT m.*, n.n FROM m JOIN n ON m.lang IS NOT DISTINCT FROM n.lang WHERE m.k < n.n * {share} AND m.bad > m.k),
b AS (SELECT lang, rule, arg_max(cut, (bad - k, cut)) AS cut FROM c
  WHERE list_sum(list_transform(generate_series(0, k), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share})))) <= {delta} / ({len(tests)} * (SELECT count(*) FROM n)) GROUP BY lang, rule),
x AS (SELECT DISTINCT a.doc_id FROM ({long('f', '')}) a JOIN b ON a.rule = b.rule AND a.lang IS NOT DISTINCT FROM b.lang AND a.score > b.cut)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.doc_id IS NULL AS kept FROM f LEFT JOIN x ON f.doc_id = x.doc_id
"""


OP10_SQL = _sql()
