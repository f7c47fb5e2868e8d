"""Quality rules: text statistics, and outliers by minimum-covariance-determinant estimates for each language and source.

All of it is DataFrame functions. An estimate is found from several deterministic starts (medians and median absolute
deviations; means and covariances of all rows; the same of rows drawn in towards the medians). From each, concentration steps
are taken until the determinant no longer falls: keep the share of rows nearest to the present estimate, estimate again from
these. The start that ends at the smallest determinant wins, and rows far from it are left out of a last estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written

N = 5  # words in a window
DIMS = ("x1", "x2", "x3", "x4")
#: An estimate is of a group, from a start.
KEYS = ("grp", "start")
#: Smallest deviations told apart: log mean word length, and log(1 + percent) of symbols, repeated lines and repeated words.
FLOORS = (0.04, 0.3, 0.6, 0.6)
SHARE, LEAST_ROWS = 0.75, 60
#: Concentration ends when no logarithm of a determinant moves by more than this, or after so many steps.
STILL, MOST_STEPS = 1e-6, 40
MOVING = f"was - det > {STILL}"
#: For 4 dimensions: consistency factors of the 75 % subset and of the reweighted rows, and the 97.5 % point of chi-square.
RAW_FACTOR, FINAL_FACTOR, REWEIGHT_AT = 1.486, 1.0645, 11.14
#: Rows beyond this squared distance are rejected (chi-square with 4 degrees of freedom leaves 1e-4 there).
CUTOFF = 23.5
#: Words at which a statistic has half its full weight: means over few words are noisy.
STEADY_WORDS = 200.0
#: Bins of a factor e of squared distance, and parts of the bin that holds the subset's edge: ranks are told to about 1e-5.
BINS, PARTS = 32, 4096
#: Deviations from the median to which values are drawn in for the third start.
DRAWN_IN = 2.0
#: Tables with a row for each group are broadcast up to this number (some 200 bytes each); beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _words, _word_chars, _symbols, _lines, _dup_lines and _repeat_words of the whole text (null: an empty one).

    Five-word windows are compared by 64-bit hashes within their own text; only texts with an equal pair sort them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    w = F.col("_w")
    windows = F.when(
        F.size(w) >= N,
        F.transform(F.sequence(F.lit(0), F.size(w) - N), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(N)])),
    ).otherwise(F.array().cast("array<bigint>"))
    s = F.col("_sorted")

    def twin(k: Column) -> Column:
        own = F.get(s, k)["h"]
        return F.coalesce(F.get(s, k - 1)["h"] == own, F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == own, F.lit(False))

    places = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin), lambda k: F.get(s, k)["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-N).alias("last"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(N), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return (
        docs.withColumns({"_w": words(F.col(text_col)), "_l": lines, "_word_chars": bare, "_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")})
        .withColumns({"_g": windows, "_words": F.size("_w").cast("long"), "_lines": F.size("_l").cast("long"), "_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")})
        .drop("_w", "_l")
        .withColumn("_sorted", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("_repeat_words", F.when(s.isNull(), F.lit(0)).otherwise(covered).cast("long"))
        .drop("_g", "_sorted")
    )


def _cholesky(est: DataFrame, *more: str) -> DataFrame:
    """est (n, s1.., p11, p21, ..: sums and products) with means m1.. and the Cholesky factor l11, l21, .. of the covariance."""
    d = range(1, len(DIMS) + 1)
    est = est.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in d})
    cov = {(i, j): F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOORS[i - 1] ** 2 if i == j else 0.0) for i in d for j in d if j <= i}
    for j in d:
        for i in range(j, len(DIMS) + 1):
            rest = cov[i, j] - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(1, j)), F.lit(0.0))
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i - 1] ** 2 / 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return est.select(*KEYS, "n", *more, *[f"m{i}" for i in d], *[f"l{i}{j}" for i in d for j in d if j <= i])


def _distance() -> Column:
    """Squared Mahalanobis distance of x1.. from m1.. with the factor l..: solved forward, no inverse needed."""
    y: list[Column] = []
    for i, x in enumerate(DIMS, 1):
        y.append((F.col(x) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * y[k - 1] for k in range(1, i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def _sums() -> list[Column]:
    d = range(1, len(DIMS) + 1)
    return [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in d] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in d for j in d if j <= i]


def _moments(near: DataFrame) -> DataFrame:
    return _cholesky(near.groupBy(*KEYS).agg(*_sums()))


def _added(counts: DataFrame, wanted: Column, *by: str) -> DataFrame:
    """counts (grp, start, by, n, ..), in the order of by up to the wanted number of rows, with before, upto and wanted."""
    here = Window.partitionBy(*KEYS)
    upto = counts.withColumns({"upto": F.sum("n").over(here.orderBy(*by)), "all": F.sum("n").over(here)})
    return upto.withColumns({"before": F.col("upto") - F.col("n"), "wanted": wanted}).where("before < wanted")


def _step(vectors: DataFrame, now: DataFrame, few: bool) -> tuple[DataFrame, bool]:
    """A concentration step: the estimates from the rows of the smallest distances that make up SHARE of their group (ties with the
    last one count), with edge (the bin of the last one), was (the determinant before) and det; and whether any fell.

    Rows are counted and summed by bins of distance, and near the edge of the step before by parts of them: no group, however
    large, is ranked in one task. Where the edge has moved farther, the rows of its new bin are read once more.
    """
    scale = F.log(F.col("d2") + 1e-12) * BINS
    given = _hinted(now.select(*KEYS, F.col("edge").alias("near"), F.col("det").alias("was"), *[c for c in now.columns if c[0] in "ml"]), few)
    rows = vectors.join(given, "grp").select(*KEYS, *DIMS, "near", "was", _distance().alias("d2"))
    rows = rows.select(*KEYS, *DIMS, "near", "was", F.floor(scale).cast("int").alias("bin"), F.floor((scale - F.floor(scale)) * PARTS).cast("int").alias("part"))
    parted = rows.withColumn("part", F.when(F.abs(F.col("bin") - F.col("near")) <= 1, F.col("part")).otherwise(-1))
    sums = [c for c in parted.groupBy(*KEYS).agg(*_sums()).columns if c not in KEYS]
    counts = _added(parted.groupBy(*KEYS, "bin", "part").agg(F.max("was").alias("was"), *_sums()), F.ceil(SHARE * F.col("all")), "bin", "part")
    cut = (F.col("part") < 0) & (F.col("upto") > F.col("wanted"))
    whole = [F.coalesce(F.sum(F.when(~cut, F.col(c))), F.lit(0)).alias(c) for c in sums]
    inner = counts.groupBy(*KEYS).agg(F.max("bin").alias("edge"), F.max("was").alias("was"), F.max(F.when(cut, F.col("wanted") - F.col("before"))).alias("missing"), *whole)
    det = 2 * sum((F.log(f"l{i}{i}") for i in range(1, len(DIMS) + 1)), F.lit(0.0))
    # Written before any filter on them: a filter pushed down through the factor's steps would repeat these many times over.
    inner = written(_cholesky(inner, "edge", "was", "missing", *sums[1:]).withColumn("det", det), "quality-step")
    found = inner.drop("missing", *sums[1:])
    if not inner.where("missing is not null").isEmpty():
        open_ = _hinted(inner.where("missing is not null").select(*KEYS, "edge", "missing"), few)
        parts = rows.join(open_, list(KEYS)).where("bin = edge").groupBy(*KEYS, "part", "missing").agg(*_sums())
        last = _added(parts, F.col("missing"), "part").select(*KEYS, F.lit(None).cast("int").alias("edge"), F.lit(None).cast("double").alias("was"), *sums)
        both = inner.select(last.columns).unionByName(last).groupBy(*KEYS).agg(F.max("edge").alias("edge"), F.max("was").alias("was"), *[F.sum(c).alias(c) for c in sums])
        found = written(_cholesky(both, "edge", "was").withColumn("det", det), "quality-step")
    return found, not found.where(MOVING).isEmpty()


def _hinted(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _starts(vectors: DataFrame, few: bool) -> DataFrame:
    d = range(1, len(DIMS) + 1)
    mid = _hinted(written(vectors.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"m{i}") for i, x in enumerate(DIMS, 1)]), "quality-mid"), few)
    off = vectors.join(mid, "grp").groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in d], *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 10000).alias(f"a{i}") for i in d])
    spread = [F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), 2) + FLOORS[i - 1] ** 2) for i in d]
    plain = written(off.select("grp", *[f"m{i}" for i in d], *[c.alias(f"a{i}") for i, c in zip(d, spread, strict=True)]), "quality-start")
    first = plain.select("grp", F.lit(0).alias("start"), F.lit(0).cast("long").alias("n"), *[f"m{i}" for i in d], *[(F.col(f"a{i}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in d for j in d if j <= i])
    far = DRAWN_IN
    drawn = [F.greatest(F.least(F.col(f"x{i}"), F.col(f"m{i}") + far * F.col(f"a{i}")), F.col(f"m{i}") - far * F.col(f"a{i}")).alias(f"x{i}") for i in d]
    third = vectors.join(_hinted(plain, few), "grp").select("grp", F.lit(2).alias("start"), *drawn)
    return first.unionByName(_moments(vectors.withColumn("start", F.lit(1)))).unionByName(_moments(third))


def covariance_estimates(vectors: DataFrame) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate of each group: vectors (grp, x1..) -> grp, n, m1.., l11...

    FLOORS are added to the variances, so that a statistic that is constant in the subset doesn't make it singular.
    """
    few = vectors.select("grp").distinct().count() <= BROADCAST_GROUPS
    now = written(_starts(vectors, few).withColumns({"det": F.lit(float("inf")), "edge": F.lit(None).cast("int")}), "quality-starts")
    done: list[DataFrame] = []
    for _ in range(MOST_STEPS):
        now, falls = _step(vectors, now, few)
        done.append(now.where(f"not ({MOVING})") if falls else now)
        now = now.where(MOVING)
        if not falls:
            break
    else:
        done.append(now)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    columns = [c for c in found.columns if c not in ("start", "n", "edge", "was")]
    best = written(found.groupBy("grp").agg(F.min(F.struct("det", "start", *[c for c in columns if c not in ("grp", "det")])).alias("b")).select("grp", "b.*"), "quality-raw")
    kept = vectors.join(_hinted(best, few), "grp").where(_distance() <= REWEIGHT_AT * RAW_FACTOR).select(*KEYS, *DIMS)
    return _moments(kept.withColumn("start", F.lit(0))).drop("start")


def _key(c: str) -> Column:
    """A value as a key that tells null from the empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Statistics and verdict of each document.

    base_failed: under 10 words, or over 20 % of the words in five-word windows that occur twice or more. The others get a
    vector of four statistics, shrunk towards their language's median for short texts; it is rejected if its squared
    Mahalanobis distance from the robust estimate of its language and source exceeds CUTOFF. Where fewer than LEAST_ROWS rows
    have that language and source, the estimate is that of all rows of the language, and where these are fewer too, that of
    all rows. Null languages and sources are groups of their own. Null and empty texts have no words and fail. Repeated rows
    each get their row; other columns are not returned. An empty table gives no rows.
    """
    stats = text_statistics(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _key(lang_col).alias("_lang"), _key(source_col).alias("_source")), "_text")
    failed = (F.col("_words") < 10) | (100 * F.col("_repeat_words") > 20 * F.col("_words"))
    percent = lambda a, b: F.log1p(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    plain = written(
        stats.select(
            "_id", "_lang", "_source", "_words", "_word_chars", "_symbols", "_dup_lines", "_repeat_words", failed.alias("_failed"),
            F.log((F.col("_word_chars") + 0.0) / F.greatest(F.col("_words"), F.lit(1)) + 1e-9).alias("r1"), percent("_symbols", "_word_chars").alias("r2"), percent("_dup_lines", "_lines").alias("r3"), percent("_repeat_words", "_words").alias("r4"),
        ),
        "quality-statistics",
    )
    good = plain.where(~F.col("_failed"))
    by_both = written(good.groupBy("_lang", "_source").agg(F.count("*").alias("_n_both")), "quality-groups")
    few = by_both.count() <= BROADCAST_GROUPS
    by_lang = by_both.groupBy("_lang").agg(F.sum("_n_both").alias("_n_lang"), (F.min("_n_both") < LEAST_ROWS).alias("_some"))
    medians = good.groupBy("_lang").agg(*[F.percentile_approx(f"r{i}", 0.5, 10000).alias(f"c{i}") for i in range(1, 5)])
    by_lang = written(by_lang.join(medians, "_lang"), "quality-languages")
    all_needed = not by_lang.where(F.col("_n_lang") < LEAST_ROWS).isEmpty()
    steady = F.sqrt(F.col("_words") / (F.col("_words") + STEADY_WORDS))
    none = F.lit(None).cast("string")
    name = lambda lang, source: F.to_json(F.struct(lang.alias("lang"), source.alias("source")))
    of_both, of_lang, of_all = name(F.col("_lang"), F.col("_source")), name(F.col("_lang"), none), name(none, none)
    enough, enough_lang = F.col("_n_both") >= LEAST_ROWS, F.col("_n_lang") >= LEAST_ROWS
    vectors = written(
        good.join(_hinted(by_both, few), ["_lang", "_source"]).join(_hinted(by_lang, few), "_lang").select(
            "_id", "_words", "_word_chars", "_symbols", "_dup_lines", "_repeat_words", F.when(enough, of_both).when(enough_lang, of_lang).otherwise(of_all).alias("grp"),
            # Every estimate that some row is judged by is made from all rows of its language and source, of its language, or of all.
            F.array_compact(F.array(F.when(enough, of_both), F.when(F.col("_some") & enough_lang, of_lang), of_all if all_needed else none)).alias("_in"),
            *[(steady * (F.col(f"r{i}") - F.col(f"c{i}"))).alias(f"x{i}") for i in range(1, 5)],
        ),
        "quality-vectors",
    )
    estimates = _hinted(written(covariance_estimates(vectors.select(F.explode("_in").alias("grp"), *DIMS)), "quality-estimates"), few)
    named = [F.col("_id").alias(id_col), F.col("_words").alias("n_words"), F.col("_word_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"), F.col("_dup_lines").alias("n_dup_lines"), F.col("_repeat_words").alias("n_repeat_words")]
    distance = _distance() / FINAL_FACTOR
    judged = vectors.join(estimates.drop("n"), "grp", "left").select(*named, F.lit(False).alias("base_failed"), F.coalesce(distance <= CUTOFF, F.lit(True)).alias("kept"), distance.alias("distance2"))
    return judged.unionByName(plain.where("_failed").select(*named, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2")))
