"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the URLs that no rule covers.

The trees are trained from the URLs that the rules do label.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Verdict and rule; a rule is a host, then the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
FEATURES = ["url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "dash_count", "entropy", "parameters", "fragment", "extension", "secure", "suffix_rate", "suffix_weight", "segment_rate", "segment_weight"]
#: Labelled rows that the trees see at most (picked by a hash), trees, depth, and the rows that a suffix's prior counts as.
TRAIN_ROWS, TREES, DEPTH, PRIOR = 200_000, 16, 4, 20.0
#: Parts of the labelled rows: none of them is given suffix statistics that its own labels are in.
FOLDS = 5


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def lexical(df: DataFrame) -> DataFrame:
    """df (_url, host, path) with the lexical features and the keys of the suffix statistics."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    n = F.length(url)
    count = lambda c, what: (F.length(c) - F.length(F.translate(c, what, ""))).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return df.withColumns(
        {
            "url_length": n.cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
            "host_labels": count(F.col("host"), ".") + 1, "depth": count(F.col("path"), "/"), "digit_ratio": count(url, "0123456789") / F.greatest(n, F.lit(1)), "dash_count": count(F.col("host"), "-"),
            "entropy": entropy, "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "fragment": F.contains(url, F.lit("#")).cast("double"),
            "extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"), "secure": url.startswith("https:").cast("double"),
            "_suffix": F.substring_index("host", ".", -1), "_segment": F.regexp_extract("path", r"(?s)^/([^/]*)/", 1),
        }
    )


def _with_rates(df: DataFrame, key: str, name: str) -> DataFrame:
    """Share of blocked among the labelled rows of a key, drawn to an even share, and how many rows that rests on.

    A labelled row is given the rates of the other folds, so its own label isn't in them, and in fold 0 it is given none, as if
    its key had never been seen, so that the trees learn to judge such URLs too. The small tables are joined as Spark sees fit by
    their size; a hot key is summed before it is shuffled.
    """
    labelled = F.col("_label").isNotNull()
    by_fold = df.where(labelled).groupBy(F.col(key), F.col("_fold").alias("_of")).agg(F.sum("_label").alias("_fs"), F.count("*").alias("_fc"))
    rates = by_fold.groupBy(key).agg(F.sum("_fs").alias("_s"), F.sum("_fc").alias("_c"))
    seen = F.when(labelled & (F.col("_fold") == 0), 0.0).otherwise(1.0)
    own = lambda c: F.when(labelled, F.coalesce(c, F.lit(0))).otherwise(F.lit(0))
    blocked, count = (seen * (F.coalesce(F.col(all_), F.lit(0)) - own(F.col(fold))) for all_, fold in (("_s", "_fs"), ("_c", "_fc")))
    return (
        df.join(rates, key, "left")
        .join(by_fold.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & (F.col("_fold") == F.col("_of")), "left")
        .withColumn(f"{name}_rate", (blocked + PRIOR * 0.5) / (count + PRIOR))
        .withColumn(f"{name}_weight", F.log1p(count.cast("double")))
        .drop("_s", "_c", "_key", "_of", "_fs", "_fc")
    )


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id_col, host, path, rule, verdict (allow or block) and block_score (null where a rule decides) of every row.

    Null URLs and such without :// have empty host and path, fit no rule and are judged by the trees on the features of an
    empty or host-less URL. If the rules label no row, everything else is allowed; if they label rows of one verdict only,
    everything else gets that one. Suffix statistics cover all labelled rows; the trees are fitted to at most about
    train_rows of them, and at least one of each verdict, picked by a hash of id and URL. Repeated rows each get their row; other
    columns are not returned; an empty table gives no rows.
    """
    host, path = parts(F.col("_url"))
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumn("host", host).withColumn("path", path)
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", name).withColumn("_verdict", verdict).withColumn("_label", F.when(F.col("_verdict") == "block", 1.0).when(F.col("_verdict") == "allow", 0.0))
    base = base.withColumn("_fold", F.pmod(F.xxhash64("_id", "_url"), F.lit(FOLDS)))
    rows = written(_with_rates(_with_rates(lexical(base), "_suffix", "suffix"), "_segment", "segment").select("_id", "_url", "host", "path", "rule", "_verdict", "_label", *FEATURES), "url-features")
    labelled = rows.where(F.col("_label").isNotNull())
    place = F.pmod(F.xxhash64("_id", "_url"), F.lit(1 << 62))
    found = labelled.groupBy("_label").agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()
    seen = {r["_label"]: r["n"] for r in found}
    out = [F.col("_id").alias(id_col), "host", "path", "rule"]
    if len(seen) < 2:
        only = "block" if 1.0 in seen else "allow"
        return rows.select(*out, F.coalesce("_verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    share = min(1.0, train_rows / sum(seen.values()))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
    # Each verdict has its first row in the sample, however small its share is.
    firsts = [(F.col("_label") == r["_label"]) & (place == r["first"]) for r in found]
    sample = labelled.where((place < F.lit(int(share * (1 << 62)))) | firsts[0] | firsts[1])
    model = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, seed=1).fit(assembler.transform(sample))
    scored = model.transform(assembler.transform(rows)).withColumn("_p", vector_to_array("probability")[1])
    return scored.select(*out, F.coalesce("_verdict", F.when(F.col("_p") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.when(F.col("_verdict").isNull(), F.col("_p")).alias("block_score"))
