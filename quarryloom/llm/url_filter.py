"""URL filtering: host and path rules, and boosted trees over lexical features for what no rule decides.

The labelled URLs are those that a rule decides. All of them give the block rates of host suffixes (the
last one and the last two labels), smoothed towards the rate of all. A labelled URL's own rates leave out
its fold, one of FOLDS by hash of the URL, so that the trees learn what a rate is worth on URLs that did
not make it; the path that a rule names is in no rate. Gradient-boosted trees are
then fitted on a bounded sample of the labelled URLs (SAMPLE rows, those with the smallest hash of the
URL, so that reruns agree). Everything runs in the JVM.

Verdicts of undecided URLs: block if the trees' probability is over one half, else allow; allow too where
no labelled URL shares the suffix, as nothing was learnt about it.

Nulls and odd rows: a null URL or one without `://` has an empty host and path and no rule; repeated
rows are each judged; where no rule decides any row, or all labels agree, there is nothing to learn
and the verdict is that label, or allow if there is none; columns of any name may stand beside the URL.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm.common import ascii_lower, table, written

#: (host, path, verdict): a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Labelled URLs that the trees are fitted on; folds; how many URLs the rate of all weighs in a suffix's.
SAMPLE, FOLDS, PRIOR = 8192, 5, 4.0
#: Suffixes whose rates may be broadcast (about 150 bytes each); beyond it the joins shuffle.
BROADCAST_SUFFIXES = 100_000
TREES = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.2, "maxBins": 32, "seed": 7}


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n, chars = F.length(text), F.split(text, "")
    times = lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n
    return F.when(
        n > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - times(c) * F.log2(times(c)))
    ).otherwise(0.0)


def features(url: Column) -> dict[str, Column]:
    text, h, p = F.coalesce(url, F.lit("")), F.col("host"), F.col("path")
    count = lambda of, pattern: F.regexp_count(of, F.lit(pattern)).cast("double")
    n = F.greatest(F.length(text), F.lit(1))
    return {
        "length": F.length(text).cast("double"),
        "host_length": F.length(h).cast("double"),
        "host_labels": count(h, r"[^.]+"),
        "hyphens": count(h, "-"),
        "depth": count(p, "/"),
        "digit_ratio": count(text, "[0-9]") / n,
        "entropy": _entropy(h),
        "params": count(text, r"[?&][^=&#]+"),
        "fragment": F.contains(text, F.lit("#")).cast("double"),
        "https": F.startswith(text, F.lit("https:")).cast("double"),
    }


def _with_rates(known: DataFrame) -> DataFrame:
    """known (with _fold, and _block, null if no rule decides) with s1_rate, s2_rate and _seen (labelled URLs of the suffix)."""
    labelled = known.filter(F.col("_block").isNotNull())
    suffixes = {f"s{n}": F.substring_index("host", ".", -n) for n in (1, 2)}
    per_fold = [F.struct(F.count(F.when(F.col("_fold") == k, 1)).alias("n"), F.coalesce(F.sum(F.when(F.col("_fold") == k, F.col("_block"))), F.lit(0.0)).alias("blocked")) for k in range(FOLDS)]
    rates = written(
        labelled.select("_fold", "_block", F.explode(F.array(*[F.concat_ws(" ", F.lit(s), c) for s, c in suffixes.items()])).alias("suffix"))
        .groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("_block").alias("blocked"), F.array(*per_fold).alias("folds")),
        "suffix-rates",
    )
    small = F.broadcast if rates.count() <= BROADCAST_SUFFIXES else (lambda df: df)
    overall = labelled.agg(F.avg("_block")).first()[0] or 0.0
    out = known.withColumn("_seen", F.lit(0).cast("long"))
    for s, c in suffixes.items():
        mine = out.withColumn("_suffix", F.concat_ws(" ", F.lit(s), c)).join(small(rates.toDF("_suffix", "_n", "_blocked", "_folds")), "_suffix", "left")
        own = F.when(F.col("_block").isNotNull(), F.get("_folds", F.col("_fold")))
        n = F.coalesce("_n", F.lit(0)) - F.coalesce(own["n"], F.lit(0))
        blocked = F.coalesce("_blocked", F.lit(0.0)) - F.coalesce(own["blocked"], F.lit(0.0))
        out = mine.withColumn(f"{s}_rate", (blocked + PRIOR * overall) / (n + PRIOR)).withColumn("_seen", F.col("_seen") + n).drop("_suffix", "_n", "_blocked", "_folds")
    return out


def judge(pages: DataFrame, url: str = "url", rules=RULES, keep: tuple[str, ...] = ("page_id",), hold_out: bool = False) -> DataFrame:
    """keep, host, path, rule, verdict, score (the trees' probability of block; null without a model). With
    hold_out the labelled URLs of fold 0 teach nothing, so that their score can be held against their label."""
    cut = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(url).alias("_url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    feats = features(F.col("_url"))
    told = cut.withColumn("_d", decide(F.col("host"), F.col("path"), rules)).withColumn("_fold", fold(F.col("_url")))
    label = F.when(F.col("_d").isNotNull() & (F.lit(not hold_out) | (F.col("_fold") > 0)), (F.col("_d.verdict") == "block").cast("double"))
    full = _with_rates(told.withColumn("_block", label)).withColumns(feats)
    names = [*feats, "s1_rate", "s2_rate"]
    sample = written(
        full.filter(F.col("_block").isNotNull()).select(*names, "_block", F.xxhash64("_url").alias("_h")).orderBy("_h", *names).limit(SAMPLE),
        "url-sample",
    )
    classes = [r[0] for r in sample.select("_block").distinct().collect()]
    out = [*[F.col(f"`{c}`") for c in keep], "host", "path", F.col("_d.rule").alias("rule")]
    if len(classes) < 2:
        only = "block" if classes == [1.0] else "allow"
        return full.select(*out, F.coalesce("_d.verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    vectors = VectorAssembler(inputCols=names, outputCol="_features")
    model = GBTClassifier(featuresCol="_features", labelCol="_block", predictionCol="_p", **TREES).setRawPredictionCol("_raw").setProbabilityCol("_prob").fit(
        vectors.transform(sample.coalesce(1))
    )
    scored = model.transform(vectors.transform(full)).withColumn("score", vector_to_array("_prob")[1])
    verdict = F.coalesce("_d.verdict", F.when((F.col("score") > 0.5) & (F.col("_seen") > 0), "block").otherwise("allow"))
    return scored.select(*out, verdict.alias("verdict"), "score")


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS)).cast("int")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
