"""URL verdicts by rules and, where none fits, by gradient-boosted trees on lexical features.

A rule is a host and the start of a path, such as ``example.org/en/``; it fits its host and all subdomains,
and the longest that fits decides.  URLs that rules decide are the labelled ones: trees are trained on a sample
of them, of ``TRAIN_ROWS`` rows at most, picked by hash, and judge all other URLs.  Features are lengths, depth,
digit and sign ratios, entropy, parameter counts, and how many of the sample's URLs under the same host suffix
were to be blocked.  The sample falls into ``FOLDS`` parts by a hash of the host.  One part is held out; a training row's suffix statistics come from the other
training parts only, so they don't hold its own label or host.  The score from which a URL is blocked is the one that decides most held-out URLs
rightly (of equals the one nearest to a half), and ``held_out`` says how well it and the scores do there.

Everything is DataFrame functions and Spark's own tree ensemble.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and features of an
empty text; without labelled URLs, or with labels all alike, that verdict (allow, if none) holds for the rest, and so does the training
parts' commonest where they are all alike; where the held-out part hasn't both labels, the score is a half; equal scores have equal verdicts; repeated
rows are judged each; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import written

TRAIN_ROWS = 20_000
FOLDS = 5
MOST_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = [
    "length", "host_length", "path_length", "labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens", "sign_ratio", "entropy", "host_entropy",
    "params", "query_length", "has_fragment", "longest_label", "suffix_blocked", "suffix_count", "top_blocked", "top_count",
]


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s).*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none; ``rules`` are (verdict, host and path)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, start = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    share = F.transform(chars, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """The features that a URL alone has, and its host's suffixes; from columns url, host, path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    count = lambda text, pattern: F.length(F.regexp_replace(text, f"[^{pattern}]", ""))
    ratio = lambda text, pattern: F.when(F.length(text) > 0, count(text, pattern) / F.length(text)).otherwise(0.0)
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    labels = F.split(host, "\\.")
    values = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "labels": F.size(labels), "depth": count(path, "/"),
        "digit_ratio": ratio(url, "0-9"), "host_digit_ratio": ratio(host, "0-9"), "hyphens": count(host, "-"), "sign_ratio": ratio(url, "%&=_~+-"),
        "entropy": _entropy(url), "host_entropy": _entropy(host), "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.length(query),
        "has_fragment": url.contains("#").cast("int"), "longest_label": F.array_max(F.transform(labels, F.length)),
    }
    return urls.withColumns({k: v.cast("double") for k, v in values.items()} | {"suffix": F.substring_index(host, ".", -2), "top": F.substring_index(host, ".", -1)})


def _suffix_tables(sample: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Smoothed share of blocked URLs, and their number, by a suffix: of the whole sample, and for each part of the other parts; no more rows than the sample has."""
    sums = sample.groupBy(column, "fold").agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
    whole = sums.groupBy(column).agg(F.sum("b").alias("b_all"), F.sum("n").alias("n_all"))
    named = lambda b, n: (((b + 1) / (n + 2)).alias(f"{column}_blocked"), F.log1p(n).alias(f"{column}_count"))
    others = sums.join(whole, column).select(column, "fold", *named(F.col("b_all") - F.col("b"), F.col("n_all") - F.col("n")))
    return whole.select(column, *named(F.col("b_all"), F.col("n_all"))), others


class Judge:
    """Trees with their suffix statistics and the score from which a URL is blocked; ``held_out``: urls, blocked, accuracy, auc of the part held out, or None."""

    def __init__(self, sample: DataFrame):
        train, held = written(sample.where("fold > 0"), "url-train"), sample.where("fold = 0")
        self.tables = [(c, *_suffix_tables(train, c)) for c in ("suffix", "top")]
        self.only, self.threshold, self.held_out, self.model = None, 0.5, None, None
        kinds = [r["label"] for r in train.groupBy("label").count().orderBy(F.desc("count"), "label").collect()]
        if len(kinds) < 2:
            self.only = kinds[0] if kinds else None
            return
        trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=12, maxDepth=3, stepSize=0.3, seed=1)
        self.model = trees.fit(self._featured(train, True).select("label", "features"))
        scored = written(self.scored(held).select("label", "score"), "url-held-out")
        at = [k / 50 for k in range(1, 50)]
        right = scored.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked"), *[F.count_if((F.col("score") > t) == (F.col("label") == 1)).alias(f"at {t}") for t in at]).first()
        if right["n"] and 0 < right["blocked"] < right["n"]:
            self.threshold = min(at, key=lambda t: (-right[f"at {t}"], abs(t - 0.5), t))
            auc = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(scored)
            self.held_out = {"urls": right["n"], "blocked": int(right["blocked"]), "accuracy": right[f"at {self.threshold}"] / right["n"], "auc": auc}

    def _featured(self, frame: DataFrame, own: bool = False) -> DataFrame:
        for column, whole, others in self.tables:
            frame = frame.join(F.broadcast(others), [column, "fold"], "left") if own else frame.join(F.broadcast(whole), column, "left")
        frame = frame.fillna({"suffix_blocked": 0.5, "suffix_count": 0.0, "top_blocked": 0.5, "top_count": 0.0})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(frame)

    def scored(self, frame: DataFrame) -> DataFrame:
        """The rows of ``lexical`` with ``score``, the trees' chance that a URL is to be blocked."""
        if self.model is None:
            return frame.withColumn("score", F.lit(float(self.only or 0)))
        return self.model.transform(self._featured(frame)).withColumn("score", vector_to_array("probability")[1])


def decided(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, decision: what the rules alone say."""
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, decision = rule_of(F.col("host"), F.col("path"), rules)
    return urls.withColumns({"rule": rule, "decision": decision})


def trained(urls: DataFrame, limit: int = TRAIN_ROWS) -> Judge | None:
    """A judge from the URLs that rules decide, or None where they are all alike or there are none."""
    labelled = urls.where("decision is not null")
    counts = {r["decision"]: r["count"] for r in labelled.groupBy("decision").count().collect()}
    if len(counts) < 2:
        return None
    # a share of the labelled URLs by hash, as likely to exceed the bound as not to reach it, hence the limit
    grain = 1 << 30
    share = min(grain, int(grain * limit / sum(counts.values())))
    sample = labelled.where(F.pmod(F.xxhash64("url", "page_id"), F.lit(grain)) < share).limit(limit)
    folded = lexical(sample).withColumns({"label": (F.col("decision") == "block").cast("double"), "fold": F.pmod(F.xxhash64("host", F.lit("fold")), F.lit(FOLDS))})
    return Judge(written(folded, "url-sample"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], limit: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' chance that a URL is to be blocked)."""
    urls = decided(pages, rules)
    found = trained(urls, limit)
    if found is None:
        only = next((r["decision"] for r in urls.where("decision is not null").select("decision").limit(1).collect()), "allow")
        return urls.select("page_id", "host", "path", "rule", F.coalesce("decision", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("score"))
    scored = found.scored(lexical(urls))
    verdict = F.coalesce("decision", F.when(F.col("score") > found.threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
