"""URL filter: rules by host and path, and boosted trees over lexical features for urls that no rule covers.

A rule fits its host and the host's subdomains where the url's path starts with the rule's; the longest fitting rule
decides. Its verdicts are also the labels of the trees (Spark's own `GBTClassifier`), unless labelled urls are given.
Features: lengths, depth, digit ratio, entropy, parameters, labels and hyphens of the host, and statistics of the host's
suffix (its last two labels) and of the path's first segment there: pages, hosts, and the labelled share that is blocked,
drawn towards the share of all. Rows that the trees learn from take that share from the other half of the labelled rows.

Bounds. Rules meet distinct hosts, not pages, by suffixes of no more labels than the longest rule has. Statistics are
sums, made map-side first, over all rows. What joins pages (each host's rules, each suffix's statistics) is written,
measured, and broadcast up to BROADCAST_BYTES; beyond it is joined by key, where Spark splits a frequent key's pages. The
trees learn from at most `max_rows` labelled rows of each verdict, those of the least hash: a bounded sample.
No Python runs on executors.

Defined results. Null url, or one without `://`: empty host and path, no rule; the trees judge it as they judge any. Only
A-Z is lowered in hosts. A url without a path starts with no rule's path, not even `/`. Rules of one length: the longer
host, then the smaller text. Labels of one verdict only: every other url gets that verdict; no labels: allow. Repeated
rows are judged each. An empty table gives no rows. Other columns are kept, whatever their names; new ones get
underscores before theirs if there are such already.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .spelling import LOWER, UPPER

BROADCAST_BYTES = 16_000_000
#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: So many rows of the overall share are added to each labelled share.
PRIOR_ROWS = 10


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _last_labels(host: Column, n: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -n)


def _small(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast, if its rows come to so few bytes; a written table, so that measuring costs no second computation."""
    n = df.agg(F.sum(size).alias("n")).first().n or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, fitting: the rules (longest first) of every host that has any. hosts: host, distinct."""
    most = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first().n or 0
    depth = F.least(F.size(F.split("host", r"\.")), F.lit(most))
    suffixes = hosts.where(depth > 0).select("host", F.explode(F.sequence(F.lit(1), depth)).alias("n")).select("host", _last_labels(F.col("host"), F.col("n")).alias("suffix"))
    known = rules.groupBy(F.col("host").alias("suffix"), "path").agg(F.min("verdict").alias("verdict")).withColumnRenamed("suffix", "rule_host")
    text = F.concat("rule_host", "path")
    known = known.select(F.col("rule_host").alias("suffix"), F.struct((-F.length(text)).alias("order"), (-F.length("rule_host")).alias("then"), text.alias("rule"), "path", "verdict").alias("r"))
    return suffixes.join(known, "suffix").groupBy("host").agg(F.sort_array(F.collect_list("r")).alias("fitting"))


def _bound(value: Column, then) -> Column:
    """`then` of a value that is computed once: inside a lambda an expression is computed anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _entropy(text: Column) -> Column:
    """Bits a character: runs of the sorted characters are their counts."""

    def bits(counts: Column, n: Column) -> Column:
        return F.log2(n.cast("double")) - F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * F.log2(c)) / n

    def of(chars: Column) -> Column:
        n = F.size(chars)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(chars, i - 1) != F.get(chars, i - 2)))
        counts = _bound(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, F.lit(2), n), F.array(n + 1)), lambda a, b: (b - a).cast("double")))
        return bits(counts, n)

    return F.when(F.length(text) > 0, _bound(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), of)).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers by the url's text alone."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    length = F.length(url)
    return {
        "length": length.cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"), "depth": count(path, "[^/]+"),
        "digit_ratio": F.when(length > 0, count(url, "[0-9]") / length).otherwise(0.0), "entropy": _entropy(url), "host_entropy": _entropy(host),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "[&;]") + 1), "labels": F.when(host == "", 0.0).otherwise(count(host, r"\.") + 1), "hyphens": count(host, "-"),
        "fragment": F.contains(url, F.lit("#")).cast("double"), "secure": F.startswith(url, F.lit("https://")).cast("double"), "extension": F.rlike(path, F.lit(r"\.[A-Za-z0-9]{1,5}$")).cast("double"),
    }


LEARNED = ("suffix_pages", "suffix_hosts", "suffix_blocked", "segment_pages", "segment_blocked")


def _statistics(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of each key over all rows: pages, and blocked and labelled ones of both halves."""
    half = lambda h, what: F.sum(F.when((F.col("half") == h) & F.col("label").isNotNull(), what))
    sums = [F.coalesce(half(h, F.col("label") if what == "blocked" else F.lit(1.0)), F.lit(0.0)).alias(f"{what}{h}") for h in (0, 1) for what in ("blocked", "labelled")]
    return parsed.groupBy(*keys).agg(F.count("*").alias("pages"), *sums)


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", labelled: Column | None = None, max_rows: int = 5000, rounds: int = 20, depth: int = 4, threshold: float = 0.5, seed: int = 7) -> DataFrame:
    """`pages` with host, path, rule (`<host><path>`, or null), block_score (of the trees; null where a rule decides) and verdict.

    labelled: a column of `pages` that says allow or block, or null for rows to learn nothing from; rows' rules by default.
    """
    names = {c: common.fresh(pages, c) for c in ("host", "path", "rule", "block_score", "verdict")}
    spark = pages.sparkSession
    u = F.col(f"`{url}`")
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    parsed = pages.select(row, u.alias("url"), host(u).alias("host"), path(u).alias("path"), (F.lit(None).cast("string") if labelled is None else labelled).alias("given"))
    fitting = common.written(host_rules(parsed.select("host").distinct(), rules), "host_rules")
    each = F.aggregate("fitting", F.lit(16), lambda s, r: s + 40 + F.length(r.rule) + F.length(r.path))
    ruled = parsed.join(_small(fitting, each + F.octet_length("host")), "host", "left")
    first = F.get(F.filter("fitting", lambda r: F.startswith(F.col("path"), r.path)), F.lit(0))
    segment = F.regexp_extract("path", r"^/([^/]*)", 1)
    ruled = ruled.select("row", "url", "host", "path", "given", first.alias("hit"), _last_labels(F.col("host"), F.lit(2)).alias("suffix"), F.substring(segment, 1, 32).alias("segment"), F.coalesce(F.crc32(F.col("url").cast("binary")) % 2, F.lit(0)).alias("half"))
    said = F.col("given") if labelled is not None else F.col("hit.verdict")
    known = ruled.withColumn("label", F.when(said == "block", 1.0).when(said == "allow", 0.0))

    hosts = known.groupBy("suffix", "host").agg(F.lit(1).alias("one")).groupBy("suffix").agg(F.count("*").alias("hosts"))
    by_segment = common.written(_statistics(known.select("suffix", "segment", "half", "label"), ["suffix", "segment"]), "segments")
    totals = [F.sum(c).alias(c) for c in ("pages", "blocked0", "labelled0", "blocked1", "labelled1")]
    by_suffix = common.written(by_segment.groupBy("suffix").agg(*totals).join(hosts, "suffix", "left"), "suffixes")
    every = by_suffix.agg(*totals).first()
    counts = [(every["blocked0"] or 0.0), (every["labelled0"] or 0.0), (every["blocked1"] or 0.0), (every["labelled1"] or 0.0)]
    blocked, of = counts[0] + counts[2], counts[1] + counts[3]

    def shares(prefix: str, halves: Column) -> Column:
        """The labelled share that is blocked, in the halves that `halves` lets through."""
        part = lambda what: reduce(Column.__add__, [F.when((halves == h) | (halves == 2), F.coalesce(F.col(f"{prefix}_{what}{h}"), F.lit(0.0))).otherwise(0.0) for h in (0, 1)])
        return (part("blocked") + PRIOR_ROWS * (blocked / of)) / (part("labelled") + PRIOR_ROWS)

    renamed = lambda df, prefix, *keys: df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys])

    def featured(df: DataFrame, halves: Column) -> DataFrame:
        df = df.join(_small(renamed(by_suffix, "suffix", "suffix"), F.octet_length("suffix") + 64), "suffix", "left")
        df = df.join(_small(renamed(by_segment, "segment", "suffix", "segment"), F.octet_length("suffix") + F.octet_length("segment") + 64), ["suffix", "segment"], "left")
        learned = (F.log1p("suffix_pages"), F.log1p("suffix_hosts"), shares("suffix", halves), F.log1p("segment_pages"), shares("segment", halves))
        columns = lexical(F.col("url"), F.col("host"), F.col("path")) | {n: F.coalesce(c, F.lit(0.0)) for n, c in zip(LEARNED, learned, strict=True)}
        return df.select("*", *[c.alias(f"f_{n}") for n, c in columns.items()])

    if blocked and blocked < of:
        order = [F.xxhash64("url"), "url"]
        columns = ["url", "host", "path", "suffix", "segment", "half", "label"]
        sample = reduce(DataFrame.unionByName, [known.where(F.col("label") == x).select(*columns).orderBy(*order).limit(max_rows) for x in (0.0, 1.0)])
        assembler = VectorAssembler(inputCols=[f"f_{n}" for n in (*lexical(F.col("url"), F.col("host"), F.col("path")), *LEARNED)], outputCol="features")
        rows = common.written(assembler.transform(featured(common.written(sample, "labelled"), 1 - F.col("half"))).select("features", "label"), "features")
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=64, seed=seed).fit(rows)
        judged = model.transform(assembler.transform(featured(known, F.lit(2))))
        score = vector_to_array("probability")[1]
    else:
        judged, score = known, F.lit(float(bool(blocked)))
    score = F.when(F.col("hit").isNull(), score)
    verdict = F.coalesce("hit.verdict", F.when(score >= threshold, "block").otherwise("allow"))
    made = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("hit.rule"), "block_score": score, "verdict": verdict}
    return judged.select(*[F.col("row").getField(c).alias(c) for c in pages.columns], *[c.alias(names[n]) for n, c in made.items()])
