"""URL filters by association rules, with DataFrame functions alone.

A url's tokens are its host's labels, its path's segments and its query's keys. FP-growth mines the token combinations of
the labelled urls that are bad; how many labelled urls hold a combination at all gives its confidence. Rules that
conclude "block" are pruned by

* support: at least `least` bad urls, and at least `share` of all bad ones, which bounds what FP-growth hands on;
* confidence: at least `confidence` of the urls that hold the combination are bad;
* chance: the lower end of the score interval (`z` standard errors) of that share lies above the share of bad urls among
  all labelled ones, so that a combination seen three times needs more than one seen a thousand times.

Tokens that the very same labelled urls hold are merged into one item before mining: it stands for each of them, so a url
holds the item if it has any of its tokens. A url of thirty tokens of its own is one item, not 2^30 rules. Of the rules that pass,
those that a rule over fewer items with at least their confidence makes idle are dropped; verdicts and best confidences stay.

Rules have any number of items. They match through an inverted index from a rule's rarest item to the rule: a url looks
up its items and is held against the other items of the rules it meets. Given host and path rules go first: the longest
that fits decides.

Cases: a null url, or one without "://", has an empty host and path and no tokens, so no rule fits it and it is allowed;
a very long url is read whole; of given rules of one length the first in order of (rule, verdict) from the end decides; of
mined rules that fire the best confidence is reported, ties are equal; repeated rows are judged each and repeated labelled
urls count each; without labels, or without bad ones, no rules are mined; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, drop_materialized, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the rule index up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


def host(url: str = "url") -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: str = "url") -> Column:
    """After the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a url, each marked by where it stands."""
    labels = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path(url), "/"), lambda x: F.concat(F.lit("p:"), F.translate(x, UPPER, LOWER)))
    query = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(labels, segments, keys), lambda x: F.length(x) > 2)))


def given_rule(rules: list[tuple[str, str, str]], h: Column, p: Column) -> Column:
    """The longest of (verdict, host, path) rules that fits, as struct(length, rule, verdict), or null."""
    fits = [
        F.when(((h == rh) | h.endswith("." + rh)) & p.startswith(rp), F.struct(F.lit(len(rh + rp)).alias("n"), F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, rh, rp in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits).cast("array<struct<n:int,rule:string,verdict:string>>")))


def lower_bound(hits: Column, n: Column, z: float) -> Column:
    """The lower end of the score interval of a share of hits among n."""
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def keyed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """The inverted index: each rule under its token that fewest urls hold. `counts` has (token, n)."""
    flat = rules.select("rule_id", F.explode("antecedent").alias("token")).join(counts, "token")
    rarest = flat.groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return rules.join(rarest, "rule_id")


def matches(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of (url, tokens, ...) with each rule of the index whose tokens the url has."""
    small = index.count() <= BROADCAST_ROWS
    looked = urls.withColumn("token", F.explode("tokens"))
    return looked.join(F.broadcast(index) if small else index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0).drop("token")


def merged(known: DataFrame) -> DataFrame:
    """(token, item): tokens of rows (tokens, n) by the least of those that the same rows hold, told apart by two hashes."""
    held = known.withColumn("row", F.array_join("tokens", " ")).select(F.explode("tokens").alias("token"), F.xxhash64("row").alias("h1"), F.xxhash64(F.lit(7), "row").alias("h2"))
    marks = held.groupBy("token").agg(F.count("*").alias("rows"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    named = marks.groupBy("rows", "h1", "h2").agg(F.min("token").alias("item"))
    return marks.join(named, ["rows", "h1", "h2"]).select("token", "item")


def as_items(rows: DataFrame, items: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, tokens) with distinct items for their tokens, by the keys; tokens without an item go."""
    flat = rows.select(*keys, F.explode("tokens").alias("token")).join(items, "token")
    return flat.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("tokens"))  # a url's at most


def active(rules: DataFrame) -> DataFrame:
    """Rules that no rule over fewer items with at least their confidence makes idle, found through the rarest item of the others."""
    own = rules.select(F.col("rule_id").alias("idle"), F.col("antecedent").alias("tokens"), F.col("confidence").alias("low"))
    met = matches(own, rules.select("token", "antecedent", "confidence"))
    return rules.join(met.where((F.size("antecedent") < F.size("tokens")) & (F.col("confidence") >= F.col("low"))).select(F.col("idle").alias("rule_id")).distinct(), "rule_id", "left_anti")


RULES = "rule_id string, antecedent array<string>, token string, bad long, n long, confidence double"


def mine(labelled: DataFrame, least: int = 3, share: float = 0.0005, confidence: float = 0.5, z: float = 1.96) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, antecedent, token, bad, n, confidence) that conclude "block", from rows (url, bad), over items; and
    (token, item). `token` is the item to look a rule up by."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    known = labelled.where("bad is not null and url is not null").select("bad", tokens().alias("tokens")).where("size(tokens) > 0")
    known = materialize(known.groupBy("tokens").agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad")), "labelled-urls")
    total, bad = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not bad:
        return spark.createDataFrame([], RULES), spark.createDataFrame([], "token string, item string")
    items = materialize(merged(known), "merged-tokens")
    known = known.withColumn("row", F.struct(F.xxhash64("tokens"), F.xxhash64(F.lit(7), "tokens"), "n", "bad"))
    rows = materialize(as_items(known, items, "row").select("tokens", "row.n", "row.bad"), "labelled-items")
    support = max(least, math.ceil(share * bad))
    baskets = rows.where("bad > 0").select(F.explode(F.array_repeat("tokens", F.col("bad").cast("int"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (support - 0.5) / bad)).fit(baskets).freqItemsets
    sets = materialize(sets.where(F.col("freq") >= support).select(F.array_sort("items").alias("antecedent"),
        F.col("freq").alias("bad")).withColumn("rule_id", F.array_join("antecedent", " ")), "item-sets")
    counts = rows.select("n", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("n"))
    index = materialize(keyed(sets, counts), "item-index")
    held = matches(rows.select("tokens", F.col("n").alias("times")),
        index.select("token", "rule_id", "antecedent")).groupBy("rule_id").agg(F.sum("times").alias("n"))
    rules = index.join(held, "rule_id").withColumn("confidence", F.col("bad") / F.col("n"))
    fit = (F.col("confidence") >= confidence) & (F.round(lower_bound(F.col("bad"), F.col("n"), z), 12) > F.round(F.lit(bad / total), 12))
    passed = materialize(rules.where(fit).select("rule_id", "antecedent", "token", "bad", "n", "confidence"), "passed-rules")
    done = materialize(active(passed), "rules")
    drop_materialized(spark, rows, sets, index, passed)
    return done, items


def fired(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(url, confidence) of the distinct urls for which a mined rule fires; confidence is the best rule's."""
    own = as_items(urls.where("url is not null").distinct().select("url", tokens().alias("tokens")), items, "url")
    return matches(own, rules.select("token", "antecedent", "confidence")).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], **options) -> DataFrame:
    """page_id, host, path, rule, verdict and the firing rules' best confidence for every page."""
    configure(pages.sparkSession)
    rows = pages.select("page_id", "url", host().alias("host"), path().alias("path")).withColumn("fit", given_rule(rules, F.col("host"), F.col("path")))
    hits = materialize(fired(rows.where("fit is null").select("url"), *mine(labelled, **options)), "fired")
    verdict = F.coalesce("fit.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return rows.join(hits, "url", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
        verdict.alias("verdict"), F.when(F.col("fit").isNull(), F.col("confidence")).alias("confidence"))
