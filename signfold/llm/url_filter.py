r"""URL filters by association rules.

A list of rules (host, path, verdict) judges the URLs it fits: a rule fits its host and all subdomains where the
URL's path starts with the rule's, and of several that fit the longest wins. What the list says of the URLs that it
decides is a label; Spark's FP-growth mines the combinations of URL tokens that go with a label, and rules of
enough support and confidence judge the URLs that no listed rule fits. Any other labelled URLs can be given instead.

* Tokens of a URL: labels of its host (`h:`), segments of its path (`p:`), names of its query's parameters (`q:`),
  each once, all of them.
* Items: tokens that less than `support` of the labelled URLs have are in no rule and are left out first. Tokens that
  occur in exactly the same labelled URLs (equal counts and equal sums of two row hashes) are one item, so that
  copies of a long URL add one item and not all subsets of its tokens; a rule then asks for all tokens of the item.
* Rules: sets of items X with a label v, where count(X, v) >= support * labelled URLs and count(X, v) >= confidence *
  count(X). X must be closed: no further item may be in all of those count(X, v) URLs, since the labels then say
  nothing of URLs without it (if all labelled URLs of `h:com` have `p:de`, a rule asks for both). The best rule that
  a URL fulfils judges it: by confidence, then count(X, v), then fewer tokens, then the smaller tokens and verdict.
  A URL that fulfils none is allowed.
* Matching: an inverted index has each rule under its rarest token. A URL's tokens are looked up in it, and only the
  rules found are compared with the URL. A hot token is the rarest of a rule only if all of the rule's are as hot.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: what follows up to `?`, `#`
or the end. Only DataFrame functions and Spark's FPGrowth are used. The rule table is broadcast if its rows, counted
first, are at most BROADCAST_RULES, and else joined by shuffle.

Defined results: null URLs and those without `://` have empty host and path, no tokens, and are allowed; rows with
null or repeated ids are judged each for itself; without labelled URLs nothing is mined; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ident, restored, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
VERDICTS = ("allow", "block")
#: Shares of the labelled URLs, and of those with the rule's tokens.
SUPPORT = 0.01
CONFIDENCE = 0.9
BROADCAST_RULES = 100_000


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    inside = F.concat(F.lit("."), host)
    fits = [(h, p, v, F.endswith(inside, F.lit("." + h)) & F.startswith(path, F.lit(p))) for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
    text = F.coalesce(*[F.when(fit, F.lit(h + p)) for h, p, _, fit in fits], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(fit, F.lit(v)) for _, _, v, fit in fits], F.lit(None).cast("string"))
    return text, verdict


def tokens(rest: Column) -> Column:
    """All tokens of a URL, each once."""

    def named(parts: Column, kind: str) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(named(F.split(host_of(rest), r"\."), "h:"), named(F.split(path_of(rest), "/"), "p:"), named(names, "q:")))


def frequent_items(held: DataFrame, least: float) -> DataFrame:
    """(token, n, item) of tokens in `least` rows or more; item: the smallest token of those in exactly the same rows. At most (tokens of a row on average) / support of them.

    Hashes are summed in 32-bit halves, which no number of rows overflows.
    """
    halves = [F.shiftrightunsigned(F.xxhash64(F.lit(k), "row"), 32) for k in (1, 2)]
    cover = [F.count("*").alias("n"), F.sum(halves[0]).alias("s1"), F.sum(halves[1]).alias("s2")]
    counts = held.groupBy("token").agg(*cover).filter(F.col("n") >= least)
    items = counts.groupBy("n", "s1", "s2").agg(F.min("token").alias("item"))
    return counts.join(items, ["n", "s1", "s2"]).select("token", "n", "item")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, n_tokens, verdict, hits, confidence, anchor) from (row, tokens, verdict)."""
    spark = labelled.sparkSession
    schema = "tokens array<string>, n_tokens int, verdict string, hits bigint, confidence double, anchor string"
    rows = labelled.count()
    if not rows:
        return spark.createDataFrame([], schema)
    held = labelled.select("row", F.explode("tokens").alias("token"))
    frequent = written(frequent_items(held, support * rows), "items")
    # Items of a row, with its label as one more. Rows without a frequent token still count in the support.
    few = frequent.filter("token = item").select("token")
    kept = held.join(F.broadcast(few) if few.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else few, "token").groupBy("row").agg(F.collect_set("token").alias("items"))
    baskets = labelled.join(kept, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    baskets = written(baskets, "baskets")
    # A little below the bound, since FP-growth multiplies and rounds up; the exact bound is taken on its counts.
    sets = FPGrowth(itemsCol="items", minSupport=max(support * (1 - 1e-9) - 1e-12, 0.0), minConfidence=0.0).fit(baskets).freqItemsets
    sets = written(sets.select(F.array_sort(F.filter("items", lambda x: ~F.startswith(x, F.lit("=")))).alias("body"), F.array_join(F.filter("items", lambda x: F.startswith(x, F.lit("="))), "").alias("head"), "freq"), "itemsets")
    # A row has one label, so a set has one head at most.
    whole = sets.filter("head = ''").select("body", F.col("freq").alias("n"))
    strong = sets.filter((F.col("head") != "") & (F.size("body") > 0) & (F.col("freq") >= support * rows)).join(whole, "body").filter(F.col("freq") >= confidence * F.col("n"))
    # A set with one item less, met with the largest count of those that have one more: equal counts, not closed.
    wider = sets.filter("head != ''").select("head", "freq", F.explode("body").alias("item"), F.col("body").alias("more")).groupBy(F.array_remove("more", F.col("item")).alias("body"), "head").agg(F.max("freq").alias("most"))
    strong = strong.join(wider, ["body", "head"], "left").filter("most IS NULL OR most < freq")
    strong = strong.select("body", F.substring("head", 2, 1 << 30).alias("verdict"), F.col("freq").alias("hits"), (F.col("freq") / F.col("n")).alias("confidence"))
    # Back from items to tokens; the rarest of them is where the rule stands in the inverted index.
    members = strong.withColumn("item", F.explode("body")).join(frequent, "item")
    rules = members.groupBy("body", "verdict", "hits", "confidence").agg(F.array_sort(F.collect_list("token")).alias("tokens"), F.min(F.struct("n", "token")).token.alias("anchor"))
    out = written(rules.select("tokens", F.size("tokens").alias("n_tokens"), "verdict", "hits", "confidence", "anchor"), "rules")
    out.spent = [frequent, baskets, sets]
    return out


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, verdict, confidence, by) of the rows (row, tokens) that fulfil a rule; by: the tokens of the best one."""
    index = F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules
    asked = urls.select("row", F.col("tokens").alias("has"), F.explode("tokens").alias("anchor"))
    hits = asked.join(index, "anchor").filter(F.size(F.array_except("tokens", "has")) == 0)
    # The least of these structs is the best rule; it is met as one per row and task.
    best = F.struct((-F.col("confidence")).alias("c"), (-F.col("hits")).alias("h"), "n_tokens", "tokens", "verdict")
    return hits.groupBy("row").agg(F.min(best).alias("b")).select("row", "b.verdict", (-F.col("b.c")).alias("confidence"), F.array_join("b.tokens", " ").alias("by"))


def url_filter(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row of pages: key, host, path, rule and verdict, and what a mined verdict rests on (mined_by, confidence).

    labels: (url, verdict) to mine from; by default the URLs that the listed rules decide.
    """
    rest = after_scheme(F.coalesce(F.col(url), F.lit("")))
    text, verdict = listed(rules, F.col("host"), F.col("path"))
    parsed = pages.select(ident(key).alias(key), rest.alias("rest")).select("*", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"))
    rows = written(parsed.select(F.monotonically_increasing_id().alias("row"), key, "host", "path", tokens(F.col("rest")).alias("tokens"), text.alias("rule"), verdict.alias("listed")), "urls")
    if labels is None:
        labelled, lent = rows.filter("listed IS NOT NULL").select("row", "tokens", F.col("listed").alias("verdict")), []
    else:
        given = labels.filter(F.col("verdict").isin(*VERDICTS)).select(F.monotonically_increasing_id().alias("row"), tokens(after_scheme(F.coalesce(F.col("url"), F.lit("")))).alias("tokens"), "verdict")
        labelled = written(given, "labelled")
        lent = [labelled]
    found = mine(labelled, support, confidence)
    judged = judge(rows.filter("listed IS NULL").select("row", "tokens"), found)
    out = rows.join(judged, "row", "left").select(key, "host", "path", "rule", F.coalesce("listed", "verdict", F.lit("allow")).alias("verdict"), F.col("by").alias("mined_by"), "confidence")
    out = restored(out, key)
    out.spent = [rows, found, *getattr(found, "spent", []), *lent]
    return out
