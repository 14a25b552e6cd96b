"""Operator 4: verdicts on URLs by given rules and by association rules mined from labels."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from skein.plans.iterate import discard, materialize, together

#: The given rules, as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Mined rules need this share of the labelled rows, this many of them, and a confidence this many times their label's share.
SUPPORT, LEAST_ROWS, LIFT = 0.005, 5, 1.2
#: Rows of more tokens are projected on their tokens, again and again, until none is longer; FP-growth then mines them. No cap: all tokens take part.
MOST_TOKENS = 12
VERDICTS = ("allow", "block")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _given(rules, what: int) -> Column:
    """The longest rule that fits host and path: its name, or its verdict."""
    out = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.lit((host + path, verdict)[what])).otherwise(out)
    return out


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: host labels, words of the path, names of the query; numbers are #."""
    words = lambda s, mark: F.transform(F.filter(F.split(s, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0), lambda w: F.concat(F.lit(mark), F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(F.lower(w))))
    labels = F.transform(F.filter(F.split(host, r"\."), lambda w: F.length(w) > 0), lambda w: F.concat(F.lit("h:"), w))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda w: F.length(w) > 0), lambda w: F.concat(F.lit("q:"), F.lower(F.substring_index(w, "=", 1))))
    return F.array_distinct(F.concat(labels, words(path, "p:"), names))


def _rules_of(antecedents: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of `antecedents` (antecedent ...) and `rows` (tokens ...) in which the row has all of the antecedent's tokens.

    An inverted index holds each antecedent under its rarest token among the antecedents, which any
    row that it matches must have; a row's tokens look antecedents up, and the rest of the
    antecedent is then verified."""
    each = antecedents.select("antecedent", F.explode("antecedent").alias("token")).distinct()
    rare = each.groupBy("token").agg(F.count("*").alias("used"))
    index = each.join(rare, "token").groupBy("antecedent").agg(F.min(F.struct("used", "token"))["token"].alias("token"))
    met = rows.withColumn("token", F.explode("tokens")).join(antecedents.join(index, "antecedent"), "token")
    return met.where(F.size(F.array_except("antecedent", "tokens")) == 0).drop("token")


def _projected(each: DataFrame, open_labels: list[str], least: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Combinations (antecedent) found on the way, and rows (prefix, label, tokens) of at most MOST_TOKENS tokens to mine for the rest; tables of each round.

    A prefix has the rows that hold it, with their tokens that follow it; where any of them is longer, each
    token makes a longer prefix, followed by those that are more frequent beside the old one. Combinations go if they
    cannot be a rule that stays: fewer than `least` rows of every label that may have rules, or the same rows as with a
    token less, or a prefix whose rows have one label, as more tokens then tell no more. So tokens that always occur
    together, or one of which implies others, make no combinations."""
    none = F.array().cast("array<string>")
    flat = each.select(none.alias("prefix"), F.lit(None).cast("long").alias("of"), F.lit(open_labels).cast("array<string>").alias("open"), "row", "label", F.explode("tokens").alias("token"))
    drawn, short = [], []
    while True:
        flat = materialize(flat)
        by_label = flat.groupBy("prefix", "of", "open", "token", "label").agg(F.count("*").alias("m"))
        tried = by_label.groupBy("prefix", "of", "open", "token").agg(F.sum("m").alias("all"), F.collect_list(F.struct("label", "m")).alias("by"))
        told = F.filter("by", lambda x: (x["m"] >= least) & F.array_contains("open", x["label"]))
        tried = tried.withColumn("told", told).where((F.size("told") > 0) & (F.col("of").isNull() | (F.col("all") < F.col("of"))))
        then = F.transform(F.filter("told", lambda x: x["m"] < F.col("all")), lambda x: x["label"])
        tried = materialize(tried.select("prefix", "token", "all", then.alias("then")))
        drawn.append(materialize(tried.select(F.array_sort(F.concat("prefix", F.array("token"))).alias("antecedent"))))
        lists = flat.join(tried, ["prefix", "token"]).groupBy("prefix", "open", "row", "label").agg(F.sort_array(F.collect_list(F.struct("all", "token", "then"))).alias("list"))
        lists = materialize(lists)
        discard(flat, tried)
        long = materialize(lists.groupBy("prefix").agg(F.max(F.size("list")).alias("most")).where(F.col("most") > MOST_TOKENS).select("prefix"))
        mined = lists.join(long, "prefix", "left_anti").where(F.array_contains("open", F.col("label")))
        short.append(materialize(mined.select("prefix", "label", F.col("list.token").alias("tokens"))))
        if long.isEmpty():
            discard(lists, long)
            return drawn, short
        at = lists.join(long, "prefix").select("prefix", "row", "label", "list", F.posexplode("list").alias("at", "x")).where(F.size("x.then") > 0)
        rest = F.slice("list", F.col("at") + 2, F.size("list"))
        flat = at.select(F.concat("prefix", F.array("x.token")).alias("prefix"), F.col("x.all").alias("of"), F.col("x.then").alias("open"), "row", "label", F.explode(rest).alias("y")).withColumn("token", F.col("y.token")).drop("y")


def mine(labelled: DataFrame, support: float = SUPPORT, least_rows: int = LEAST_ROWS, lift: float = LIFT) -> DataFrame:
    """Association rules of labelled (tokens, label): antecedent, label, lift, rows.

    Spark's FP-growth mines the frequent combinations of a label and tokens: at least `support` of
    the rows and least_rows of them. A rule's confidence is that of its label among all rows with its
    tokens; it stays if that is `lift` times the label's share of all rows, so that a rare label can have
    rules, and if no rule on fewer of its tokens is as confident of the same label. Combinations are drawn from all
    tokens of a URL; rows of more than MOST_TOKENS are projected on their tokens first, which
    leaves out what is no rule that stays."""
    spark = labelled.sparkSession
    shares = dict(labelled.groupBy("label").count().collect())  # a row for each label
    n = sum(shares.values())
    if n == 0:
        return spark.createDataFrame([], "antecedent array<string>, label string, lift double, rows long")
    least = max(least_rows, math.ceil(support * n))
    each = labelled.select("label", "tokens", F.monotonically_increasing_id().alias("row"))
    each = materialize(each)
    alone, short = _projected(each, [label for label, m in shares.items() if n / m > lift - 1e-9], least)
    rows = together(short).where(F.size("tokens") > 0)
    # an item tells its prefix, so that all of a combination's items have the same one
    items = materialize(rows.select(F.concat(F.transform("tokens", lambda t: F.to_json(F.concat("prefix", F.array(t)))), F.array(F.concat(F.lit("="), "label"))).alias("items")))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, items.count()))).fit(items).freqItemsets
    mark = F.filter("items", lambda x: x.startswith("="))
    told = F.flatten(F.transform(F.filter("items", lambda x: ~x.startswith("=")), lambda x: F.from_json(x, "array<string>")))
    drawn = found.where((F.size(mark) == 1) & (F.size("items") > 1)).select(F.array_sort(F.array_distinct(told)).alias("antecedent"))
    drawn = materialize(drawn.union(together(alone)).distinct())
    counted = materialize(_rules_of(drawn, each).groupBy("antecedent", "label").agg(F.count("*").alias("rows")))
    of_all = counted.groupBy("antecedent").agg(F.sum("rows").alias("all"))
    share = F.create_map(*[x for label, m in shares.items() for x in (F.lit(label), F.lit(m / n))])
    rules = counted.join(of_all, "antecedent").withColumn("lift", F.round(F.col("rows") / F.col("all") / share[F.col("label")], 12))
    rules = materialize(rules.where((F.col("rows") >= least) & (F.col("lift") >= lift)).select("antecedent", "label", "lift", "rows"))
    within = _rules_of(rules.select("antecedent", F.col("label").alias("of"), F.col("lift").alias("at_least")), rules.select(F.col("antecedent").alias("tokens"), "label", "lift"))
    told = within.where((F.size("tokens") > F.size("antecedent")) & (F.col("label") == F.col("of")) & (F.col("at_least") >= F.col("lift")))
    kept = materialize(rules.join(told.select(F.col("tokens").alias("antecedent"), "label").distinct(), ["antecedent", "label"], "left_anti"))
    discard(each, *alone, *short, items, drawn, counted, rules)
    return kept


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The best rule's label for each of the distinct (url, tokens) that any rule matches: url, mined.

    Ties of lift go to the rule of more rows, then to its tokens and its label."""
    return _rules_of(rules, urls.select("url", "tokens")).groupBy("url").agg(F.max(F.struct("lift", "rows", "antecedent", "label"))["label"].alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, default: str = "allow", **mining) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url).

    The longest given rule that fits decides. Other URLs get the label of the mined rule
    of the highest lift, else the default. Rules are mined from the pages that labels (doc_id = page_id)
    tell of: block if toxic or of quality 0.

    Cases: null urls and urls without :// have an empty host and path, fit no given rule, and
    have what tokens they have; unlabelled pages and labels without a page or with nulls
    teach nothing; several labels of a page count as so many rows; no labels give no mined
    rules; repeated pages each give a row; other columns are left aside.
    """
    url = F.col("url")
    seen = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    seen = seen.withColumn("rule", _given(rules, 0)).withColumn("given", _given(rules, 1))
    marks = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit("block")).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), F.lit("allow")).alias("mark")).where("mark is not null")
    token = tokens(F.col("host"), F.col("path"), url)
    mined = mine(seen.where("url is not null").join(marks, "page_id").select(token.alias("tokens"), F.col("mark").alias("label")), **mining)
    open_urls = seen.where("given is null and url is not null").select("url", token.alias("tokens")).distinct()
    return seen.join(match(open_urls, mined), "url", "left").select("page_id", "host", "path", "rule", F.coalesce("given", "mined", F.lit(default)).alias("verdict"))
