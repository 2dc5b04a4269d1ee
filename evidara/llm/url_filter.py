"""URL verdicts from given host and path rules, and beyond them from mined association rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import LOWER, UPPER
from evidara.session import durable

#: (verdict, host, path): the contract's fixed rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LABEL = "verdict="
#: Token sets with more than one open URL in so many are looked up by broadcast.
LARGE_SETS = 1000


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; empty if there is none."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path together) that fits, as a struct (rule, verdict); null if none fits.

    The rules are a short fixed list, so they are compared in one expression, longest first.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in reversed(ordered):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Different tokens of a URL: scheme, host labels by their place from the right, path segments with digits masked, and query names."""
    labels = F.reverse(F.split(host, r"\."))
    places = F.transform(labels, lambda x, i: F.concat(F.lit("host"), F.least(i, F.lit(3)).cast("string"), F.lit("="), x))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    parts = F.transform(segments, lambda x: F.concat(F.lit("path="), F.regexp_replace(F.translate(x, UPPER, LOWER), "[0-9]+", "0")))
    query = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), F.lit(1))
    names = F.transform(query, lambda x: F.concat(F.lit("query="), x))
    words = F.transform(F.filter(F.split(F.get(labels, F.lit(2)), "[^a-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit("word="), x))
    scheme = F.concat(F.lit("scheme="), F.translate(F.regexp_extract(url, "^([^:/]*)://", 1), UPPER, LOWER))
    every = F.concat(F.array(scheme), places, parts, names, F.coalesce(words, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Association rules tokens -> verdict from (tokens, label) rows, as (rule_id, antecedent, label, confidence, support).

    FP-growth keeps combinations that at least min_support of the labelled URLs share, so there are few whatever the
    input's size. Of the rules only those that conclude a verdict stay; prune() thins them out.
    """
    items = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    conclusion = F.get("consequent", F.lit(0))
    return model.associationRules.where(F.startswith(conclusion, F.lit(LABEL))).select(
        F.xxhash64(F.array_sort("antecedent"), conclusion).alias("rule_id"), F.array_sort("antecedent").alias("antecedent"),
        F.substring(conclusion, len(LABEL) + 1, 1 << 20).alias("label"), "confidence", "support",
    )


def prune(mined: DataFrame) -> DataFrame:
    """The rules without those to which a shorter one adds up: fewer tokens, all of them among the rule's, the same verdict, at least its confidence.

    A shorter rule also has at least the support, so no verdict changes but where rules of equal confidence disagree.
    Rules meet under the rarest token of the shorter one.
    """
    rules = durable(mined)
    short = rule_index(rules).select(F.col("antecedent").alias("fewer"), F.col("label").alias("same"), F.col("confidence").alias("sure"), "token")
    long = rules.where(F.size("antecedent") > 1).select("rule_id", "antecedent", "label", "confidence", F.explode("antecedent").alias("token"))
    within = (F.size("fewer") < F.size("antecedent")) & F.forall("fewer", lambda t: F.array_contains("antecedent", t))
    spare = long.join(short, "token").where((F.col("label") == F.col("same")) & (F.col("sure") >= F.col("confidence")) & within).select("rule_id").distinct()
    return rules.join(spare, "rule_id", "left_anti")


def rule_index(mined: DataFrame) -> DataFrame:
    """The rules as an inverted index with one entry each: under that of its tokens which the fewest rules name.

    A URL that satisfies a rule has this token too, so each meets the rule once, and few others.
    """
    each = mined.withColumn("needed", F.size("antecedent")).withColumn("token", F.explode("antecedent"))
    counted = each.withColumn("rules", F.count("*").over(Window.partitionBy("token")))  # rows are rules, not URLs
    rarest = F.min_by("token", F.struct("rules", "token")).alias("token")
    return counted.groupBy("rule_id", "antecedent", "label", "confidence", "support", "needed").agg(rarest).drop("rule_id")


def judge_urls(pages: DataFrame, rules=RULES, min_support: float = 0.01, min_confidence: float = 0.7, default: str = "allow", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Each page's host, path, fitting rule and verdict.

    URLs that a given rule judges are the labelled ones. FP-growth mines them for token combinations that go with a
    verdict. The mined rules are kept as an inverted index from each one's rarest token; a URL without a given rule meets
    those under its tokens, keeps the rules all of whose tokens it has, and follows the most confident (ties: larger support, more tokens, then the
    verdict in code point order). Without any it gets ``default``.

    URLs are judged once for each different token set. Sets that more than one URL in LARGE_SETS has are fewer than
    LARGE_SETS and go to all tasks, so a host with a third of all pages doesn't meet its verdict in one task; URLs that a
    given rule judges look nothing up. A null URL or one without :// has empty host and path and gets the default. With
    no labelled URL nothing is mined. Repeated rows each get their verdict, very long URLs are taken whole; extra
    columns, whatever their names, are left out; an empty table gives no rows.
    """
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), F.col("host"), F.col("path")
    parsed = pages.select(F.col(id_col).alias("page_id"), url.alias("url")).withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    given = parsed.withColumn("given", matching_rule(host, path, rules)).withColumn("tokens", F.array_sort(url_tokens(F.col("url"), host, path)))
    given = given.withColumn("is_open", F.col("given").isNull() & (host != ""))
    result = lambda rows, mined: rows.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce(F.col("given.verdict"), mined, F.lit(default)).alias("verdict"))
    labelled = given.where("given is not null").select("tokens", F.col("given.verdict").alias("label"))
    if labelled.isEmpty():
        return result(given, F.lit(default))
    open_urls = given.where("is_open")
    mined = prune(mine_rules(labelled, min_support, min_confidence))
    different = durable(open_urls.groupBy("tokens").agg(F.count("*").alias("n")))
    verdicts = durable(set_verdicts(different, mined))
    rows = verdicts.agg(F.sum("n")).first()[0] or 0
    is_large = F.col("n") * LARGE_SETS > rows
    large, small = F.broadcast(verdicts.where(is_large).drop("n")), verdicts.where(~is_large).drop("n")
    often = result(open_urls.join(large, "tokens"), F.col("mined"))
    seldom = result(open_urls.join(large, "tokens", "left_anti").join(small, "tokens", "left"), F.col("mined"))
    return result(given.where(~F.col("is_open")), F.lit(default)).unionByName(often).unionByName(seldom)


def set_verdicts(different: DataFrame, mined: DataFrame) -> DataFrame:
    """Of (tokens, n) rows those that satisfy a rule, with the verdict of the most confident one as ``mined``."""
    met = different.select("tokens", "n", F.explode("tokens").alias("token")).join(rule_index(mined), "token")
    full = met.where(F.forall("antecedent", lambda t: F.array_contains("tokens", t)))
    return full.groupBy("tokens", "n").agg(F.min_by("label", F.struct(-F.col("confidence"), -F.col("support"), -F.col("needed"), "label")).alias("mined"))
