"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

DataFrame and SQL functions only. The model is bounded by ``dim``. Training reads a small labelled URL table, whose features come to the
driver once (``most`` rows at most) for gradient descent; pages are scored row by row, so nothing is shuffled. How far the model judges
hosts that it has not seen is measured on folds of hosts that are held out (held_out_scores); the cut of judge was chosen on it.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Labelled seed hosts: 1 is to be blocked.
_UNWANTED = (
    "cheap-pills", "spam-farm", "casino-bonus", "free-pills", "click-farm", "link-farm", "fast-loans", "win-prizes", "replica-watches",
    "adult-cams", "cheap-meds", "spam-links", "poker-bonus", "pills-online", "get-rich-quick", "free-casino", "hot-singles", "content-farm",
    "bonus-poker", "cheap-watches", "replica-bags", "fast-cash", "cash-loans", "singles-cams", "meds-online", "win-cash", "spam-pills", "farm-links",
    "casino-wins", "quick-loans", "free-prizes", "adult-singles", "cheap-replica", "click-bonus", "link-spam", "hot-cams", "rich-quick", "online-casino",
)
_WANTED = (
    "citylibrary", "gardennotes", "openwiki", "university", "recipes", "museum", "weather", "history", "harbour", "theatre", "northern",
    "thrushes", "tharin", "stonering", "anderhall", "resting", "lythend", "ouration", "erthend", "blessing", "inshore", "wheatland",
    "gardenwiki", "cityhistory", "openlibrary", "northweather", "museumnotes", "theatrenews", "harbourhistory", "recipewiki", "weathernotes", "universitynews",
    "shoreland", "ringstone", "andrewhall", "thendal", "erinhall", "wheatstone", "restland", "ouringham", "northharbour", "historynotes",
)
_FORMS = (("https://www.{}.example.com/en/{}", 12), ("http://{}.example.org/de/{}.html", 345), ("https://blog.{}.example.net/es/{}?page=2", 78))


def seed_urls(spark: SparkSession) -> DataFrame:
    """url, label, name: the small labelled table, every seed host in a few usual forms; name is the host's own part."""
    rows = [(form.format(host, n), label, host) for label, hosts in ((1, _UNWANTED), (0, _WANTED)) for host in hosts for form, n in _FORMS]
    return spark.createDataFrame(rows, "url string, label int, name string")


def held_out_scores(labelled: DataFrame, folds: int = 4) -> DataFrame:
    """url, label, probability of labelled(url, label, name): every name is judged by a model that learned from names of other folds only."""
    fold = F.pmod(F.crc32("name"), F.lit(folds))
    out = None
    for k in range(folds):
        model = fit(labelled.where(fold != k))
        host, path = host_of(F.col("url")), path_of(F.col("url"))
        told = labelled.where(fold == k).select("url", "label", model.probability(host, path).alias("probability"))
        out = told if out is None else out.unionByName(told)
    return out


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none does; of equal length, the first in text order."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once, also where f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _grams(text: Column, mark: str, sizes, dim: int) -> Column:
    def of_size(chars: Column, n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.size(chars))
        return F.transform(starts, lambda i: F.pmod(F.crc32(F.concat(F.lit(mark), *(F.get(chars, i + (j - 1)) for j in range(n)))), F.lit(dim)).cast("int"))

    return _let(F.split(text, ""), lambda chars: F.concat(*(of_size(chars, n) for n in sizes)))


def features(host: Column, path: Column, sizes=(3, 4), dim: int = 4096) -> Column:
    """Distinct hashed n-grams of host (between ^ and $) and path; digits count as 0."""
    plain = lambda c: F.translate(c, "123456789", "000000000")
    return F.array_distinct(F.concat(_grams(F.concat(F.lit("^"), plain(host), F.lit("$")), "h", sizes, dim), _grams(plain(path), "p", sizes, dim)))


@dataclass
class UrlModel:
    """Weights of the hashed n-grams; its size is dim, whatever it is trained on."""

    weights: list[float]
    bias: float
    sizes: tuple[int, ...]
    dim: int

    def probability(self, host: Column, path: Column) -> Column:
        """The probability that a url is to be blocked."""
        weights = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")
        mean = lambda grams: F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(weights, g)) / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))
        margin = F.lit(self.bias) + _let(features(host, path, self.sizes, self.dim), mean)
        return 1 / (1 + F.exp(-margin))


def fit(labelled: DataFrame, sizes=(3, 4), dim: int = 4096, epochs: int = 100, rate: float = 4.0, ridge: float = 1e-3, most: int = 20_000) -> UrlModel:
    """Gradient descent with momentum on url, label (1: block), of which at most most rows are taken, by a hash of the url.

    Rows with a null label are left out; with no rows at all the model says 0.5 everywhere, which allows.
    """
    url = F.col("url")
    chosen = labelled.where("label is not null").select("url", "label").orderBy(F.xxhash64("url"), "url", "label").limit(most)
    rows = [(r.grams, float(r.label)) for r in chosen.select(features(host_of(url), path_of(url), sizes, dim).alias("grams"), "label").collect()]
    weights, bias, speed, bias_speed = [0.0] * dim, 0.0, [0.0] * dim, 0.0
    for _ in range(epochs if rows else 0):
        push, bias_push = {}, 0.0
        for grams, label in rows:
            norm = math.sqrt(max(1, len(grams)))
            error = 1 / (1 + math.exp(-(bias + sum(weights[g] for g in grams) / norm))) - label
            bias_push += error
            for g in grams:
                push[g] = push.get(g, 0.0) + error / norm
        for g, part in push.items():
            speed[g] = 0.8 * speed[g] - rate * (part / len(rows) + ridge * weights[g])
            weights[g] += speed[g]
        bias_speed = 0.8 * bias_speed - rate * bias_push / len(rows)
        bias += bias_speed
    return UrlModel(weights, bias, tuple(sizes), dim)


def judge(pages: DataFrame, model: UrlModel, rules=RULES, cut: float = 0.75) -> DataFrame:
    """pages with host, path, rule, verdict and probability added (columns of those names are replaced).

    verdict is the rule's where one fits, else block where the probability is over cut (0.75 keeps wanted hosts, see held_out_scores). A null url, or one without
    ``://``, has empty host and path and is judged by the model. Rows are kept as they are, repeated ones too.
    """
    own = ["host", "path", "rule", "verdict", "probability"]
    base = pages.drop(*own).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return base.withColumns({"rule": rule, "probability": model.probability(F.col("host"), F.col("path"))}).withColumn(
        "verdict", F.coalesce(verdict, F.when(F.col("probability") > cut, "block").otherwise("allow"))
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(seed_urls(spark))).select("page_id", "host", "path", "rule", "verdict", F.round("probability", 6).alias("probability"))


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES: dict[str, str] = {}
