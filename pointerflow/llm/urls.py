"""URL filters: host and path rules and boosted trees on lexical features (op8).

DataFrame functions and Spark's own gradient-boosted trees only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small
from .html import host_of

#: Labelled URLs that training uses, about; a hash of the URL picks them.
SAMPLE = 20_000
#: Folds of the labelled URLs: the share of blocked URLs of a suffix is counted,
#: for each of them, over the other folds.  URLs of one fold are trained on as if
#: their suffixes were new, so that trees judge such hosts by the rest.
FOLDS = 5
SUFFIXES = ("suffix", "file")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith(f".{self.host}")
        return host & F.col("path").startswith(self.path)


RULES = (Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _entropy(text: str) -> Column:
    """Bits a character of a string."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(F.col(text), c))) / n
    each = F.array_distinct(F.split(text, ""))
    return -F.aggregate(F.filter(each, lambda c: c != ""), F.lit(0.0), lambda total, c: total + share(c) * F.log2(share(c)))


def features() -> dict[str, Column]:
    """Lexical features, of the columns that ``with_rules`` and ``_parts`` make.
    ``u_``, ``h_`` and ``p_`` stand for the whole URL, its host and its path.
    Neither host nor path is known by name, but for the statistics of suffixes.
    """

    def rate(pattern: str, of: str) -> Column:
        return F.coalesce(F.try_divide(F.regexp_count(of, F.lit(pattern)), F.length(of)), F.lit(0.0))

    out = {f"{short}_{what}": c for short, name in (("u", "url"), ("h", "host"), ("p", "path")) for what, c in (("length", F.length(name)), ("digits", rate("[0-9]", name)), ("hyphens", rate("-", name)), ("entropy", F.coalesce(_entropy(name), F.lit(0.0))))}
    out |= {
        "depth": F.regexp_count("path", F.lit("/[^/]+")),
        "labels": F.regexp_count("host", F.lit("[^.]+")),
        "label_length": F.length(F.regexp_extract("host", r"([^.]*)(?:\.[^.]*){0,2}$", 1)),
        "parameters": F.when(F.col("query") == "", 0).otherwise(1 + F.regexp_count("query", F.lit("&"))),
        "fragment": F.contains("url", F.lit("#")).cast("int"),
        "secure": F.startswith("url", F.lit("https:")).cast("int"),
        "slash_end": F.endswith("path", F.lit("/")).cast("int"),
        "first_length": F.length(F.regexp_extract("path", "^/([^/]*)", 1)),
    }
    for key in SUFFIXES:
        out |= {f"{key}_length": F.length(key), f"{key}_rows": F.log1p(F.col(f"{key}_rows")), f"{key}_blocked": F.col(f"{key}_blocked")}
    return out


def with_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule and ruled: the verdict of the longest rule
    that fits, or null."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule = ruled = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        rule, ruled = F.when(r.fits(), r.name).otherwise(rule), F.when(r.fits(), r.verdict).otherwise(ruled)
    return rows.withColumn("rule", rule).withColumn("ruled", ruled)


def _parts(rows: DataFrame) -> DataFrame:
    """Adds the suffixes of host and path, the parameters and the fold."""
    parts = {"suffix": F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0), "file": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1), "query": F.regexp_extract("url", r"\?([^#]*)", 1)}
    return rows.withColumns(parts).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))


def _statistics(labelled: DataFrame, key: str, prior: float) -> DataFrame:
    """How often a suffix is labelled and which share of it is blocked, drawn
    towards ``prior`` by two URLs, in each fold's other folds (fold null: in all)."""
    cells = saved(labelled.groupBy(key, "fold").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("b")), f"urls-{key}")
    whole = cells.groupBy(key).agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    others = cells.join(whole, key).select(key, "fold", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_b") - F.col("b")).alias("b"))
    both = others.unionByName(whole.select(key, F.lit(None).cast("int").alias("fold"), F.col("all_n").alias("n"), F.col("all_b").alias("b")))
    return saved(both.select(F.col(key).alias(f"{key}_is"), F.col("fold").alias(f"{key}_fold"), F.col("n").alias(f"{key}_rows"), ((F.col("b") + 2 * prior) / (F.col("n") + 2)).alias(f"{key}_blocked")), f"urls-{key}-rates")


@dataclass(frozen=True)
class UrlModel:
    """Trained trees and the suffix statistics that they read."""

    trees: GBTClassificationModel
    known: dict[str, tuple[DataFrame, int]]
    prior: float

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` of ``with_rules`` with ``score``, how likely to be blocked."""
        judged = self.trees.transform(_vectors(_parts(rows).withColumn("fold", F.lit(None).cast("int")), self.known, self.prior, rows.columns))
        return judged.select(*rows.columns, vector_to_array("probability")[1].alias("score"))


def _vectors(rows: DataFrame, known: dict[str, tuple[DataFrame, int]], prior: float, kept: list[str]) -> DataFrame:
    for key, (stats, n) in known.items():
        rows = rows.join(small(stats, n), (rows[key] == stats[f"{key}_is"]) & rows.fold.eqNullSafe(stats[f"{key}_fold"]), "left")
        rows = rows.withColumns({f"{key}_rows": F.coalesce(f"{key}_rows", F.lit(0)), f"{key}_blocked": F.coalesce(f"{key}_blocked", F.lit(prior))})
    lexical = features()
    rows = rows.select(*kept, *(c.cast("double").alias(f"f_{k}") for k, c in lexical.items()))
    return VectorAssembler(inputCols=[f"f_{k}" for k in lexical], outputCol="features").transform(rows)


def train_filter(labelled: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 4) -> UrlModel | None:
    """Trees grown on about ``sample`` of the URLs that rules decide, both
    verdicts weighing the same; suffix statistics are taken over all of them.
    None if the labelled URLs show one verdict only."""
    parts = _parts(labelled)
    seen = {r.ruled: r["count"] for r in labelled.groupBy("ruled").count().collect()}
    total = sum(seen.values())
    if len(seen) < 2:
        return None
    prior = seen["block"] / total
    tables = {key: _statistics(parts, key, prior) for key in SUFFIXES}
    known = {key: (t, t.count()) for key, t in tables.items()}
    if total > sample:
        parts = parts.where(F.pmod(F.xxhash64(F.lit("sample"), "url"), F.lit(1_000_003)) < int(1_000_003 * sample / total))
    # -1 is no fold of any suffix: those URLs meet no statistics
    parts = parts.withColumn("fold", F.when(F.col("fold") == 0, -1).otherwise(F.col("fold")))
    label = (F.col("ruled") == "block").cast("double")
    weight = F.when(label == 1, total / (2 * seen["block"])).otherwise(total / (2 * (total - seen["block"])))
    training = saved(_vectors(parts, known, prior, ["ruled"]).select("features", label.alias("label"), weight.alias("weight")), "urls-training")
    grower = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=7, minInstancesPerNode=5, weightCol="weight")
    return UrlModel(grower.fit(training.coalesce(max(1, min(8, total // 5000)))), known, prior)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, trees: int = 20, depth: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    URLs that a rule decides are the labelled ones, from which ``train_filter``
    learns; other URLs are blocked if their ``score`` is above one half.  If the
    labelled URLs show one verdict only, or there are none, the others are
    allowed and no score is given.  Null urls, and urls without ``://``, have an
    empty host and path.
    """
    rows = with_rules(pages, rules, id_col, url_col)
    model = train_filter(rows.where("ruled is not null"), sample, trees, depth)
    judged = model.score(rows) if model else rows.withColumn("score", F.lit(None).cast("double"))
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
