"""URL filter: rules by host and path, and for the rest boosted trees on lexical features.

The urls that a rule decides are the labelled ones. Trees learn from length, depth, digit ratio, entropy,
parameter counts and the block rates of host suffixes and path starts, from which a learned url's own verdict is left out. Only
DataFrame functions and Spark's own boosted trees are used.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, functions as F

from stockaudit.llm import boosting
from stockaudit.llm.tables import landed
from stockaudit.operators.joins import stored

BLOCK, ALLOW = "block", "allow"
# The rules of the contract.
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))
# Suffixes are counted in this many buckets, so that the table of their block rates has a bound.
SUFFIX_BUCKETS = 4096
PRIOR_ROWS = 20
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "last_rate", "suffix_rate", "start_rate")


def host_of(url: Column) -> Column:
    rest = F.expr("substring(_u, locate('://', _u) + 3)")
    found = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(url.contains("://"), found).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring(_u, locate('://', _u) + 3)")
    return F.when(url.contains("://"), F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)).otherwise("")


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The rule (``value`` 0) or verdict (1) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0])):
        domain, _, start = rule[0].partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character. Characters are counted by what is left of the text without each of them."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    part = F.filter(counts, lambda k: k > 0)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(part, F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n)))


# What block rates are taken of: the last label of the host, its last two, and where the path starts.
RATED = {
    "last": lambda: F.substring_index("host", ".", -1),
    "suffix": lambda: F.substring_index("host", ".", -2),
    "start": lambda: F.substring_index("path", "/", 2),
}


def _bucket(kind: str) -> Column:
    return F.pmod(F.crc32(RATED[kind]().cast("binary")), F.lit(SUFFIX_BUCKETS)).cast("int")


def _rate(kind: str) -> Column:
    """Smoothed block rate of a bucket, without the row itself where ``_own`` says that it was counted."""
    own = F.col("_own").cast("double")
    blocked = F.coalesce(f"{kind}_blocked", F.lit(0)) - own * (F.col("_verdict") == BLOCK).cast("double")
    return (blocked + 0.5 * PRIOR_ROWS) / (F.coalesce(f"{kind}_n", F.lit(0)) - own + PRIOR_ROWS)


def features(judged: DataFrame, counts: DataFrame, counted: bool = False) -> DataFrame:
    """Lexical features of ``_u``, ``host`` and ``path``; ``counts`` has a row for each bucket at most.

    ``counted`` rows are among those that ``counts`` has counted, and their own verdict is taken out of their rates.
    """
    n = F.greatest(F.length("_u"), F.lit(1))
    query = F.regexp_extract("_u", r"\?([^#]*)", 1)
    simple = judged.withColumns({
        "length": F.length("_u").cast("double"),
        "host_length": F.length("host").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": (F.length(F.regexp_replace("_u", "[^0-9]", "")) / n).cast("double"),
        "entropy": entropy(F.col("_u")),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "labels": F.size(F.filter(F.split("host", r"\."), lambda x: x != "")).cast("double"),
        "hyphens": F.length(F.regexp_replace("_u", "[^-]", "")).cast("double"),
        **{f"_{kind}": _bucket(kind) for kind in RATED},
        "_own": F.lit(int(counted)),
    })
    for kind in RATED:
        of_kind = counts.where(F.col("kind") == kind)
        table = of_kind.select(F.col("bucket").alias(f"_{kind}"), F.col("blocked").alias(f"{kind}_blocked"), F.col("n").alias(f"{kind}_n"))
        simple = simple.join(F.broadcast(table), f"_{kind}", "left").withColumn(f"{kind}_rate", F.coalesce(_rate(kind), F.lit(0.5)))
        simple = simple.drop(f"_{kind}", f"{kind}_blocked", f"{kind}_n")
    return simple.drop("_own")


def suffix_counts(ruled: DataFrame) -> DataFrame:
    """Blocked and all urls of each bucket, over distinct urls that a rule decides: at most three times the buckets."""
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), _bucket(kind).alias("bucket")) for kind in RATED]))
    rows = ruled.select((F.col("_verdict") == BLOCK).cast("int").alias("blocked"), kinds.alias("k"))
    return rows.groupBy("k.kind", "k.bucket").agg(F.sum("blocked").alias("blocked"), F.count("*").alias("n"))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, _u, host, path, rule, _verdict``: the url with its parts and what the rules say, null if none fits."""
    judged = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_u"))
    judged = judged.withColumns({"host": host_of(F.col("_u")), "path": path_of(F.col("_u"))})
    host, path = F.col("host"), F.col("path")
    return judged.withColumns({"rule": matched(host, path, rules, 0), "_verdict": matched(host, path, rules, 1)})


@dataclass(frozen=True)
class Learned:
    """Trees and suffix counts; without trees the one verdict, as a score, that there is to learn."""

    counts: DataFrame
    model: Transformer | None
    only: float


def learn(judged: DataFrame) -> Learned:
    """Learn from the distinct urls that a rule decides: of each verdict a bounded sample, by a hash of the url."""
    distinct = judged.where(F.col("_verdict").isNotNull()).dropDuplicates(["_u"])
    distinct = landed(distinct.select("_u", "host", "path", "_verdict"), "ruled")
    counts = stored(suffix_counts(distinct))
    label = (F.col("_verdict") == BLOCK).cast("double").alias("label")
    ready = features(distinct, counts, counted=True).select(*FEATURES, label, F.xxhash64("_u").alias("draw"))
    key = F.struct("draw", *FEATURES)
    kinds = [boosting.bounded_sample(ready.where(F.col("label") == kind), key, boosting.SAMPLE_ROWS // 2) for kind in (0.0, 1.0)]
    sample = kinds[0].unionAll(kinds[1])
    return Learned(counts, boosting.fit(sample, FEATURES, "label"), float(sample.agg(F.max("label")).first()[0] or 0.0))


def scored(judged: DataFrame, learned: Learned, score: str) -> DataFrame:
    """``judged`` with the trees' probability that a url is to be blocked, whatever the rules say."""
    ready = features(judged, learned.counts)
    return ready.withColumn(score, F.lit(learned.only)) if learned.model is None else boosting.scored(learned.model, ready, score)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of each row.

    A null url, or one without ``://``, has an empty host and path and no rule; like all others without a
    rule the trees judge it. With only one kind of labelled url, or none, those are all of that kind, or
    allowed. Repeated rows are judged alike, and a url counts once in what is learned; other columns are not read.
    """
    judged = ruled(pages, rules)
    found = scored(judged, learn(judged), "block_score")
    verdict = F.coalesce("_verdict", F.when(F.col("block_score") > 0.5, BLOCK).otherwise(ALLOW))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
