"""Verdicts on URLs: rules on host and path first, boosted trees on lexical features for the rest.

The URLs that a rule decides are the labelled ones the trees learn from. Suffix statistics (how often URLs with
the same end of the host, or the same first folder, are blocked) are counted over all labelled URLs into a fixed
number of hash buckets, so their size does not depend on the data.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import local
from threadloom.llm.trees import Trees, train

SAMPLE_ROWS = 20_000
BUCKETS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # "host/path", "allow" or "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case (A-Z only), and the path up to query or fragment.

    Both are empty for a null url and for one without ``://``.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r)):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffixes(host: Column, path: Column) -> list[Column]:
    """Buckets of the last label of the host, its last two labels, and the first folder with the last label."""
    last = F.substring_index(host, ".", -1)
    folder = F.regexp_extract(path, r"^/([^/]*)/", 1)
    keys = [last, F.substring_index(host, ".", -2), F.concat(last, F.lit("/"), folder)]
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(BUCKETS)).cast("int") for k, key in enumerate(keys)]


WIDTH = 16


def lexical(url: str, host: str, path: str) -> list[float]:
    """Features of the spelling of one url."""
    n = len(url)
    counts = Counter(url)
    query = url.partition("#")[0].partition("?")[2]
    parts = [p for p in path.split("/") if p]
    return [
        n, len(host), len(path), host.count("."), len(parts), max(map(len, parts), default=0),
        sum(map(counts.__getitem__, "0123456789")) / max(1, n), -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0,
        len(query), query.count("&") + 1 if query else 0, counts["-"] + counts["_"], "#" in url,
    ]


def _features(batch: pd.DataFrame, shares: np.ndarray) -> np.ndarray:
    x = np.zeros((len(batch), WIDTH))
    if len(batch):
        x[:, :12] = [lexical(u, h, p) for u, h, p in zip(batch["url"], batch["host"], batch["path"], strict=True)]
    for k in range(3):
        x[:, 12 + k] = shares[k][batch[f"s{k}"].to_numpy(np.int64)]
    x[:, 15] = batch["url"].str.startswith("https").to_numpy(float)
    return x


def _prepared(urls: DataFrame, id_column: str, rules: Sequence[Rule]) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    base = urls.select(F.col(id_column).cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    s = suffixes(F.col("host"), F.col("path"))
    return base.select("*", rule.alias("rule"), verdict.alias("verdict"), *(c.alias(f"s{k}") for k, c in enumerate(s)))


def fit_urls(urls: DataFrame, rules: Sequence[Rule], id_column: str = "page_id", sample_rows: int = SAMPLE_ROWS) -> tuple[Trees, np.ndarray]:
    """Trees and suffix statistics from the URLs that a rule decides.

    Statistics count all of them; the trees take at most ``sample_rows``, those with the smallest hash.
    """
    known = _prepared(urls, id_column, rules).where(F.col("verdict").isNotNull()).withColumn("y", (F.col("verdict") == "block").cast("int"))
    counted = known.select("y", F.posexplode(F.array("s0", "s1", "s2")).alias("k", "s")).groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    seen, blocked = np.zeros((3, BUCKETS)), np.zeros((3, BUCKETS))
    for row in counted.collect():  # at most three times the buckets
        seen[row["k"], row["s"]], blocked[row["k"], row["s"]] = row["n"], row["y"]
    overall = (blocked[0].sum() + 1) / (seen[0].sum() + 2)
    shares = (blocked + overall) / (seen + 1)
    sample = local(known.orderBy(F.xxhash64("url", "page_id"), "url").limit(sample_rows).drop("verdict", "rule"))
    return train(_features(sample, shares), sample["y"].to_numpy(float)), shares


def judge_urls(urls: DataFrame, rules: Sequence[Rule], model: tuple[Trees, np.ndarray], id_column: str = "page_id", least: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and block score of every row.

    The verdict is the longest fitting rule's; without one it is block if the trees give ``least`` or more.
    Repeated rows are judged each; a null or empty url has empty host and path and is judged by the trees.
    """
    trees, shares = model

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = trees.score(_features(batch, shares))
            own = np.where(score >= least, "block", "allow")
            batch["verdict"] = batch["verdict"].where(batch["verdict"].notna(), own)
            yield batch[["page_id", "null", "host", "path", "rule", "verdict"]].assign(score=score)

    ready = _prepared(urls, id_column, rules).withColumns({"null": F.col("page_id").isNull(), "page_id": F.coalesce("page_id", F.lit(0))})
    out = ready.mapInPandas(judge, "page_id long, null boolean, host string, path string, rule string, verdict string, score double")
    return out.select(F.when(~F.col("null"), F.col("page_id")).alias("page_id"), "host", "path", "rule", "verdict", "score")
