"""URL filtering: longest matching rule, else naive Bayes over host words and path tokens.

Host labels are often words run together. Each distinct label is split by a Viterbi search under a unigram model of
the words in the pages' own visible text: all substrings of a label meet the word counts in a join, so the whole
vocabulary is used and none of it is broadcast. The tokens of a url are the words of its host and the pieces of its
path. A multinomial naive Bayes learns tokens of urls that a rule decides and judges the others.

Defined results: host and path are empty for a null url and one without ``://``; an empty host fits no rule; a url
whose tokens were never seen goes by the classes' shares; without any url decided by a rule, and on a tie, the
verdict is allow; repeated rows are judged each; an empty table gives no rows; a null page_id is kept; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.tables import scratch, stored

#: (host, path that a url's path must start with, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Longest word looked for in a label.
LONGEST = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits, else null."""
    fits = None
    for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        condition = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(condition, value) if fits is None else fits.when(condition, value)
    return fits


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages; tags and the content of scripts and styles are left out."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;", " ")
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{2,24}"), F.lit(0))
    return pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(label: str, score: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The likeliest split of a label; a character that is in no known word costs ``unknown``."""
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - LONGEST), end):
            value = best[start] + score.get((start, end - start), unknown * 2 * (end - start) if end - start == 1 else -math.inf)
            if value > best[end]:
                best[end], back[end] = value, start
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    # Single characters that stayed alone stand together as one token.
    joined: list[str] = []
    for word in reversed(words):
        if len(word) == 1 and joined and joined[-1].startswith("?"):
            joined[-1] += word
        else:
            joined.append("?" + word if len(word) == 1 else word)
    return [word.removeprefix("?") for word in joined]


def segmented(labels: DataFrame, counts: DataFrame, folder: str) -> DataFrame:
    """(label, words) of distinct labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for label, found, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                score = {(f["start"], f["size"]): math.log(f["n"] / total) for f in found}
                words.append(best_split(label, score, -math.log(total + 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    starts = F.sequence(F.lit(0), F.length("label") - 1)
    cut = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(2), F.lit(LONGEST)), lambda n: F.struct(s.alias("start"), n.alias("size")))))
    cut = F.filter(cut, lambda c: c["start"] + c["size"] <= F.length("label"))
    parts = labels.where("label != ''").select("label", F.explode(cut).alias("c")).select("label", "c.start", "c.size", F.expr("substring(label, c.start + 1, c.size)").alias("word"))
    known = parts.join(counts, "word").select("label", F.struct("start", "size", "n").alias("f"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    # At most LONGEST times the label's length are collected, and labels are short.
    lists = labels.where("label != ''").join(known.groupBy("label").agg(F.collect_list("f").alias("found")), "label", "left").crossJoin(F.broadcast(total))
    empty = F.array().cast("array<struct<start:int,size:int,n:bigint>>")
    return stored(lists.select("label", F.coalesce("found", empty).alias("found"), F.greatest("total", F.lit(1)).alias("total")).mapInArrow(run, "label string, words array<string>"), folder)


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, and score, the log-odds of block where no rule decides."""
    folder = scratch(pages.sparkSession, "urls")
    counts = stored(word_counts(pages), f"{folder}/words")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rows = stored(rows.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)), f"{folder}/rows")

    # Hosts and paths repeat: tokens are made once per host, and counted per distinct (host, path).
    urls = rows.groupBy("host", "path", "fit").agg(F.count(F.lit(1)).alias("times"))
    urls = stored(urls.withColumn("url_key", F.xxhash64("host", "path")), f"{folder}/urls")
    hosts = urls.select("host").distinct()
    labels = hosts.select("host", F.explode(F.split("host", r"[^a-z0-9]+")).alias("label"))
    split = segmented(labels.select("label").distinct(), counts, f"{folder}/labels")
    host_words = labels.join(split, "label").select("host", F.explode("words").alias("word")).groupBy("host", "word").agg(F.count(F.lit(1)).alias("m"))
    in_host = urls.join(host_words, "host").select("host", "path", "fit", "times", F.concat(F.lit("h:"), "word").alias("token"), "m")
    in_path = urls.select("host", "path", "fit", "times", F.explode(F.split(F.lower("path"), r"[^\p{L}\p{N}]+")).alias("word")).where("word != ''")
    in_path = in_path.select("host", "path", "fit", "times", F.concat(F.lit("p:"), F.regexp_replace("word", r"^\p{N}+$", "0")).alias("token"), F.lit(1).cast("long").alias("m"))
    tokens = stored(in_host.unionByName(in_path), f"{folder}/tokens")

    block = F.col("fit.verdict") == "block"
    of = lambda what: (F.sum(F.when(block, what).otherwise(0)).alias("b"), F.sum(F.when(block, 0).otherwise(what)).alias("a"))
    learned = tokens.where(F.col("fit").isNotNull()).groupBy("token").agg(*of(F.col("times") * F.col("m")))
    sums = learned.agg(F.sum("b").alias("sum_b"), F.sum("a").alias("sum_a"), F.count(F.lit(1)).alias("kinds"))
    prior = urls.where(F.col("fit").isNotNull()).agg(*of(F.col("times"))).select(F.col("b").alias("docs_b"), F.col("a").alias("docs_a"))
    weight = F.log((F.col("b") + 1) / (F.col("sum_b") + F.col("kinds"))) - F.log((F.col("a") + 1) / (F.col("sum_a") + F.col("kinds")))
    weights = learned.crossJoin(F.broadcast(sums)).select("token", weight.alias("weight"))
    known = tokens.where(F.col("fit").isNull()).join(weights, "token").groupBy("host", "path").agg(F.sum(F.col("m") * F.col("weight")).alias("evidence"))
    start = F.log((F.col("docs_b") + 1) / (F.col("docs_a") + 1))
    score = F.coalesce(F.col("evidence"), F.lit(0.0)) + F.coalesce(start, F.lit(0.0))
    # One row per distinct url; the many rows of a hot one meet it in a join that can be split.
    scored = urls.where(F.col("fit").isNull()).select("host", "path").join(known, ["host", "path"], "left").crossJoin(F.broadcast(prior)).select("host", "path", score.alias("score"))
    out = rows.join(scored, ["host", "path"], "left")
    verdict = F.when(F.col("fit").isNotNull(), F.col("fit.verdict")).when(F.round("score", 9) > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
