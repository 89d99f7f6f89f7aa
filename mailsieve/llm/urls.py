"""URL filter: rules by host and path, and a naive Bayes score of segmented words for all other pages.

Hosts and paths come from built-in expressions, and so do the rules: the longest rule whose host is the page's host or a
parent domain and whose path begins the page's path decides. What no rule decides goes to the method:

* Words: the ``max_words`` most frequent words of the pages' own texts (tags left out) make a unigram model.
* Segmentation: each host label and each run of letters in the path is split by Viterbi over that model. A stretch of up to
  ``longest`` letters that is no known word costs as much as a rare one. Runs of digits become one mark.
* Multinomial naive Bayes with one pseudo count per token and class, fitted on the pages that a rule decides and on a
  small table of host words (``SEEDS``, each as ``seed_pages`` pages); tokens fall into ``bins`` hash bins, so counts and
  model have a fixed size at any number of distinct words. Ties are allowed pages.

Defined results: an URL that is null or has no ``://`` has empty host and path; an empty host, or a table without pages
that a rule decides, gives ``allow`` with null log odds; rows with the same or null ids are judged one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.frequent import most_frequent
from mailsieve.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUNS = re.compile(r"[^\W\d_]+|\d+")
MAX_RULES = 200
#: Host words that the fit knows from the start.
SEEDS = {
    "block": "bet casino cheap click crack farm free hack loan lottery pill pills poker porn replica spam viagra warez win xxx",
    "allow": "archive blog city club docs forum help journal library mail museum news press school science shop support uni weather wiki",
}


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, written as host and path, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # later ones go in front
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def word_counts(pages: DataFrame, html_column: str, max_words: int) -> dict[str, int]:
    """The most frequent words of the pages' texts."""
    rows = pages.select(F.coalesce(pages[html_column], F.lit("")).alias("html")).withColumn("tail", F.substring_index("html", ">", -1))
    # No tag begins behind the last ">"; to look for its end from every "<" there would take quadratic time.
    head = F.substring(F.col("html"), F.lit(1), F.length("html") - F.length("tail"))
    text = F.concat(F.regexp_replace(head, r"<[^>]*>", " "), F.col("tail"))
    words = rows.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counts = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    return dict(most_frequent(counts, max_words).collect())


class Segmenter:
    """Most likely split of a run of letters into known words."""

    def __init__(self, counts: dict[str, int], longest: int = 20, max_known: int = 50_000):
        total = sum(counts.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items() if len(w) <= longest}
        # An unknown stretch is a rare word, ten times rarer with each letter more.
        self.unknown = [math.log(total) + (n - 1) * math.log(10) for n in range(longest + 1)]
        self.longest, self.max_known, self.known = longest, max_known, {}

    def split(self, run: str) -> list[str]:
        found = self.known.get(run)
        if found is None:
            if len(self.known) >= self.max_known:
                self.known.clear()
            found = self.known[run] = self._split(run)
        return found

    def _split(self, run: str) -> list[str]:
        best, came = [0.0], [0]
        for end in range(1, len(run) + 1):
            cost, start = math.inf, end - 1
            for at in range(max(0, end - self.longest), end):
                own = self.cost.get(run[at:end], self.unknown[end - at])
                if best[at] + own < cost:
                    cost, start = best[at] + own, at
            best.append(cost)
            came.append(start)
        words, end = [], len(run)
        while end:
            words.append(run[came[end] : end])
            end = came[end]
        return words[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        """Marked words of host and path."""
        out = []
        for mark, part in (("h:", host), ("p:", path.lower())):
            for run in _RUNS.findall(part):
                out += [mark + "#"] if run[0].isdigit() else [mark + w for w in self.split(run)]
        return out


def bin_of(token: str, bins: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token) % bins


def segmented(pages: DataFrame, counts: dict[str, int], bins: int) -> DataFrame:
    """Rows of (page_id, host, path, rule, verdict) with the words of host and path and their bins."""
    shared = pages.sparkSession.sparkContext.broadcast(counts)  # max_words entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(shared.value)
        for batch in batches:
            words = [segmenter.tokens(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            places = [[bin_of(w, bins) for w in ws] for ws in words]
            yield batch.append_column("words", pa.array(words, pa.list_(pa.string()))).append_column("places", pa.array(places, pa.list_(pa.int32())))

    kind = pages.schema["id"].dataType.simpleString()
    return pages.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, words array<string>, places array<int>")


def fit_bayes(rows: DataFrame, bins: int, seed_share: float) -> np.ndarray | None:
    """For each bin the log odds of allow against block, and the prior odds last; null without a decided page."""
    decided = rows.filter("verdict is not null and host != ''")
    classes = {"allow": 1, "block": 1} | dict(decided.groupBy("verdict").count().collect())  # two rows at most
    if sum(classes.values()) == 2 and decided.isEmpty():
        return None
    table = np.ones((bins, 2))
    seed_pages = max(1.0, seed_share * sum(classes.values()))  # so that seeds weigh alike in tables of any size
    for verdict, words in SEEDS.items():
        for word in words.split():
            table[bin_of("h:" + word, bins), int(verdict == "allow")] += seed_pages
    counted = decided.select("verdict", F.explode("places").alias("place")).groupBy("place", "verdict").count()
    for place, verdict, n in counted.collect():  # two rows for each bin at most
        table[place, int(verdict == "allow")] += n
    logs = np.log(table / table.sum(0))
    return np.append(logs[:, 1] - logs[:, 0], math.log(classes["allow"] / classes["block"]))


def judge(
    pages: DataFrame, rules: dict[str, str], id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    max_words: int = 50_000, bins: int = 1 << 15, seed_share: float = 0.02,
) -> DataFrame:
    """One row per page: host, path, rule, verdict and the method's log odds (null where it has no say)."""
    url = pages[url_column]
    rows = pages.select(pages[id_column].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, says in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    rows = segmented(rows.withColumn("verdict", verdict), word_counts(pages, html_column, max_words), bins)
    rows = materialize(rows, "pages")
    odds = fit_bayes(rows, bins, seed_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [None if odds is None or not h else float(odds[p].sum() + odds[-1]) for h, p in zip(batch.column(1).to_pylist(), batch.column(6).to_pylist())]
            yield batch.drop_columns("places").append_column("log_odds", pa.array(scores, pa.float64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "places") + ", log_odds double"
    scored = rows.mapInArrow(run, schema)
    own = F.when(F.coalesce(F.col("log_odds"), F.lit(0.0)) >= 0, F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumn("verdict", F.coalesce("verdict", own)).withColumnRenamed("id", id_column)
