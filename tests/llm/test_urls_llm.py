"""URL filter against plain Python."""

import math
import re

import pytest

from mailsieve.llm import urls
from mailsieve.llm.queries import URL_RULES, op6_host_segmentation

from .helpers import rows_of

PAGES = "page_id bigint, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_for(host, path, rules):
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/1?x=/y#z", "https://example.com/de", "https://example.com/de/", "HTTP://ÉX.org/fr/ü",
    "http://x.net", "http://x.net/", "http://net/", "http://internet/", "http://x.org?fr/", "http://x.org/fr/\nq", "a://b://c/d", "http://h\n.net/x",
    "http://example.net/en/", "http://badexample.net/en/", "https://www.cheap-pills.example.com/en/1", "https://blog.museum.example.com/x/1",
]


def frame(spark, found=URLS):
    return spark.createDataFrame([(i, u, "<p>the cheap pills blog museum</p>") for i, u in enumerate(found)], PAGES)


def test_hosts_paths_and_rules(spark):
    for r in urls.judge(frame(spark), URL_RULES).collect():
        host, path = parts(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert r.rule == rule_for(host, path, URL_RULES)
        if r.rule:
            assert r.verdict == URL_RULES[r.rule]
        elif not host:
            assert r.verdict == "allow" and r.log_odds is None


def test_defined_results(spark):
    rows = [(None, None, None), (1, "http://x.net/", None), (1, "http://x.net/", None)]
    out = urls.judge(spark.createDataFrame(rows, PAGES), URL_RULES)
    assert sorted(((r.page_id, r.verdict) for r in out.collect()), key=repr) == sorted([(None, "allow"), (1, "block"), (1, "block")], key=repr)
    assert urls.judge(spark.createDataFrame([], PAGES), URL_RULES).collect() == []
    clash = frame(spark).selectExpr("*", "1 as host", "2 as path", "3 as id", "4 as words", "5 as verdict")
    assert rows_of(urls.judge(clash, URL_RULES)) == rows_of(urls.judge(frame(spark), URL_RULES))
    none = urls.judge(frame(spark, ["http://some.org/"]), {}).collect()
    assert [(r.verdict, r.log_odds) for r in none] == [("allow", None)]
    with pytest.raises(ValueError):
        urls.judge(frame(spark), {f"h{i}/": "block" for i in range(300)})


def test_segmentation_is_the_cheapest_split():
    counts = {"cheap": 50, "pills": 30, "he": 90, "ap": 5, "news": 40, "new": 60, "s": 2, "spaper": 1}
    s = urls.Segmenter(counts)

    def cost(words):
        return sum(s.cost.get(w, s.unknown[len(w)]) for w in words)

    def splits(run):
        if not run:
            yield []
        for n in range(1, len(run) + 1):
            for rest in splits(run[n:]):
                yield [run[:n], *rest]

    for run in ("cheappills", "newspaper", "xqcheap", "pillsnew", "zzz", "a"):
        assert math.isclose(cost(s.split(run)), min(map(cost, splits(run))))
    assert s.split("cheappills") == ["cheap", "pills"]
    assert s.tokens("cheappills12.com", "/News/2020") == ["h:cheap", "h:pills", "h:#", "h:com", "p:news", "p:#"]
    assert len(s.split("x" * 5000)) >= 250


def test_odds_are_those_of_multinomial_bayes(spark):
    bins, rules = 1 << 12, URL_RULES
    out = urls.judge(frame(spark), rules, bins=bins).collect()
    table = {v: [1.0] * bins for v in ("allow", "block")}
    pages = {"allow": 0, "block": 0}
    seed = max(1.0, 0.02 * sum(bool(r.rule) for r in out))
    for v, words in urls.SEEDS.items():
        for w in words.split():
            table[v][urls.bin_of("h:" + w, bins)] += seed
    for r in out:
        if r.rule:
            pages[rules[r.rule]] += 1
            for w in r.words:
                table[rules[r.rule]][urls.bin_of(w, bins)] += 1
    sums = {v: sum(t) for v, t in table.items()}
    for r in out:
        if r.host:
            odds = math.log(pages["allow"] / pages["block"])
            for w in r.words:
                b = urls.bin_of(w, bins)
                odds += math.log(table["allow"][b] / sums["allow"]) - math.log(table["block"][b] / sums["block"])
            assert math.isclose(r.log_odds, odds, abs_tol=1e-9)
            if r.rule is None:
                assert r.verdict == ("allow" if odds >= 0 else "block")


def test_query(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op6_host_segmentation(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.host, r.path) == parts(pages[r.page_id]) and r.rule == rule_for(r.host, r.path, URL_RULES)
    assert {r.verdict for r in rows} == {"allow", "block"}


def test_open_tags_take_linear_time(spark):
    import time

    from mailsieve.llm import urls

    pages = spark.createDataFrame([(1, "http://a.test/", "<" * 1_000_000 + " word"), (2, "http://b.test/", "<b>bold</b> <i word<" * 1000)], "page_id bigint, url string, html string")
    start = time.time()
    counts = urls.word_counts(pages, "html", 100)
    assert time.time() - start < 20
    assert counts == {"word": 2, "bold": 1000, "i": 1}  # only the last "<i word<" is not closed
