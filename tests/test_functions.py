"""Edge cases of the column functions, with literal inputs."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.functions import features as E
from mailsieve.functions import headers as H
from mailsieve.functions import text as X
from mailsieve.functions import urls as U
from mailsieve.operators import encoders as N

SINHALA, TAMIL = "ගිණුම", "கணக்கு"


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_whitespace_class_is_the_unicode_one(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert set(V.WS_CHARS) == set(spaces)
    assert values(spark, [f"a{s}{s}b{s}" for s in spaces], X.clean_basic) == ["a b"] * len(spaces)


def test_clean(spark):
    assert values(spark, [None, "", " a\r\n b\xa0c ", "<p>x</p>y"], X.clean_basic) == ["", "", "a b c", "<p>x</p>y"]
    assert values(spark, [None, "<p>x</p>y", "a < b > c", "1 < 2", "<>"], X.clean_html) == ["", "x y", "a c", "1 < 2", "<>"]


def test_normalize_masks_addresses_before_urls(spark):
    texts = ["Mail A.B@X.org or HTTP://x.y/z.", "http://user@host.com/tail rest", "no marks", "a <\nb> c"]
    assert values(spark, texts, X.normalize_for_model) == [
        "mail <EMAIL> or <URL>", "http:// <EMAIL> /tail rest", "no marks", "a c",
    ]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="abc <>@@..:/\n\t\xa0wWé-_%+" + SINHALA, max_size=60), min_size=400, max_size=500))
def test_clean_and_normalize_against_plain_python(spark, texts):
    def clean(t):
        return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", t)).strip()

    def normalize(t):
        t = clean(t).lower()
        t = re.sub(r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", " <EMAIL> ", t)
        t = re.sub(r"(?i)\b(?:https?://|hxxps?://|hxxp?://|www\.)[^\s<>\"']+", " <URL> ", t)
        return re.sub(r"\s+", " ", t).strip()

    assert values(spark, texts, X.clean_html) == [clean(t) for t in texts]
    assert values(spark, texts, X.normalize_for_model) == [normalize(t) for t in texts]


def test_urls(spark):
    texts = [
        "see (https://a.b/c), HXXPS://x[.]y/login! www.z.org.", "xhttp://no http://", None, "hxx://old https://\"q\"",
    ]
    assert values(spark, texts, lambda c: E.extract_urls(F.coalesce(c, F.lit("")))) == [
        ["https://a.b/c", "HXXPS://x[.]y/login", "www.z.org"], [], [], ["hxx://old"],
    ]
    serving = values(spark, texts, lambda c: E.extract_urls(F.coalesce(c, F.lit("")), X.SERVING))
    assert serving[3] == []


def test_entropy(spark):
    def plain(t):
        if not t:
            return 0.0
        return round(-sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)), 4)

    texts = ["", "a", "aaaa", "ab", "hello world", f"{SINHALA} mixed {TAMIL}", "the quick brown fox" * 50, "\U0001f600a\U0001f600"]
    assert values(spark, texts, E.entropy) == [plain(t) + 0.0 for t in texts]


def test_language(spark):
    texts = [f"a {SINHALA}", f"a {TAMIL}", SINHALA, TAMIL, "abc", "123 é", f"{SINHALA} {TAMIL}", f"{SINHALA} {TAMIL} a"]
    assert values(spark, texts, E.detect_language) == [
        "CodeMixed_Sinhala_English", "CodeMixed_Tamil_English", "Sinhala", "Tamil", "English", "Unknown", "Sinhala",
        "CodeMixed_Sinhala_English",
    ]


def test_keywords_are_substrings(spark):
    assert values(spark, ["expired accounts"], lambda c: E.keyword_count(c, V.SERVING_KEYWORDS)) == [3]
    assert values(spark, ["expired accounts"], E.detected_keywords) == [["account", "expire", "expired"]]


def test_coerce(spark):
    inputs = ["3.0", "x", None, "-2.7", " 4 ", "1e3"]
    assert values(spark, inputs, E.coerce_int) == [3, 0, 0, -2, 4, 1000]
    assert values(spark, inputs, E.coerce_double) == [3.0, 0.0, 0.0, -2.7, 4.0, 1000.0]


def test_weighted_score(spark):
    urls = [
        "hxxps://bank-a[.]test/login", "https://paypai.com", "http://u@1.2.3.4/x", "https://a-b-c-d.test",
        "https://" + "a" * 41 + ".test", "https://xn--80ak.com/", "https://ok.test", "nothing",
        "hxxp://bank[dot]test/", "HXXP://A(.)b",
    ]
    got = values(spark, urls, lambda c: U.weighted_url_reports(F.array(c))[0])
    assert [r["score"] for r in got] == [60, 25, 30, 10, 10, 30, 0, 0, 50, 40]
    assert [r["risk"] for r in got] == [
        "High", "Suspicious", "Suspicious", "Low", "Low", "Suspicious", "Low", "Low", "High", "Suspicious",
    ]
    assert got[0]["normalized_url"] == "https://bank-a.test/login"
    assert got[0]["reasons"][1] == "The URL contains suspicious words: login, bank"
    assert got[2]["domain"] == "u@1.2.3.4"
    assert got[7]["domain"] == got[8]["domain"] == "Unknown"
    assert got[6]["reasons"] == ["No major suspicious URL pattern was detected."]


def test_point_score(spark):
    urls = ["http://bit.ly/x", "hxxps://login.a.b.c.test/verify", "https://10.0.0.1:8080/", "https://ok.test", "HXXP://a.test"]
    got = values(spark, urls, lambda c: U.point_url_reports(F.array(c))[0])
    assert [(r["domain"], r["score"], r["risk"]) for r in got] == [
        ("bit.ly", 4, "Suspicious"), ("login.a.b.c.test", 5, "Suspicious"), ("10.0.0.1", 4, "Suspicious"),
        ("ok.test", 0, "Safe"), ("a.test", 2, "Low"),
    ]


def test_ip_addresses(spark):
    import ipaddress

    def plain(t):
        try:
            ipaddress.ip_address(t)
            return True
        except ValueError:
            return False

    hosts = [
        "1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "::1", "::", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "a.b",
        "1::2::3", "fe80::", "12345::", "", "1:2:3:4:5:6:7::",
        "::ffff:1.2.3.4", "1::2:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "fe80::1%eth0", "::%", "1.2.3.4%x",
    ]
    assert values(spark, hosts, U.is_ip_address) == [plain(h) for h in hosts]


def test_addresses(spark):
    headers = ['"Doe, J" <J.Doe@X.Org>', "a@b.c", "a@b.c (Ann)", "<x@y>", "", None, "no address here"]
    assert values(spark, headers, H.address_of) == ["j.doe@x.org", "a@b.c", "a@b.c", "x@y", "", "", ""]
    assert values(spark, headers, H.display_name_of) == ["Doe, J", "", "Ann", "", "", "", ""]
    listed = values(spark, ['"Doe, J" <j@x>, , b@c'], H.address_list)[0]
    assert [tuple(a) for a in listed] == [("Doe, J", "j@x"), ("", "b@c")]
    assert values(spark, ["a@b@C.d", "none", "x@[1.2.3.4]"], H.domain_of_address) == ["c.d", "", "1.2.3.4"]


def test_addresses_against_the_standard_library(spark):
    from email.utils import getaddresses

    headers = [
        "Ann Lee <ann@x.org>", '"Lee, Ann" <Ann@X.org>', " ann@x.org ", "ann@x.org (Ann Lee)", "undisclosed-recipients:;",
        "a@b, c@d", "Team: a@b, Bo <c@d>;", "mailto:ann@x.org", "ann @ x.org", "Ann <ann@x.org", "Foo (bar) <f@x>", "<>", "",
        "J\u00fcrgen <j@x.de>, O'Neil <o@x>", "Ann<ann@x.org>",
    ]
    want = [[(n.strip(), a.strip().lower()) for n, a in getaddresses([h]) if a.strip()] for h in headers]
    assert [[tuple(a) for a in v] for v in values(spark, headers, H.address_list)] == want


def test_authentication(spark):
    texts = ["spf=pass", "mx; SPF = SoftFail", "xspf=pass", "", None]
    assert values(spark, texts, lambda c: H.auth_result(c, "spf")) == ["pass", "softfail", "unknown", "unknown", "unknown"]
    assert values(spark, ["Neutral (x) fail", "failure", None], lambda c: H.spf_result(F.lit(""), c)) == [
        "neutral", "unknown", "unknown",
    ]


def test_attachments(spark):
    names = ["a.pdf.exe", "a.XLSM", "a.tar.gz", "a.pdf.zip", "photo.jpg", ".bashrc", "noext", "x.txt.", None]
    assert values(spark, names, H.file_extension) == [".exe", ".xlsm", ".gz", ".zip", ".jpg", "", "", "", ""]
    assert values(spark, names, H.attachment_risk) == [
        "Critical", "High", "Medium", "Critical", "Low", "Low", "Low", "Low", "Low",
    ]
    assert len(values(spark, names, H.attachment_warnings)[0]) == 2


def test_split_subject(spark):
    texts = ["From: x\n\nSUB -  Hi  there \nBody\n\n two", "to: a\nab\nFirst line\nrest", "to: a\nab", "", None]
    got = [(r["subject"], r["body"], r["warning"][:7]) for r in values(spark, texts, X.split_subject)]
    assert got == [
        ("Hi there", "Body\ntwo", ""), ("First line", "rest", "subject"), ("", "to: a\nab", "subject"),
        ("", "", "no read"), ("", "", "no read"),
    ]


def test_html_to_text(spark):
    pages = [
        "<p>a</p><b>b</b>c<br>d", "x<script>if (a<b) {}</script>y<style>p{}</style>z", "1 &lt; 2 &amp;amp; &#39;q&#x27; &nbsp;e",
        "<a title='x > y'>t</a>", "a <!-- <p> --> b", "<script>open", None, "<pre>k</pre><header>h</header>", "&#1114112;!",
    ]
    assert values(spark, pages, X.html_to_text) == [
        "a\nbc\nd", "xyz", "1 < 2 & 'q' e", "t", "a b", "", "", "k\nh", "�!",
    ]


def test_html_to_text_survives_many_quotes(spark):
    page = "<a " + "'x' " * 20_000 + ">t</a>" + "<" * 5_000
    assert values(spark, [page], X.html_to_text)[0].startswith("t")


def test_hostile_texts_take_linear_time(spark):
    import time

    n = 300_000
    texts = ["<" * n, "a." * n + "@", "@" + "a." * n, "<a '" * n, "<!" * n, "a@" * n, " \n" * n + "x", "1-" * n + "@b", "x" * n + "@a.bc", "<script " * n, "<style>" * n, "<script>a</scrip" * n, "</script " * n, "&#" + "0" * n]
    start = time.time()
    values(spark, texts, lambda c: F.length(X.normalize_for_model(c)))
    values(spark, texts, lambda c: F.length(X.html_to_text(c)))
    many = ",".join(f'"A, {i}" <u{i}@x.test>' for i in range(20_000))
    assert len(values(spark, [many], H.address_list)[0]) == 20_000
    assert time.time() - start < 60


def test_addresses_in_odd_places(spark):
    import re

    texts = ["--a@b.co", "éabc.def@x.co", "a_b@c.dd.e", "_@x.yz", ".@x.yz", "a@b@c.de", "x@-.aa", "a@b.c1 a@b.cd", "%a@b.co.", "é@b.co"]
    pattern = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
    assert values(spark, texts, X.mask_addresses) == [re.sub(pattern, " <EMAIL> ", t) for t in texts]


def test_character_grams(spark):
    def plain(text, low=3, high=5):
        out = []
        for w in text.split():
            w = f" {w} "
            for n in range(low, high + 1):
                windows = [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
                out += windows
                if len(windows) == 1:
                    break
        return sorted(out)

    texts = ["a", "ab", "abc de  f", "hello <URL> world", "", f"{SINHALA} ok"]
    assert [sorted(v) for v in values(spark, texts, N.char_wb_grams)] == [plain(t) for t in texts]


def test_keywords_shared_between_lists():
    assert set(V.TRAINING_KEYWORDS) <= set(V.SERVING_KEYWORDS)
    assert (len(V.TRAINING_KEYWORDS), len(V.SERVING_KEYWORDS)) == (21, 29)


def test_empty_mail_is_dropped(spark):
    df = spark.createDataFrame([(1, None, " "), (2, "", "x")], "id int, subject string, body string")
    assert [r["id"] for r in E.build_features(df).collect()] == [2]


def test_round_even(spark):
    got = spark.sql("select explode(array(0.125D, 0.375D, 2.5D, -0.125D)) as x").select(X.round_even(F.col("x"), 2).alias("v"))
    assert [r["v"] for r in got.collect()] == [pytest.approx(v) for v in (0.12, 0.38, 2.5, -0.12)]


def test_domains_against_the_standard_parser(spark):
    import random
    from urllib.parse import urlparse

    rng = random.Random(1)
    pieces = ["http://", "HTTPS://", "hxxp://", "hxxps://", "www.", "WWW.", "a", "b.c", "@", ":", "80", "/", "?", "#", "[.]", "(.)",
              "[", "]", "::1", "[::1]", "[v1.x]", "[::1.2.3.4]", "-", "é", "1.2.3.4", "ftp://", "1x://", "//"]
    urls = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(1500)]

    def refang(u):
        u = re.sub(r"(?i)^hxxps://", "https://", u.strip())
        u = re.sub(r"(?i)^hxxp://", "http://", u).replace("[.]", ".").replace("(.)", ".")
        return "http://" + u if u.lower().startswith("www.") else u

    def domain(u):
        try:
            return urlparse(u).netloc or "Unknown"
        except ValueError:
            return "Unknown"

    normalized = [refang(u) for u in urls]
    assert values(spark, urls, U.refang) == normalized
    got = values(spark, normalized, U.extract_domain)
    odd = [(u, g, domain(u)) for u, g in zip(normalized, got) if g != domain(u)]
    # Without a scheme the standard parser reads an authority after a leading ``//``.
    assert [o for o in odd if not o[0].startswith("//")] == []


def test_html_against_the_standard_parser(spark):
    import html
    import random
    from html.parser import HTMLParser

    class Events(HTMLParser):
        """Records (kind, value) and leaves the reading to the test."""

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.seen = []
            self.handle_starttag = lambda tag, attrs: self.seen.append(("open", tag))
            self.handle_endtag = lambda tag: self.seen.append(("close", tag))
            self.handle_data = lambda data: self.seen.append(("text", data))

    def plain(page):
        events = Events()
        events.feed(page)
        events.close()
        text, hidden = "", False
        for kind, value in events.seen:
            if kind != "text" and value in ("script", "style"):
                hidden = kind == "open"
            elif kind != "text":
                text += "\n" if value in V.BLOCK_TAGS else ""
            elif not hidden:
                text += value
        rows = (" ".join(row.split()) for row in html.unescape(text).splitlines())
        return "\n".join(row for row in rows if row)

    pieces = [
        "<p>", "</p>", "<br/>", "<b>", "</b>", "<a href='x>y'>", '<a href="q">', "text ", " &amp; ", "&lt;", "&#39;", "&#x41;",
        "&nbsp;", "\n", "<script>a<b</script>", "<style>p{}</style>", "<!-- c -->", "<!DOCTYPE html>", "< 5", "<div class=x>",
        "</div >", "<pre>", "é", "&eacute;", "&unknown;", "&middot;", "&#150;", "&#146", "&#0;", "&#1;", "&#128512;", "&AMP;",
        "&notit;", "&copyx", "&eacute", "&euro;", "&amp;eacute;", "&amp;#65;", "&;", "&#;", "<LI>", "<tr><td>1</td></tr>", "<svg/>",
    ]
    rng = random.Random(3)
    pages = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    assert values(spark, pages, X.html_to_text) == [plain(p) for p in pages]


def test_entities_as_the_standard_library_reads_them(spark):
    from html import unescape

    texts = [
        "https&colon;&sol;&sol;evil&period;test&sol;login", "&#00000065;&#x0000041;&#65", "&NewLine;|&Tab;|&nvlt;|&CounterClockwiseContourIntegral;",
        "&#0;&#x110000;&#99999999999999999999;&#xD800;&#xFDD0;&#x1FFFE;&#128;&#x9f;", "&ampx &notit; &notin; &bogus; &#; &#x; &", "&lt;&#60;&amp;lt;",
    ]
    once = [unescape(t) for t in texts]
    assert values(spark, texts, X.decode_entities) == [unescape(t) for t in once]


def test_elements_without_an_end(spark):
    texts = ["a<script>b", "a<script>b</script>c", "a<script x", "a<style>b>c</style >d<script>e>f", "x<script>a</scripty>b</script>c", "<script>\x00\uffff</script>t"]
    assert values(spark, texts, X.html_to_text) == ["a", "ac", "a<script x", "ad", "xc", "t"]


def test_entropy_of_a_large_alphabet(spark):
    import math
    import time
    from collections import Counter

    texts = ["".join(chr(0x4E00 + i % n) for i in range(60_000)) for n in (1, 7, 20_000)] + ["aab", "Zz9 e", ""]
    start = time.time()
    got = values(spark, texts, E.entropy)
    assert time.time() - start < 30
    for text, value in zip(texts, got):
        shares = [k / len(text) for k in Counter(text).values()]
        assert value == round(-sum(p * math.log2(p) for p in shares) + 0.0, 4)


def test_numbers_in_text(spark):
    texts = ["1.5", " -2e3 ", "12d", "1.5F", "NaN", "nan", "+.5", "3.", "", "1 2", "0x1", None]
    assert values(spark, texts, E.coerce_double) == [1.5, -2000.0, 0.0, 0.0, 0.0, 0.0, 0.5, 3.0, 0.0, 0.0, 0.0, 0.0]
    assert values(spark, texts, E.coerce_int) == [1, -2000, 0, 0, 0, 0, 0, 3, 0, 0, 0, 0]
    numbers = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in numbers.select(E.coerce_double(F.col("x"))).collect()] == [1.0, 0.0, 0.0]
