import html as stdhtml
import itertools
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from contactgrid.config import ExtractionConfig
from contactgrid.functions import emails, html, text
from contactgrid.functions.stages import run_on_columns
from contactgrid.operators import extraction as X
from contactgrid.operators import primary as P
from contactgrid.plans.contacts import site_contacts


def run(spark, url, body, config=ExtractionConfig()):
    pages = spark.createDataFrame([(1, url, body)], "page_id long, url string, html string")
    found = X.page_candidates(pages, config)
    rows = X.candidate_rows(found, config)
    findings = {r.canonical_email: r for r in X.page_findings(rows, config).collect()}
    rejected = {r.raw_candidate: r.rejection_code
                for r in X.rejected_candidates(rows, config).collect()}
    return findings, rejected, X.page_outcomes(found, config).first().outcome


def test_limits_are_checked():
    with pytest.raises(ValueError, match="INVALID_LIMIT"):
        ExtractionConfig(max_evidence_length=5)


def test_visible_and_entity_candidates(spark):
    found, _, outcome = run(spark, "https://acme.com/contact", """<p>Contact: <span>
      support&#64;acme&#46;com</span></p><div>Direct: alex.smith@acme.com</div>""")
    assert outcome == "SUCCESS" and set(found) == {"support@acme.com", "alex.smith@acme.com"}
    one = found["support@acme.com"]
    assert (one.category, one.domain_affinity) == ("ROLE_BASED", "EXACT_HOST")


def test_mailto_candidates(spark):
    found, _, _ = run(spark, "https://acme.com/", """<a href="MailTo:user1%40acme.com,
      user2@acme.com; +tag+x@acme.com?subject=Hello&body=x@y.com">Email</a>""")
    assert set(found) == {"user1@acme.com", "user2@acme.com", "+tag+x@acme.com"}
    assert {f.source_kind for f in found.values()} == {"MAILTO"}


def test_ignored_elements(spark):
    found, _, _ = run(spark, "https://acme.com/", """<style> /* fake@acme.com */ </style>
      <script> const e = "script_fake@acme.com"; </script>
      <template><span>template_fake@acme.com</span></template>
      <noscript>noscript_fake@acme.com <a href="mailto:no@acme.com">x</a></noscript>
      <!-- comment_fake@acme.com --><p>Real: real@acme.com</p><script>open@acme.com""")
    assert set(found) == {"real@acme.com"}


def test_obfuscated_candidates(spark):
    found, rejected, _ = run(spark, "https://acme.com/", """<p>contact [at] acme [dot] com</p>
      <p>sales (at) acme (dot) com</p><p>info at acme dot com</p>
      <p>We look at the dot on the screen and talk at length.</p>""")
    assert set(found) == {"contact@acme.com", "sales@acme.com", "info@acme.com"}
    assert not any("screen" in r for r in rejected)
    none, _, _ = run(spark, "https://acme.com/", "<p>a at b dot com</p>",
                     ExtractionConfig(allow_obfuscated=False))
    assert not none


def test_obfuscated_pattern_matches_a_plain_search(spark):
    plain = re.compile(
        r"\b([a-zA-Z0-9._%+-]+)\s*(?:\[at\]|\(at\)|\bat\b)\s*([a-zA-Z0-9.-]+)\s*"
        r"(?:\[dot\]|\(dot\)|\bdot\b)\s*([a-zA-Z]{2,})\b", re.IGNORECASE)
    pieces = ["info", " at ", "[at]", "(AT)", " dot ", "[dot]", "com", ".", "-", "é", " ", "x.y",
              "at", "dot", "% ", "org"]
    texts = ["".join(p) for p in itertools.islice(
        itertools.product(["a.", "info", "..b", "é.c"], pieces, ["at", " at ", "[at]"],
                          ["acme", "x-y.z "], [" dot ", "[dot]", "dot"], ["com", "c", "org.at q"]),
        0, 1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.transform(
        emails.obfuscated_candidates(F.col("t"), ExtractionConfig()),
        lambda c: c["raw_candidate"]).alias("c")).collect()
    for row in got:
        expected = [f"{m[1]}@{m[2]}.{m[3]}" for m in plain.finditer(row.t)]
        assert row.c == expected, row.t


def test_plain_pattern_matches_a_plain_search(spark):
    plain = re.compile(r"[^\s@:<>()\",;]+@[^\s@:<>()\",;]+\.[^\s@:<>()\",;]+")
    texts = ["a@b.c@d.e", "x@y.z.", ".@.", "a@@b.c", "a@b", "(a@b.co), <c@d.e>;f@g.h i@j.k",
             "@a.b", "a@b@c.d", "\"q\"@r.s", "a@.b", "a@b..c d@e.f　", "no"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.regexp_extract_all("t", F.lit(emails.PLAIN_PATTERN), 0).alias("m"))
    for row in got.collect():
        assert row.m == [m.group(0) for m in plain.finditer(row.t)], row.t


def test_long_runs_stay_linear(spark):
    blob = "x" * 300_000
    texts = [blob, blob + "@", " " * 300_000 + "a@b.co", "." * 300_000 + " at x dot com",
             "a@" + "b." * 100_000, "<a " + "x=" * 100_000, "&" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        emails.plain_candidates(F.col("t"), ExtractionConfig()).alias("a"),
        emails.obfuscated_candidates(F.col("t"), ExtractionConfig()).alias("b"),
        html.anchors(F.col("t"), 10).alias("c"))
    assert len(df.collect()) == len(texts)


def test_international_domains_and_unicode_locals(spark):
    found, rejected, _ = run(spark, "https://acme.com/",
                             "<p>info@münchen.de</p><p>münchen@acme.com</p>")
    assert set(found) == {"info@xn--mnchen-3ya.de"}
    assert rejected == {"münchen@acme.com": "INVALID_SYNTAX"}


def test_mailto_wins_over_visible_text(spark):
    found, _, _ = run(spark, "https://acme.com/",
                      '<p>Contact: info@acme.com</p><a href="mailto:info@acme.com">E</a>')
    assert found["info@acme.com"].source_kind == "MAILTO"


def test_affinity(spark):
    body = "<p>user1@sub.acme.com</p><p>user2@acme.com</p><p>user3@external.com</p>"
    found, _, _ = run(spark, "https://sub.acme.com/", body)
    assert {k: f.domain_affinity for k, f in found.items()} == {
        "user1@sub.acme.com": "EXACT_HOST", "user2@acme.com": "SAME_REGISTRABLE_DOMAIN",
        "user3@external.com": "EXTERNAL"}
    inside, rejected, _ = run(spark, "https://sub.acme.com/", body,
                              ExtractionConfig(allow_external_domains=False))
    assert "user3@external.com" not in inside
    assert rejected == {"user3@external.com": "EXTERNAL_DOMAIN_REJECTED"}


def test_rejections(spark):
    _, rejected, outcome = run(spark, "http://192.168.1.1/p",
                               "<p>a@192.168.1.1 b@192.168.1.2 c@example.com noreply@x.com</p>")
    assert rejected == {"a@192.168.1.1": "NO_PUBLIC_SUFFIX", "b@192.168.1.2": "NO_PUBLIC_SUFFIX",
                        "c@example.com": "PLACEHOLDER_DOMAIN", "noreply@x.com": "NO_REPLY_ADDRESS"}
    assert outcome == "NO_EMAILS_FOUND"
    kept, _, _ = run(spark, "https://x.com", "<p>noreply@x.com</p>",
                     ExtractionConfig(reject_no_reply=False))
    assert kept["noreply@x.com"].category == "NO_REPLY"


def test_text_before_an_open_reference_stays(spark):
    found, _, _ = run(spark, "https://shop.com/", "Write to info@shop.com, Smith&Co")
    assert set(found) == {"info@shop.com"}


def test_nothing_is_cut_unless_asked(spark):
    body = "".join(f"<p>p{i}@acme.com and x{i}@</p>" for i in range(201)) + "z" * 1_000_001
    found, _, outcome = run(spark, "https://acme.com", body)
    assert outcome == "SUCCESS" and len(found) == 201


def test_outcomes_and_evidence_length(spark):
    big = ExtractionConfig(max_html_chars=100)
    assert run(spark, "https://a.com", "<p>" + "a" * 200, big)[2] == "HTML_TOO_LARGE"
    assert run(spark, "ftp://a.com", "<p>a@b.com")[2] == "INVALID_SOURCE_URL"
    body = "<p>Reach us " + "word " * 50 + "contact@acme.com " + "more " * 50 + "</p>"
    found, _, _ = run(spark, "https://acme.com", body, ExtractionConfig(max_evidence_length=50))
    assert len(found["contact@acme.com"].snippet) <= 50


def test_entities_match_the_standard_library(spark):
    texts = ["a &amp; b &lt;x&gt; &eacute;&nbsp;z &#64;&#x41; &copy 2020 &notit; &amp;lt; &#128;",
             "&#0; &bogus; &am &ampx= &#xD800; AT&T R&D &Aacute;", "&#55555555555555;", "none", "&",
             "&&amp;&amp", "&#x1F600; &nGt; &#13; &#1;", "x&hellip;&mdash;&trade;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", text.decode_entities(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == {t: stdhtml.unescape(t) for t in texts}


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.skip = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "noscript"):
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data)


def test_visible_text_matches_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    df = run_on_columns(pages, {"html": F.col("html")}, html.visible_text_stages(),
                        ["visible_text"])
    for row in df.collect():
        parser = _Visible()
        parser.feed(row.html)
        assert row.visible_text.split() == " ".join(parser.parts).split(), row.page_id


def test_masks_hashes_and_snippets(spark):
    masks = {"john.doe@company.com": "j***e@company.com", "abc@company.com": "a*c@company.com",
             "ab@company.com": "a*@company.com", "a@company.com": "*@company.com",
             "@company.com": "***@company.com", "invalid-no-at-sign": "***", None: None}
    df = spark.createDataFrame([(m,) for m in masks], "m string")
    got = df.select("m", emails.mask_candidate(F.col("m")).alias("x")).collect()
    assert {r.m: r.x for r in got} == masks
    clean = spark.range(1).select(text.sanitize_text(F.lit(
        "Hello\r\n\t World!\x00\x1f   This is a   test.   "), 20).alias("c")).first().c
    assert clean == "Hello World! This is"


# --- primary selection -----------------------------------------------------------------------
def selection(spark, *items):
    """items: (email, affinity, category, [(url, kind, snippet, page_score)])"""
    findings = spark.createDataFrame(
        [("s", e, e.split("@")[0], e.split("@")[1], e.split("@")[1], c, a)
         for e, a, c, _ in items],
        "site string, canonical_email string, local_part string, domain string,"
        " registrable_domain string, category string, domain_affinity string")
    evidence = spark.createDataFrame(
        [("s", e, *rest, e) for e, _, _, records in items for rest in records],
        "site string, canonical_email string, source_url string, source_kind string,"
        " snippet string, page_score int, raw_candidate string")
    scored = P.score_candidates(findings, evidence, "site")
    return P.select_primary(scored, "site").first()


ONE = [("https://acme.com", "VISIBLE_TEXT", "t", 10)]
SAME, EXT = "SAME_REGISTRABLE_DOMAIN", "EXTERNAL"


def test_winner_is_independent_of_order(spark):
    items = [("contact@acme.com", SAME, "ROLE_BASED", ONE), ("info@acme.com", SAME, "ROLE_BASED", ONE),
             ("john.doe@acme.com", SAME, "PERSONAL_OR_NAMED", ONE),
             ("jobs@acme.com", SAME, "ROLE_BASED", ONE), ("noreply@acme.com", SAME, "NO_REPLY", ONE)]
    orders = itertools.islice(itertools.permutations(items), 0, 120, 23)
    results = [selection(spark, *p) for p in orders]
    winner = results[0]
    assert all(r == winner for r in results)
    assert winner.canonical_email == "contact@acme.com"
    assert winner.score == 10000 + 5012 + 200 + 10 + 10
    assert [s.name for s in winner.signals] == [
        "business_suitability", "domain_affinity", "evidence_frequency", "evidence_source_kind",
        "page_score"]
    assert sum(s.contribution for s in winner.signals) == winner.score


def test_tiers_exclude_each_other(spark):
    strong = [("https://x.com", "MAILTO", f"t{i}", 100) for i in range(9)]
    free = ("contact@gmail.com", EXT, "ROLE_BASED", strong)
    partner = ("sales@partner.com", EXT, "ROLE_BASED", strong)
    own = ("zed@acme.com", SAME, "PERSONAL_OR_NAMED", ONE)
    assert selection(spark, free, partner, own).canonical_email == "zed@acme.com"
    assert selection(spark, free, partner).canonical_email == "sales@partner.com"
    alone = selection(spark, free)
    assert alone.canonical_email == "contact@gmail.com"
    assert alone.score == 1000 + 5012 + 300 + 100 + 50


def test_ties_go_to_the_smaller_address(spark):
    two = [("b.x@acme.com", SAME, "PERSONAL_OR_NAMED", ONE),
           ("a.x@acme.com", SAME, "PERSONAL_OR_NAMED", ONE)]
    assert selection(spark, *two).canonical_email == "a.x@acme.com"


def test_site_contacts_end_to_end(spark):
    pages = spark.createDataFrame([
        (1, "s", "https://acme.com/", "<p>info@acme.com</p>"),
        (2, "s", "https://acme.com/contact", '<a href="mailto:contact@acme.com">x</a> info@acme.com'),
        (3, "t", "https://other.org/", "<p>nobody here</p>")],
        "page_id long, site string, url string, html string")
    tables = site_contacts(pages)
    row = tables.primary.first()
    assert (row.site, row.canonical_email, row.source_kind) == ("s", "contact@acme.com", "MAILTO")
    assert row.score == 15000 + 5012 + 300 + 100 + 10
    assert {(r.canonical_email, r.evidence_count) for r in tables.findings.collect()} == {
        ("info@acme.com", 2), ("contact@acme.com", 1)}
