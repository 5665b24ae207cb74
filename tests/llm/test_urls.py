"""op7: rules, and scores against brute force."""

from urllib.parse import urlsplit

import pytest

from colloquy.llm import url_filter
from tests.llm.fixtures import rows

SCHEMA = "page_id long, url string, html string, host string, rule string, trust double, src string, links int"


def table(spark, pages):
    return spark.createDataFrame([(i, u, h, "x", "y", 1.0, "z", 3) for i, u, h in pages], SCHEMA).repartition(2)


CASES = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("http://net/x", "net", "/x", "net/", "block"),
    ("http://a.net", "a.net", "", None, "block"),  # by its host, of whose pages rules block one
    ("http://a.net?x", "a.net", "", None, "block"),
    ("http://xnet/", "xnet", "/", None, "allow"),
    ("https://WWW.Example.NET/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/en", "example.net", "/en", "net/", "block"),
    ("https://myexample.net/en/1", "myexample.net", "/en/1", "net/", "block"),
    ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("https://example.com/DE/", "example.com", "/DE/", None, "block"),
    ("ftp://x.org/fr/a#b", "x.org", "/fr/a", "org/fr/", "allow"),
    ("http://x.org/a?u=http://a.net/b", "x.org", "/a", None, "allow"),
    ("://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http:///fr/", "", "/fr/", None, "allow"),
    ("http://ÀB.org/é\n/x", "Àb.org", "/é\n/x", None, "allow"),
]


def test_rules(spark):
    got = {r["page_id"]: r for r in rows(url_filter.url_verdicts(table(spark, [(n, c[0], None) for n, c in enumerate(CASES)]), rounds=2))}
    for n, (_, *want) in enumerate(CASES):
        assert [got[n][k] for k in ("host", "path", "rule", "verdict")] == want, CASES[n][0]


def test_empty_and_null_tables(spark):
    assert url_filter.url_verdicts(table(spark, []), rounds=2).count() == 0
    got = rows(url_filter.url_verdicts(table(spark, [(None, None, None)] * 3), rounds=2))
    assert [r["verdict"] for r in got] == ["allow"] * 3


LINKED = [
    (1, "http://spam.net/a", '<a href="/x">x</a>'),
    (2, "http://farm.com/a", '<a href="http://spam.net/a">x</a><A class="b" HREF=\'//spam.net/b\'>y</a>'),
    (3, "http://farm.com/b", "<a href=http://spam.net/c>x</a> <a href='mailto:me@spam.net'>"),
    (4, "http://good.org/fr/", '<a href="https://friend.com/p">x</a>'),
    (5, "http://friend.com/", '<a href="http://farm.com/">x</a><a href="http://good.org/">y</a>'),
    (6, "http://alone.com/", None),
    (6, "http://alone.com/", None),
]


def brute_scores(pages, rounds, damping=0.85):
    import re

    links, seeds = {}, {}
    for _, url, html in pages:
        host = urlsplit(url).netloc
        rule = {"spam.net": "bad", "good.org": "good"}.get(host)
        seeds.setdefault(host, []).append(rule)
        for href in re.findall(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)""", html or ""):
            if href.startswith("mailto"):
                continue
            to = urlsplit(href).netloc or host
            links[host, to] = links.get((host, to), 0) + 1
    for host in seeds:
        links[host, host] = links.get((host, host), 0) + 1
    hosts = {h for pair in links for h in pair}
    share = {h: {k: sum(r == k for r in seeds.get(h, [])) / max(1, len(seeds.get(h, []))) for k in ("good", "bad")} for h in hosts}
    trust, distrust = ({h: share[h][k] for h in hosts} for k in ("good", "bad"))
    sent = {h: sum(n for (a, _), n in links.items() if a == h) for h in hosts}
    received = {h: sum(n for (_, b), n in links.items() if b == h) for h in hosts}
    for _ in range(rounds):
        trust, distrust = (
            {h: (1 - damping) * share[h]["good"] + damping * sum(trust[a] * n / sent[a] for (a, b), n in links.items() if b == h) for h in hosts},
            {h: (1 - damping) * share[h]["bad"] + damping * sum(distrust[b] * n / received[b] for (a, b), n in links.items() if a == h) for h in hosts},
        )
    return trust, distrust


def test_scores_spread_over_links(spark):
    df = table(spark, LINKED)
    from pyspark.sql import functions as F

    hosts = df.select(url_filter.url_host(F.col("url")).alias("host"), "html")
    seeds = hosts.groupBy("host").agg(
        F.avg((F.col("host") == "good.org").cast("double")).alias("good"), F.avg((F.col("host") == "spam.net").cast("double")).alias("bad")
    )
    got = {r["host"]: (r["trust"], r["distrust"]) for r in rows(url_filter.host_scores(url_filter.host_links(hosts), seeds, 0.85, 6))}
    trust, distrust = brute_scores(LINKED, 6)
    assert set(got) == set(trust)
    for host, scores in got.items():
        assert scores == pytest.approx((trust[host], distrust[host]), abs=1e-12)


def test_who_links_to_blocked_hosts_is_blocked(spark):
    """At the registered defaults."""
    got = {(r["page_id"], r["host"]): r["verdict"] for r in rows(url_filter.url_verdicts(table(spark, LINKED)))}
    assert got[2, "farm.com"] == got[3, "farm.com"] == "block"
    assert got[6, "alone.com"] == "allow"
    # It links to a farm and to a good host, and is trusted by none.
    trust, distrust = brute_scores(LINKED, url_filter.ROUNDS)
    assert (got[5, "friend.com"] == "block") == (distrust["friend.com"] > trust["friend.com"])


@pytest.mark.parametrize("farms", [1, 5, 200])
def test_farms_of_one_blocked_host_at_registered_defaults(spark, farms):
    spam = '<a href="http://spam.net/a">x</a>'
    pages = [(0, "http://spam.net/a", None), (1, "http://good.org/fr/a", '<a href="http://friend.com/">y</a>'), (2, "http://friend.com/", spam), (3, "http://alone.com/", None)]
    pages += [(10 + n, f"http://farm{n}.com/", spam) for n in range(farms)]
    got = {r["page_id"]: r["verdict"] for r in rows(url_filter.url_verdicts(table(spark, pages)))}
    assert {got[10 + n] for n in range(farms)} == {"block"}
    assert got[0] == "block" and got[1] == got[3] == "allow"
    trust, distrust = _many(pages)
    assert (got[2] == "block") == (distrust["friend.com"] > trust["friend.com"])


def _many(pages):
    """Scores of these pages by brute force, from the seeds that the rules give."""
    return brute_scores([(i, u, h) for i, u, h in pages], url_filter.ROUNDS)
