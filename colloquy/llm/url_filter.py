"""URL verdicts by rules, and by trust and distrust spread over the links between hosts.

A rule decides the urls it fits. The others follow their host: trust spreads from hosts
with allowed urls along links (a personalised PageRank), distrust from hosts with blocked
urls against them, so that who links to blocked hosts is distrusted. Both start with the
share of a host's pages that rules allow or block, and a host is blocked when more than a
threshold of what reached it is distrust. That share does not shrink where many hosts link to
one, as the distrust that each of them receives does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import doc_column, lookup, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Part of a score that is passed on, rounds, and the share of distrust above which a host is blocked.
DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 0.5
#: Distrust beyond what rounding may leave.
LEAST = 1e-12

#: Host and path after the first ``://``.
ABSOLUTE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)"""


def url_host(url: Column) -> Column:
    """Host of an absolute url with A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, ABSOLUTE, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, ABSOLUTE, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains of it."""

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")

    longest = sorted((rule for rule, _ in rules), key=lambda rule: (-len(rule), rule))
    return F.coalesce(*[F.when(fits(rule), F.lit(rule)) for rule in longest])


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, links`` between hosts, from ``host, html``; links without a host stay on theirs.

    Every host links to itself once besides, so that none is without links.
    """
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("href")
    found = pages.select("host", target)
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    onward = F.when(full.rlike(r"(?i)^https?://"), url_host(full))
    onward = onward.when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None)).otherwise(F.col("host"))
    links = found.select(F.col("host").alias("src"), onward.alias("dst"), F.lit(1).cast("long").alias("n"))
    own = pages.select("host").distinct().select(
        F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1).cast("long").alias("n")
    )
    return links.filter("dst <> ''").unionByName(own).groupBy("src", "dst").agg(F.sum("n").alias("links"))


def host_scores(links: DataFrame, seeds: DataFrame, damping: float, rounds: int) -> DataFrame:
    """``host, trust, distrust`` after ``rounds``, from ``src, dst, links`` and ``host, good, bad``."""
    links = stored(links, "url-links")
    out = links.groupBy(F.col("src").alias("host")).agg(F.sum("links").alias("sent"))
    back = links.groupBy(F.col("dst").alias("host")).agg(F.sum("links").alias("received"))
    hosts = out.join(back, "host", "full").join(seeds, "host", "full").na.fill(0.0, ["good", "bad"])
    hosts = stored(hosts, "url-hosts")
    scores = stored(hosts.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")), "url-scores")
    for _ in range(rounds):
        # Each score is divided among the links it leaves by; sums combine before the shuffle.
        rates = stored(
            scores.join(lookup(hosts.select("host", "sent", "received")), "host").select(
                "host", (F.col("trust") / F.col("sent")).alias("t"), (F.col("distrust") / F.col("received")).alias("d")
            ),
            "url-rates",
        )
        rates = lookup(rates)
        forward = links.join(rates, links.src == rates.host).select(
            F.col("dst").alias("host"), (F.col("t") * F.col("links")).alias("trust"), F.lit(0.0).alias("distrust")
        )
        reverse = links.join(rates, links.dst == rates.host).select(
            F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("d") * F.col("links")).alias("distrust")
        )
        sums = forward.unionByName(reverse).groupBy("host").agg(
            F.sum("trust").alias("trust_in"), F.sum("distrust").alias("distrust_in")
        )
        scores = stored(
            hosts.join(sums, "host", "left").select(
                "host",
                ((1 - damping) * F.col("good") + damping * F.coalesce("trust_in", F.lit(0.0))).alias("trust"),
                ((1 - damping) * F.col("bad") + damping * F.coalesce("distrust_in", F.lit(0.0))).alias("distrust"),
            ),
            "url-scores",
        )
    return scores


def url_verdicts(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    carry: bool = False,
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict`` (and ``doc``).

    ``rule`` is the longest that fits, else null. Without a rule the verdict is that of the
    host, block above ``threshold`` of its scores being distrust; hosts that nothing reaches, and urls
    without a host, are allowed. A null page has
    no links; repeated pages count as often as they occur.
    """
    verdict = reduce(lambda e, pair: e.when(F.col("rule") == pair[0], pair[1]), rules, F)
    judged = pages.select(
        F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"),
        F.col(html_col).alias("html"), *doc_column(carry),
    ).withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("ruled", verdict)
    named = judged.filter("host <> ''")
    seeds = named.groupBy("host").agg(
        F.avg((F.coalesce("ruled", F.lit("")) == "allow").cast("double")).alias("good"),
        F.avg((F.coalesce("ruled", F.lit("")) == "block").cast("double")).alias("bad"),
    )
    scores = host_scores(host_links(named.select("host", "html")), seeds, damping, rounds)
    blocked = stored(
        scores.filter((F.col("distrust") > LEAST) & (F.col("distrust") > threshold * (F.col("distrust") + F.col("trust")))).select(
            "host", F.lit("block").alias("spread")
        ),
        "url-blocked",
    )
    return judged.drop("html").join(lookup(blocked), "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"),
        *(["doc"] if carry else []),
    )
