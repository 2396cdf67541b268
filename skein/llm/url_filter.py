"""URL filters: rules, and behind them empirical-Bayes reputations of hosts.

Labelled page outcomes are counted by host. The rate of bad pages is shrunk along suffix, registered domain, host: the
posterior of each level is the beta prior of the next, worth as many pages as the spread between its members says
(method of moments). A host is blocked when the lower bound of its rate, a quantile of its beta posterior, is above a limit.
Only counts move: partial sums by host, then by domain and suffix. The pages meet one row per host: all hosts are broadcast
up to a stated number, beyond it those of many pages, so that no host's pages meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.durable import durable

#: Hosts that are broadcast to their pages at most.
BROADCAST = 200_000
#: Labels below a country's two letters that stand for a suffix of two labels, as in co.uk.
SECOND = ("ac", "co", "com", "edu", "gov", "mil", "net", "org")

#: (host and path prefix, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end; A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def site_of(host: Column) -> Column:
    """The host that has a reputation: without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(site: Column) -> Column:
    """The last label; the last two where a common second label stands before a country's two letters."""
    two = F.regexp_extract(site, rf"(?:^|\.)((?:{'|'.join(SECOND)})\.[a-z]{{2}})$", 1)
    return F.when(two != "", two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column) -> Column:
    """The registered domain: the suffix and the label before it; an address of numbers is its own."""
    labels = F.size(F.split(suffix_of(site), r"\.")) + 1
    return F.when(site.rlike("^[0-9.]+$"), site).when(labels == 3, F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(rate <= x) of beta posteriors, by the continued fraction of the incomplete beta function (modified Lentz)."""
    from math import lgamma

    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    front = np.array([lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(a.tolist(), b.tolist(), strict=True)])
    with np.errstate(divide="ignore"):
        front = np.exp(front + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones(len(x)), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 20_000):
        old = h.copy()
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(h - old) <= 1e-14 * np.abs(h)):
            break
    out = np.clip(front * h, 0.0, 1.0)
    return np.where(swap, 1 - out, out)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rate below which a posterior has the part ``p``, by halving."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(50):
        mid = (low + high) / 2
        below = beta_cdf(mid, a, b) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def _strength(groups: DataFrame, parent: str | None) -> float:
    """Pages that a parent's rate is worth for its members, by the method of moments; 1 to 1000, 10 if it can't be told.
    Without a parent column all groups have one parent."""
    if parent is None:
        whole = groups.agg(F.sum("n").alias("pn"), F.sum("bad").alias("pb")).first()
        j = groups.filter("n > 0").withColumn("p", F.lit(((whole.pb or 0) + 0.5) / ((whole.pn or 0) + 1)))
    else:
        g = groups.groupBy(parent).agg(F.sum("n").alias("pn"), F.sum("bad").alias("pb")).filter("pn > 0").withColumn("p", (F.col("pb") + 0.5) / (F.col("pn") + 1))
        j = groups.filter("n > 0").join(g, groups[parent].eqNullSafe(g[parent]))
    m = j.agg(F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col("p")) ** 2 / (F.col("p") * (1 - F.col("p")))).alias("s"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q")).first()
    if not m.k or m.k < 2 or m.t <= m.k:
        return 10.0
    rho = (m.s - (m.k - 1)) / max(m.t - m.q / m.t - (m.k - 1), 1e-9)
    return float(min(1000.0, max(1.0, 1 / rho - 1))) if rho > 0 else 1000.0


def reputations(hosts: DataFrame, tail: float = 0.05) -> DataFrame:
    """site, n, bad, rate, low (the posterior's ``tail`` quantile) from site, n (labelled pages), bad (of these).

    With no labelled pages at all every rate is the flat prior's, one half, of strength 2.
    """
    hosts = durable(hosts.select("site", "n", "bad", domain_of(F.col("site")).alias("domain"), suffix_of(F.col("site")).alias("suffix")))
    domains = durable(hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("suffix").alias("suffix")))
    suffixes = durable(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    root = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    mean = ((root[1] or 0) + 1) / ((root[0] or 0) + 2)
    k_suffix, k_domain, k_host = _strength(suffixes, None), _strength(domains, "suffix"), _strength(hosts, "domain")
    suffixes = suffixes.select(F.col("suffix").alias("of"), ((F.col("bad") + k_suffix * mean) / (F.col("n") + k_suffix)).alias("prior"))
    domains = domains.join(suffixes, domains.suffix.eqNullSafe(suffixes["of"])).select(F.col("domain").alias("in_domain"), ((F.col("bad") + k_domain * F.col("prior")) / (F.col("n") + k_domain)).alias("prior"))
    a = F.col("bad") + k_host * F.col("prior")
    b = F.col("n") - F.col("bad") + k_host * (1 - F.col("prior"))
    out = hosts.join(domains, hosts.domain.eqNullSafe(domains.in_domain)).select("site", "n", "bad", a.cast("double").alias("a"), b.cast("double").alias("b"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("site", "n", "bad")), pa.array(a / (a + b)), pa.array(beta_quantile(tail, a, b))], ["site", "n", "bad", "rate", "low"])

    return out.mapInArrow(bound, "site string, n long, bad long, rate double, low double")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = 0.25, tail: float = 0.05, id_col: str = "page_id", url_col: str = "url", broadcast_hosts: int = BROADCAST) -> DataFrame:
    """page_id, host, path, rule, verdict, host_rate, host_low of every page row.

    ``outcomes``: (host, n, bad) rows, counted already or not. The verdict is the longest fitting rule's; without one a
    page is blocked if its host's lower bound is above ``limit``. A null url, or one without ://, has an empty host and
    path, and an outcome like any other host. Hosts without outcomes are allowed. Hosts that differ in user or port share one
    reputation. Repeated rows are judged each; an empty table gives no rows; other columns play no part.
    """
    url = F.col(f"`{url_col}`")
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("site", site_of(F.col("host")))
    rep = reputations(outcomes.groupBy(site_of(F.col("host")).alias("site")).agg(F.sum("n").cast("long").alias("n"), F.sum("bad").cast("long").alias("bad")), tail)
    rep = durable(rep.filter("site is not null").select(F.col("site").alias("rep_site"), "rate", "low"))
    if rep.count() <= broadcast_hosts:
        out = p.join(F.broadcast(rep), p.site == rep.rep_site, "left")
    else:
        # hosts of so many pages that there can't be more of them than are broadcast
        often = p.groupBy("site").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > pages.count() // max(broadcast_hosts, 1))
        hot = durable(rep.join(often.select(F.col("site").alias("rep_site")), "rep_site"))
        hot_only = F.broadcast(hot.select(F.col("rep_site").alias("hot_site")))
        rest = p.join(hot_only, p.site == F.col("hot_site"), "left_anti")
        out = p.join(F.broadcast(hot), p.site == hot.rep_site).unionByName(rest.join(rep, rest.site == rep.rep_site, "left"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for name, verdict in rules:
        by_rule = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(by_rule)
    by_host = F.when(F.col("low") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("rule", rule).select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"), F.col("rate").alias("host_rate"), F.col("low").alias("host_low"))


def page_outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, n, bad) of pages whose path names a labelled document, /language/number; bad: quality 0. One outcome per
    document and page row; of a document's several labels the worst counts. Hosts without labels have n = 0.
    Pages are counted by host and number before they meet the labels, and pages without a number don't meet them."""
    url = F.col(f"`{url_col}`")
    named = F.expr(f"try_cast(regexp_extract(`{url_col}`, '^[^?#]*/[a-z]{{2}}/([0-9]{{1,18}})', 1) as bigint)")
    ids = durable(pages.select(host_of(url).alias("host"), named.alias("named")).groupBy("host", "named").agg(F.count(F.lit(1)).alias("k")))
    worst = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("named")).agg(F.max(F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0)).alias("is_bad")).filter("is_bad is not null")
    told = ids.filter("named is not null").join(worst, "named").select("host", F.col("k").alias("n"), (F.col("k") * F.col("is_bad")).alias("bad"))
    none = ids.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    return told.unionAll(none).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


#: The columns that the contract states; a page without a rule has the method's verdict, which SQL doesn't express.
EXACT = r"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r AS (SELECT * FROM (VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')) AS t(name, start, rule, verdict))
SELECT page_id, host, path, (SELECT rule FROM r WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) ORDER BY length(rule) DESC LIMIT 1) AS rule FROM h
"""
