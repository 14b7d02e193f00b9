"""Empirical-Bayes host reputation for URLs (op 6), in DataFrame functions alone.

Labelled page outcomes (1 bad, 0 good, null unknown) are counted by host.  The share of bad pages is shrunk down a chain
of beta-binomial priors: all pages -> public suffix -> registered domain -> host.  Each level's prior mean is the posterior mean
above it (suffixes by the rule of ``suffix_of``, to which a list of public suffixes can be added; ports and users don't count, addresses are their own domains); its strength comes from the spread of the level's groups around their parents (method of moments for the
intra-class correlation, kept within ``least_rho`` and ``most_rho``).  A host is blocked when the lower bound
``mean - z * sd`` of its posterior exceeds ``threshold``.

Listed rules go first: a rule is host and path; it fits its host and all subdomains if the url's path starts with
the rule's; the longest wins (ties: the first by text).

What is shuffled are counts by host (combined before); pages meet the blocked hosts alone, broadcast if there are 200,000 at most, else joined.

Rules: a null url and one without ``://`` have empty host and path, and such pages are one host; null or missing outcomes leave the
prior; with no outcomes at all nothing is blocked but by rules; repeated rows count each; a very long page is one row, held whole in the JVM; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.shared import cut, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second labels under which registries of country domains (two letters) register names; with these a suffix has two labels.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "mil", "ne", "net", "nom", "or", "org")
#: Suffixes run by companies below which each name is somebody else's site; a table of public suffixes may be given instead.
PRIVATE_SUFFIXES = ("appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "wordpress.com")
#: (verdict, host, path)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """A host without user, port, final dots, from which suffix and domain are taken."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")


def is_address(site: Column) -> Column:
    """IPv4 or bracketed IPv6: a host that is its own domain and suffix."""
    return site.rlike(r"^([0-9]{1,3}([.][0-9]{1,3}){3}|\[.*\])$")


def suffix_of(host: Column, suffixes: Sequence[str] = PRIVATE_SUFFIXES) -> Column:
    """The public suffix: the longest of ``suffixes`` that fits, else two labels where a country registers below the second, else the last label."""
    site = site_of(host)
    two, last = F.substring_index(site, ".", -2), F.substring_index(site, ".", -1)
    paired = two.rlike(f"^({'|'.join(SECOND_LEVEL)})[.][a-z]{{2}}$")
    found = F.when(is_address(site), site)
    for labels in sorted({s.count(".") + 1 for s in suffixes}, reverse=True):
        tail = F.substring_index(site, ".", -labels)
        found = found.when(tail.isin(*[s for s in suffixes if s.count(".") + 1 == labels]), tail)
    return found.when(paired, two).otherwise(last)


def domain_of(host: Column, suffixes: Sequence[str] = PRIVATE_SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it; a bare suffix and an address are their own."""
    site, suffix = site_of(host), suffix_of(host, suffixes)
    before = F.substring(site, F.lit(1), F.length(site) - F.length(suffix) - 1)
    return F.when(F.length(site) <= F.length(suffix), site).otherwise(F.concat_ws(".", F.substring_index(before, ".", -1), suffix))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), *(-ord(c) for c in r[1] + r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _strength(spread: DataFrame, key: list[str], least_rho: float, most_rho: float) -> float:
    """The pooled prior strength of groups (n, x) around the raw shares of their parents (pn, px)."""
    p = F.try_divide("px", "pn")
    inside = spread.filter("n > 0 and px > 0 and px < pn").groupBy(*key).agg(
        F.sum(F.try_divide(F.col("n") * F.pow(F.try_divide("x", "n") - p, 2), p * (1 - p))).alias("s"),
        (F.count("*") - 1).alias("df"),
        (F.max("pn") - F.try_divide(F.sum(F.col("n") * F.col("n")), F.max("pn")) - (F.count("*") - 1)).alias("room"),
    )
    rho = inside.agg((F.sum("s") - F.sum("df")) / F.nullif(F.sum("room"), F.lit(0.0))).first()[0]
    rho = min(max(least_rho if rho is None else rho, least_rho), most_rho)
    return (1 - rho) / rho


def reputation(pages: DataFrame, *, host: str = "host", outcome: str = "bad", suffixes: Sequence[str] = PRIVATE_SUFFIXES, z: float = 1.64, threshold: float = 0.5, least_rho: float = 0.01, most_rho: float = 0.9) -> DataFrame:
    """``host, n, x, mean, lower, blocked`` from the labelled outcomes of pages.

    The counts by host are computed once; the strength of each level and the overall share, four numbers, come to the driver.
    """
    counted = cut(pages.groupBy(F.col(host).alias("host")).agg(F.count(outcome).alias("n"), F.coalesce(F.sum(F.col(outcome).cast("long")), F.lit(0)).alias("x")))
    hosts = counted.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    over = lambda df: df.withColumnsRenamed({"n": "pn", "x": "px"})
    domains = total(hosts, "domain", "suffix")
    suffixes = cut(total(domains, "suffix"))
    n, x = (v or 0 for v in suffixes.agg(F.sum("n"), F.sum("x")).first())
    bounds = (least_rho, most_rho)
    s0 = _strength(suffixes.withColumns({"pn": F.lit(n), "px": F.lit(x)}), [], *bounds)
    s1 = _strength(domains.join(over(suffixes), "suffix"), ["suffix"], *bounds)
    s2 = _strength(hosts.join(over(domains), ["domain", "suffix"]), ["domain", "suffix"], *bounds)
    shrunk = lambda prior, s: (F.col("x") + s * prior) / (F.col("n") + s)
    by_suffix = suffixes.select("suffix", shrunk(F.lit((x + 0.5) / (n + 1)), s0).alias("m1"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", shrunk(F.col("m1"), s1).alias("m2"))
    mean = shrunk(F.col("m2"), s2)
    posterior = hosts.join(by_domain, ["domain", "suffix"]).select("host", "n", "x", mean.alias("mean"))
    lower = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + s2 + 1))
    return posterior.withColumn("lower", lower).withColumn("blocked", F.col("lower") > threshold)


def thin_page(html: Column, least_words: int = 100) -> Column:
    """1 if the visible text of a page has under ``least_words`` words, 0 if not, null without a page."""
    visible = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>", " ")
    words = F.size(F.filter(F.split(visible, "[ \t\n\r\f]+"), lambda w: w != ""))
    return F.when(html.isNotNull(), (words < least_words).cast("int"))


def judge(pages: DataFrame, outcome: Column, rules: Sequence[Rule] = RULES, *, url_col: str = "url", id_col: str = "page_id", **chain) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page."""
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), outcome.alias("bad"))
    blocked = small(reputation(parsed, **chain).filter("blocked").select("host", "blocked"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return parsed.drop("bad").join(blocked, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


SQL = r"""
with parsed as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path,
    case when html is not null then cast(len(list_filter(string_split_regex(
      regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+'), lambda w: w <> '')) < 100 as int) end as bad
  from pages),
hosts as (
  select host, n, x, suffix, case when length(site) <= length(suffix) then site
      else string_split(substr(site, 1, length(site) - length(suffix) - 1), '.')[-1] || '.' || suffix end as domain
  from (select *, case when regexp_full_match(site, '([0-9]{1,3}([.][0-9]{1,3}){3}|\[.*\])') then site
        when two in ('appspot.com', 'blogspot.com', 'github.io', 'gitlab.io', 'herokuapp.com', 'netlify.app', 'pages.dev', 'vercel.app', 'wordpress.com') then two
        when regexp_full_match(two, '(ac|co|com|edu|gob|gov|gouv|mil|ne|net|nom|or|org)[.][a-z]{2}') then two else string_split(site, '.')[-1] end as suffix
    from (select *, array_to_string(string_split(site, '.')[-2:], '.') as two
      from (select host, count(bad) as n, coalesce(sum(bad), 0) as x, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') as site from parsed group by host)))),
domains as (select domain, suffix, sum(n) as n, sum(x) as x from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(x) as x from domains group by suffix),
everything as (select sum(n) as n, sum(x) as x from suffixes),
spread as (
  select 0 as level, '' as parent, g.n, g.x, p.n as pn, p.x as px from suffixes g cross join everything p
  union all select 1, g.suffix, g.n, g.x, p.n, p.x from domains g join suffixes p using (suffix)
  union all select 2, g.suffix || ' ' || g.domain, g.n, g.x, p.n, p.x from hosts g join domains p using (domain, suffix)),
inside as (
  select level, parent, sum(n * pow(x / n - px / pn, 2) / (px / pn * (1 - px / pn))) as s, count(*) - 1 as df, max(pn) - sum(n * n) / max(pn) - (count(*) - 1) as room
  from spread where n > 0 and px > 0 and px < pn group by level, parent),
rhos as (
  select l as level, least(greatest(coalesce((select (sum(s) - sum(df)) / nullif(sum(room), 0) from inside where level = l), 0.01), 0.01), 0.9) as rho from range(3) t(l)),
strengths as (select level, (1 - rho) / rho as s from rhos),
chain as (
  select h.host, h.n, h.x, s2.s as s2,
    (d.x + s1.s * ((u.x + s0.s * ((coalesce(e.x, 0) + 0.5) / (coalesce(e.n, 0) + 1))) / (u.n + s0.s))) / (d.n + s1.s) as m2
  from hosts h join domains d using (domain, suffix) join suffixes u using (suffix) cross join everything e
  join strengths s0 on s0.level = 0 join strengths s1 on s1.level = 1 join strengths s2 on s2.level = 2),
posterior as (select host, (x + s2 * m2) / (n + s2) as mean, n + s2 as weight from chain),
blocked as (select host from posterior where mean - 1.64 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5),
rules as (select * from (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) r(v, h, p)),
ruled as (
  select page_id, host, path, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as v
  from (select row_number() over () as k, * from parsed) q left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by k, page_id, host, path)
select page_id, host, path, rule, coalesce(v, case when host in (select host from blocked) then 'block' else 'allow' end) as verdict from ruled
"""
