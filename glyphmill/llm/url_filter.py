"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs ahead of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._shared import ascii_lower, bloom_block, bloom_blocks, bloom_mask, cut, table

#: Verdict by host and path prefix; the longest rule that fits wins.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: The query's list has the urls of pages with such a title, words between bars, as a reviewer of page contents might list them.
LISTED_TITLE = r"<title>[^<]* \| [^<]*</title>"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The URL without scheme, leading `www.`, query, fragment, `.html` and slashes at the end; null where there is no host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(?:www\.)+", ""), F.regexp_replace(path, r"(?:/|\.html)+$", "")))


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule for this host or a domain above it whose path begins the url's path; else null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def marked(seen: DataFrame, urls: DataFrame) -> DataFrame:
    """seen with `maybe`: whether its canon may be among those of urls (canon, cut); never false for one that is, null canons aside."""
    blocks, n_blocks = bloom_blocks(urls, urls.count())
    blocks = F.broadcast(blocks)  # at most MOST_BLOCKS rows
    tested = seen.withColumn("block", bloom_block(F.col("canon"), n_blocks)).join(blocks, "block", "left")
    mask = bloom_mask(F.col("canon"))
    return tested.withColumn("maybe", F.col("canon").isNotNull() & F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))).drop("block", "bits")


def judge(pages: DataFrame, listed: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, listed and verdict of every row of pages (page_id, url); an empty table gives none.

    A rule's verdict stands. Other urls are blocked if their canonical form is
    that of a url in listed (url), else allowed; null urls and urls without
    `://` have no host, fit no rule, are never listed and so are allowed.
    The Bloom filter passes what may be listed to a hash join with the exact
    list; urls it rules out are never shuffled. Repeated rows are all kept.
    """
    urls = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("canon")).filter("canon is not null").distinct()
    urls = cut(urls)
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = seen.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    seen = seen.withColumn("canon", F.when(F.col("rule").isNull(), canonical(F.col("host"), F.col("path"))))
    tested = marked(seen, urls)
    columns = ["page_id", "host", "path", "rule"]
    passed = tested.filter(~F.col("maybe")).select(*columns, F.lit(False).alias("listed"))
    exact = urls.select("canon", F.lit(True).alias("listed"))
    looked_up = tested.filter("maybe").select(*columns, "canon").join(exact, "canon", "left").select(*columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    verdict = F.lit(None).cast("string")
    for rule, says in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return passed.unionByName(looked_up).withColumn("verdict", F.coalesce(verdict, own))


def query(spark, sf_dir: str) -> DataFrame:
    """The list has each url in another spelling, so that only the canonical form finds it; other pages of that form are found with it."""
    pages = table(spark, sf_dir, "pages")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    bare = F.regexp_replace(canonical(host, path), r"^[^/]*", "")
    spelled = F.concat(F.lit("HTTP://WWW."), F.upper(F.regexp_replace(host, r"^(?:www\.)+", "")), bare, F.lit("/?list"))
    listed = pages.filter(F.col("html").rlike(LISTED_TITLE) & (host != "")).select(spelled.alias("url"))
    return judge(pages.select("page_id", "url"), listed)


_PARTS = r"""
  select page_id, url, html,
    translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
"""

SQL = rf"""
with parts as ({_PARTS}),
named as (
  select *, case when host <> '' then regexp_replace(host, '^(?:www\.)+', '') || regexp_replace(path, '(?:/|\.html)+$', '') end as canon
  from parts),
rules(rule, says) as (values ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
cutup as (select rule, says, split_part(rule, '/', 1) as domain, substr(rule, strpos(rule, '/')) as start from rules),
listed as (select distinct canon from named where canon is not null and regexp_matches(html, '{LISTED_TITLE}'))
select n.page_id, n.host, n.path, w.rule, w.rule is null and l.canon is not null as listed,
  coalesce(w.says, case when l.canon is not null then 'block' else 'allow' end) as verdict
from named n
left join listed l on l.canon = n.canon
left join lateral (
  select rule, says from cutup c
  where (n.host = c.domain or ends_with(n.host, '.' || c.domain)) and starts_with(n.path, c.start)
  order by length(rule) desc limit 1) w on true
"""
