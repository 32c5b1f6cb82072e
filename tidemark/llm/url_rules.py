"""URL filters: rules indexed by their rarest literal token; only the rules that a URL's tokens fetch run as regular expressions.

A rule is one row: ``rule``, ``action`` (allow or block) and ``kind``.

* *host* rules are a host and the beginning of a path (``example.com/en/``): they fit the host and its subdomains.
* *pattern* rules are texts found anywhere in a URL, whatever the case of A-Z: ``*`` stands for anything, ``^`` for a separator or the
  end, ``|`` at an end for that end of the URL, ``||`` at the beginning for the beginning of a label of the host.

A token is a run of ``[a-z0-9]`` that is whole wherever the rule fits: what touches a wildcard or an open end is none. Tokens
are counted over all URLs, and each rule is filed under its rarest. Each URL's tokens are joined with that index (broadcast
behind a check of its size, else shuffled, where Spark splits a token that is in all URLs), and the few rules fetched are
tried. Rules without a token are filed under the empty one, which every URL then has. URLs that repeat are judged once.

The longest fitting host rule wins; where none fits, the longest fitting pattern rule; else ``default``. Equal lengths: allow, then the
smaller rule.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no host rule; null fits no rule at all; an
empty table gives an empty result; repeated rows and ties each get their verdict; extra columns are ignored; URLs are read whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small, stored, table

# fixed values: the host rules that the query applies
HOST_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Pattern rules of this operator: spam hosts, advertisements, programs, sessions and carts.
PATTERN_RULES = (
    ("block", "||cheap-pills."),
    ("block", "||free-bets."),
    ("block", "||spam-farm."),
    ("block", "||casino*.win^"),
    ("block", "/ads/"),
    ("block", "/banner*.gif^"),
    ("block", ".exe|"),
    ("block", "?sessionid="),
    ("block", "/cart^"),
    ("allow", "/legal/ads/"),
)

RULE_SCHEMA = "action string, rule string, kind string"


def _lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _quoted(c: Column, marks: str = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E") -> Column:
    """``c`` with a backslash before each of ``marks``."""
    return F.regexp_replace(c, f"([{marks}])", r"\\$1")


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lowered(url), F.lit("[a-z0-9]+"), F.lit(0)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: what stands before ``/``, ``?`` or ``#``, lower-cased, and the rest before ``?`` or ``#``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return _lowered(host), path


def compiled(rules: DataFrame) -> DataFrame:
    """``rules`` with ``tokens`` (whole in every URL that fits) and ``regex``. The regex of a host rule is for host and path, that of a pattern for the lower-cased URL."""
    host = _lowered(F.substring_index("rule", "/", 1))
    path = F.substring(F.col("rule"), F.length(host) + 1, F.length("rule"))
    pattern = F.regexp_replace(_lowered(F.col("rule")), r"\*+", "*")
    # a host begins where its regex does and its path's end is open; what touches a wildcard or an open end may go on in the URL
    bounded = F.when(F.col("kind") == "host", F.concat(F.lit("|"), F.translate(_lowered(F.col("rule")), "*", "+"))).otherwise(pattern)
    tokens = F.array_distinct(F.regexp_extract_all(bounded, F.lit(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0)))
    site = F.concat(F.lit(r"\A(?:[^/?#]*\.)?"), _quoted(host), _quoted(path))
    body = F.regexp_replace(F.regexp_replace(pattern, r"\A\|{1,2}", ""), r"\|\z", "")
    body = _quoted(body, r"\x21-\x29\x2B-\x2F\x3A-\x40\x5B-\x5D\x5F\x60\x7B-\x7E")
    body = F.regexp_replace(F.regexp_replace(body, r"\*", ".*"), r"\^", r"(?:[^a-z0-9_.%-]|\\z)")
    begin = F.when(F.startswith(pattern, F.lit("||")), r"\A[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?").when(F.startswith(pattern, F.lit("|")), r"\A").otherwise("")
    end = F.when(F.endswith(pattern, F.lit("|")) & (F.length(pattern) > 2), r"\z").otherwise("")
    regex = F.when(F.col("kind") == "host", site).otherwise(F.concat(F.lit("(?s)"), begin, body, end))
    return rules.withColumn("tokens", tokens).withColumn("regex", regex)


def token_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, action, rule, kind, regex): each rule under the one of its tokens that the fewest ``urls`` hold; ``''`` if it has none."""
    rules = stored(compiled(rules.select("action", "rule", "kind").distinct()), "url-rules")
    pairs = rules.select("action", "rule", "kind", "regex", F.explode_outer("tokens").alias("token"))
    known = small(stored(pairs.filter("token is not null").select("token").distinct(), "url-rule-tokens"))
    counts = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).join(known, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token")))["token"]
    return pairs.join(counts, "token", "left").groupBy("action", "rule", "kind", "regex").agg(rarest.alias("token"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule (host rule that won), pattern (pattern rule that won), verdict, tried (rules whose regular expression ran)."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = stored(rows.select("url").filter("url is not null").distinct(), "urls")
    index = stored(token_index(urls, rules), "url-index")
    tokens = url_tokens(F.col("url"))
    if not index.filter("token = ''").isEmpty():
        tokens = F.concat(F.array(F.lit("")), tokens)
    host, path = host_and_path(F.col("url"))
    fetched = urls.select("url", F.explode(tokens).alias("token")).join(small(index), "token")
    subject = F.when(F.col("kind") == "host", F.concat(host, path)).otherwise(_lowered(F.col("url")))
    fits = F.rlike(subject, F.col("regex"))
    won = lambda kind: F.min(F.when(fits & (F.col("kind") == kind), F.struct((-F.length("rule")).alias("shorter"), "action", "rule")))
    verdicts = fetched.groupBy("url").agg(won("host").alias("h"), won("pattern").alias("p"), F.count("*").alias("tried"))
    out = rows.join(verdicts, "url", "left").withColumn("host", host).withColumn("path", path)
    verdict = F.coalesce("h.action", "p.action", F.lit(default))
    return out.select("page_id", "host", "path", F.col("h.rule").alias("rule"), F.col("p.rule").alias("pattern"), verdict.alias("verdict"), F.coalesce("tried", F.lit(0)).cast("bigint").alias("tried"))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, r, "host") for a, r in HOST_RULES] + [(a, r, "pattern") for a, r in PATTERN_RULES], RULE_SCHEMA)


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), default_rules(spark)).drop("tried")


#: Every rule tried on every URL.
ORACLE = r"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, url, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM p),
r AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
  translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM q),
judged AS (SELECT *,
  CASE WHEN path LIKE '/en/%' AND (host = 'www.example.com' OR host LIKE '%.www.example.com') THEN 'www.example.com/en/'
    WHEN path LIKE '/en/%' AND (host = 'example.com' OR host LIKE '%.example.com') THEN 'example.com/en/'
    WHEN path LIKE '/es/%' AND (host = 'net' OR host LIKE '%.net') THEN 'net/es/'
    WHEN path LIKE '/fr/%' AND (host = 'net' OR host LIKE '%.net') THEN 'net/fr/'
    WHEN path LIKE '/%' AND (host = 'com' OR host LIKE '%.com') THEN 'com/' END AS rule,
  (SELECT min({'shorter': -length(v.pattern), 'action': v.action, 'rule': v.pattern}) FROM (VALUES
    ('block', '||cheap-pills.', '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?cheap-pills[.]'),
    ('block', '||free-bets.', '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?free-bets[.]'),
    ('block', '||spam-farm.', '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?spam-farm[.]'),
    ('block', '||casino*.win^', '(?s)^[a-z][a-z0-9+.-]*://([^/?#]*[.])?casino.*[.]win([^a-z0-9_.%-]|$)'),
    ('block', '/ads/', '/ads/'),
    ('block', '/banner*.gif^', '(?s)/banner.*[.]gif([^a-z0-9_.%-]|$)'),
    ('block', '.exe|', '[.]exe$'),
    ('block', '?sessionid=', '[?]sessionid='),
    ('block', '/cart^', '/cart([^a-z0-9_.%-]|$)'),
    ('allow', '/legal/ads/', '/legal/ads/')) v(action, pattern, regex) WHERE regexp_matches(low, v.regex)) AS p FROM r)
SELECT page_id, host, path, rule, p.rule AS pattern,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE coalesce(p.action, 'allow') END AS verdict FROM judged
"""
