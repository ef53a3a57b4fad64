r"""Operator 3: URL rules, indexed by their rarest literal token.

Two kinds of rules: host rules (a host and the start of a path, for the host and its subdomains; the longest that
fits decides) and, for urls that no host rule fits, patterns in the usual filter-list form: ``*``
any characters, ``^`` a separator or the end, ``|`` the start or end, ``||`` the start of a host label. Every rule
becomes one regular expression over the address, which is the url after ``://`` with its host in lower case.

The index: a rule's literal tokens are the runs of ``[a-z0-9]`` that must be whole runs in any address it
fits. How many distinct urls hold each is counted over the corpus, and the rule is filed under its
rarest. An address fetches the rules under its own tokens, and only those run their regular
expression. Rules without a token are filed under the empty token, which every address has.

Distinct urls are judged once and joined back. Spark broadcasts the index if it is under its
broadcast threshold and shuffles both sides by token otherwise.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed; rows that
share a url have equal results; an empty table stays empty; input columns that bear an output's name are replaced, others stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import names_without
from .text import ascii_lower

OUTPUT = ["host", "path", "rule", "verdict", "pattern"]
RULES = "rule_no int, is_host boolean, name string, verdict string, size int, host_size int, regex string, tokens array<string>"
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|$)"


def host_rule(verdict: str, host: str, path: str) -> tuple:
    """A rule row for a host (and its subdomains) and a path's start."""
    bounded = rf"^(?:[^/?#]*\.)?{re.escape(host)}" + (re.escape(path) if path else "(?![^/?#])")
    whole = path.rsplit("/", 1)[0] + "/" if "/" in path else ""  # the last run of a path may go on in an address
    ends = re.search(r"[a-z0-9]*$", path.lower()).start()
    tokens = re.findall(r"[a-z0-9]+", host.lower()) + re.findall(r"[a-z0-9]+", path.lower()[: max(ends, len(whole))])
    return True, host + path, verdict, len(host + path), len(host), bounded, sorted(set(tokens))


def pattern_rule(verdict: str, pattern: str) -> tuple:
    """A rule row for a pattern in filter-list form."""
    body, start, end = pattern, "", ""
    if body.startswith("||"):
        body, start = body[2:], r"^(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    regex = "".join({"*": ".*", "^": SEPARATOR}.get(c, re.escape(c)) for c in body)
    # A run is whole if a character that cannot be in a run, or an anchor, stands on both its sides.
    framed = ("/" if start else "*") + body.lower() + ("/" if end else "*")
    tokens = [m[1] for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", framed)]
    return False, pattern, verdict, len(pattern), 0, f"(?is){start}{regex}{end}", sorted(set(tokens))


def rules_table(spark: SparkSession, hosts: list[tuple[str, str, str]], patterns: list[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, host, path) and (verdict, pattern)."""
    rows = [host_rule(*h) for h in hosts] + [pattern_rule(*p) for p in patterns]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RULES)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and address of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path, F.concat(host, F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1))


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(ascii_lower(address), F.lit("[a-z0-9]+"), F.lit(0)), F.array(F.lit(""))))


def rarest_token_index(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """``rules`` with the ``token`` that the fewest of ``addresses`` (address) hold; ties to the first in order."""
    listed = rules.select("rule_no", F.explode("tokens").alias("token"))
    held = addresses.select(F.explode(_tokens(F.col("address"))).alias("token"))
    counts = held.join(listed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("rule_no").orderBy("n", "token")
    chosen = (
        listed.join(counts, "token", "left")
        .select("rule_no", "token", F.coalesce("n", F.lit(0)).alias("n"))
        .withColumn("place", F.row_number().over(rarest))
        .where("place = 1")
        .select("rule_no", "token")
    )
    return rules.join(chosen, "rule_no", "left").withColumn("token", F.coalesce("token", F.lit("")))


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule (of the host rule, or null), verdict, and pattern (that decided, or null)."""
    names = names_without(pages, OUTPUT)
    urls = pages.select("url").where("url IS NOT NULL").distinct()
    addresses = urls.select("url", parts(F.col("url"))[2].alias("address"))
    index = rarest_token_index(rules, addresses)
    candidates = addresses.select("url", "address", F.explode(_tokens(F.col("address"))).alias("token")).join(index, "token")
    hits = candidates.where(F.regexp_like("address", F.col("regex")))
    allowed = (F.col("verdict") == "allow").cast("int")
    best_host = F.max(F.when(F.col("is_host"), F.struct("size", "host_size", (1 - allowed).alias("blocks"), F.col("name"), "verdict")))
    best_pattern = F.max(F.when(~F.col("is_host"), F.struct(allowed.alias("allows"), "size", F.col("name"), "verdict")))
    judged = hits.groupBy("url").agg(best_host.alias("by_host"), best_pattern.alias("by_pattern")).withColumnRenamed("url", "judged_url")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col("url").alias("u"))
    host, path, _ = parts(F.col("u"))
    return rows.join(judged, F.col("u") == F.col("judged_url"), "left").select(
        *[F.col("row").getField(c).alias(c) for c in names],
        host.alias("host"),
        path.alias("path"),
        F.col("by_host.name").alias("rule"),
        F.coalesce("by_host.verdict", "by_pattern.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("by_host").isNull(), F.col("by_pattern.name")).alias("pattern"),
    )


#: The query's rules: the contract's, and patterns for the urls that they leave.
HOST_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
PATTERN_RULES = [
    ("block", "||ads.*"), ("block", "/ads/*"), ("block", "/login^"), ("block", "/signin^"), ("block", "/cart^"), ("block", "/checkout^"),
    ("block", ".zip|"), ("block", ".exe|"), ("block", ".apk|"), ("block", "?sessionid=*"), ("block", "&sessionid=*"), ("block", "*//*.php?sid=*"),
    ("allow", "/login^help^"),
]


def op3_sql() -> str:
    """DuckDB SQL for the query's rows: every rule against every address."""
    rows = [(i, *host_rule(*h)) for i, h in enumerate(HOST_RULES)] + [(100 + i, *pattern_rule(*p)) for i, p in enumerate(PATTERN_RULES)]
    values = ", ".join(f"({n}, {host}, '{name}', '{verdict}', {size}, {host_size})" for n, host, name, verdict, size, host_size, _, _ in rows)
    hosts = " OR ".join(
        f"(r.n = {i} AND (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for i, (_, h, p) in enumerate(HOST_RULES)
    )
    patterns = " OR ".join(f"(r.n = {n} AND regexp_matches(address, '{regex}'))" for n, host, _, _, _, _, regex, _ in rows if not host)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH rule(n, is_host, name, verdict, size, host_size) AS (VALUES {values}),
    rest AS (
      SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), part AS (
      SELECT rid, page_id, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             {lower.format("regexp_extract(rest, '^[^/?#]*')")} || substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS address
      FROM rest
    ), hit AS (
      SELECT part.rid, r.*, row_number() OVER (PARTITION BY part.rid, r.is_host ORDER BY CASE WHEN r.is_host THEN 0 ELSE (r.verdict = 'allow')::INT END DESC, r.size DESC, r.host_size DESC, r.name DESC) AS place
      FROM part JOIN rule r ON {hosts} OR {patterns}
    )
    SELECT part.page_id, part.host, part.path, h.name AS rule, coalesce(h.verdict, p.verdict, 'allow') AS verdict, CASE WHEN h.name IS NULL THEN p.name END AS pattern
    FROM part LEFT JOIN hit h ON h.rid = part.rid AND h.is_host AND h.place = 1
    LEFT JOIN hit p ON p.rid = part.rid AND NOT p.is_host AND p.place = 1"""
