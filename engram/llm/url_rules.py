"""URL filter: pattern rules behind an index of their rarest literal token.

A rule is (rule, verdict, pattern): a regular expression over ``host || path``.
Its literal tokens are the alphanumeric runs that any matching address must hold
as whole tokens.  How many addresses hold each token is counted over the table;
every rule is filed under its rarest one.  An address's tokens fetch the rules
filed under them, and only those run their regular expressions; the matching
rule with the highest ``rank`` wins.  Rules without a literal token are tried on
every address.  All of it is DataFrame operations, with no Python at run time.

Edge cases: a null url or one without ``://`` has empty host and path and fits no
rule; repeated urls are judged once and joined back; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The given rules as (verdict, host, path).
GIVEN_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Words that, as a whole token of the host, mark an address the method blocks.
BLOCK_WORDS = ("spam", "adult", "casino", "porn", "xxx", "sex", "gambling", "poker", "viagra", "malware", "phishing", "warez", "torrent", "ads", "adserver", "doubleclick", "clickbait", "escort", "pills", "pharmacy", "bets", "betting", "jackpot")
BROADCAST_RULES = 50_000  # rules up to this many are broadcast; more are joined by shuffle


def host_rule(verdict: str, host: str, path: str) -> dict:
    """A rule for a host, its subdomains and paths that start with ``path``."""
    whole = path.rpartition("/")[0]  # the part after the last / may go on in the address
    return {
        "rule": host + path, "verdict": verdict, "shown": True, "rank": 1_000_000 + len(host + path),
        "pattern": rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}".replace(r"\-", "-"),
        "tokens": re.findall(r"[a-z0-9]+", host) + re.findall(r"[a-z0-9]+", whole.lower()),
    }


def word_rule(word: str) -> dict:
    """A rule of the method: block hosts with this whole token."""
    return {"rule": word, "verdict": "block", "shown": False, "rank": len(word), "pattern": rf"^([^/]*[^a-z0-9/])?{word}([^a-z0-9/][^/]*)?(/|$)", "tokens": [word]}


def default_rules() -> list[dict]:
    return [host_rule(*r) for r in GIVEN_RULES] + [word_rule(w) for w in BLOCK_WORDS]


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    schema = "rule string, verdict string, shown boolean, rank int, pattern string, tokens array<string>"
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in schema.split(", ")) for r in rules], schema)


def host_of(url: str) -> Column:
    """From after the first :// up to / ? # or the end; only A-Z are lower-cased."""
    raw = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[dict] | None = None, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    rules = default_rules() if rules is None else rules
    spark = pages.sparkSession
    table = rules_frame(spark, rules)
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    split = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path")).withColumn("_at", F.concat("host", "path"))
    address = split.filter("_at != ''").select(F.col("_at").alias("at")).distinct()
    # the empty token stands for rules without a literal one
    own = F.array_distinct(F.regexp_extract_all(F.lower("at"), F.lit("([a-z0-9]+)")))
    plain = any(not r["tokens"] for r in rules)
    tokens = address.select("at", F.explode(F.array_append(own, "") if plain else own).alias("token"))
    literal = table.select("rule", "pattern", F.explode(F.when(F.size("tokens") > 0, F.array_distinct("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    seen = tokens.join(literal.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        literal.join(seen, "token", "left")
        .groupBy("rule", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t"))
        .select("rule", "pattern", F.col("t.token").alias("token"))
    )
    index = table.join(rarest, ["rule", "pattern"]).drop("tokens")
    fetched = tokens.join(index, "token")
    fits = fetched.filter(F.expr("at rlike pattern")).groupBy("at").agg(F.max(F.struct("rank", "rule", "verdict", "shown")).alias("w"))
    won = split.join(fits.select(F.col("at").alias("_at"), "w"), "_at", "left")
    return won.select(
        "page_id", "host", "path", F.when(F.col("w.shown"), F.col("w.rule")).alias("rule"), F.coalesce("w.verdict", F.lit(otherwise)).alias("verdict")
    )


def oracle(otherwise: str = "allow") -> str:
    """The default rules as DuckDB SQL over ``pages``."""
    given = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in GIVEN_RULES)
    words = "|".join(BLOCK_WORDS)
    return f"""
WITH g(verdict, h, p) AS (VALUES {given}),
u AS (
  SELECT page_id, row_number() OVER () AS i,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM u JOIN g ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[^a-z0-9])({words})($|[^a-z0-9])') THEN 'block' ELSE '{otherwise}' END) AS verdict
FROM u LEFT JOIN r USING (i)"""
