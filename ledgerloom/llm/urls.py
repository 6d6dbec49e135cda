"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host, matched with all its subdomains, and the start of a path, written together: `example.org/es/`. In both
parts `*` stands for any characters (of a host: but /) and `^` for an edge between letters or digits and anything else;
a path that ends in `|` must end there. Every rule is indexed by that of its literal tokens which is rarest among the
urls; the tokens of a url fetch the rules that could fit it, and only those run their regular expression. Built-in
functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower

#: The rules of the contract, longest fit first.
LISTED_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Rules of the method's own, for urls that no listed rule fits: hosts that carry a word of unwanted trade, with exceptions.
HOST_WORDS = "ads adserver adult bets betting casino cialis clickbait crack escort gambling keygen lottery payday pharmacy pills poker popunder porn sex slots spam torrent tracker viagra warez xxx".split()
EXCEPTIONS = ["*^adult^*^education^*/", "*^sex^*^education^*/", "*^casino^*^museum^*/", "*^spam^*^museum^*/"]
PATTERN_RULES = [("block", f"*^{w}^*/") for w in HOST_WORDS] + [("allow", r) for r in EXCEPTIONS]
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What stands after the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_pattern(rule: str) -> str:
    """The rule as a regular expression over host and path."""
    host, slash, path = rule.partition("/")
    edge = "(?:(?<![0-9A-Za-z])|(?![0-9A-Za-z]))"

    def part(text: str, any_of: str) -> str:
        return re.sub(r"([.\\$|?+(){}\[\]])", r"\\\1", text).replace("*", any_of).replace("^", edge).replace("\0", "^")

    end = "$" if path.endswith("|") else ""
    return r"^(?:[^/]*\.)?" + part(host, "[\0/]*") + slash + part(path.removesuffix("|"), ".*") + end


def literal_tokens(rule: str) -> list[str]:
    """Tokens that every url which the rule fits has in full: those with an end on both sides."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9]+", rule):
        starts = m.start() == 0 or rule[m.start() - 1] != "*"
        ends = m.end() < len(rule) and rule[m.end()] != "*"
        if starts and ends:
            found.append(m[0])
    return found


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.filter(F.split(target, "[^A-Za-z0-9]+"), lambda t: t != ""))


def candidate_rules(targets: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """target, verdict, rule, tier, size, pattern: for each distinct target (host and path) the rules (verdict, rule, tier) whose rarest literal token it holds."""
    spark = targets.sparkSession
    held = len(rules) <= BROADCAST_RULES  # the rules are given by the caller, so their number is known

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if held else df

    by_token = spark.createDataFrame([(t, *r, len(r[1]), rule_pattern(r[1])) for r in rules for t in dict.fromkeys(literal_tokens(r[1]))], "token string, verdict string, rule string, tier int, size int, pattern string")
    met = targets.select("target", F.explode(_tokens(F.col("target"))).alias("token"))
    seen = met.join(small(by_token.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rarest = Window.partitionBy("rule", "verdict", "tier").orderBy("urls", "token")
    index = by_token.join(seen, "token", "left").fillna(0, ["urls"]).withColumn("_k", F.row_number().over(rarest)).filter("_k = 1")
    return met.join(small(index.select("token", "verdict", "rule", "tier", "size", "pattern")), "token").drop("token")


def judge_urls(pages: DataFrame, listed: list[tuple[str, str]] | None = None, patterns: list[tuple[str, str]] | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict.

    rule is the longest listed rule that fits (equal lengths: the last in order of text), else null; verdict is that
    rule's, else 'allow' if a pattern rule that allows fits (an exception), else 'block' if one that blocks fits, else
    'allow'. A null url, or one without ://, has an empty host and path and is allowed. A long url is read whole.
    Repeated rows each keep a row; an empty table gives an empty result; other columns are ignored. Every rule must
    have a literal token.
    """
    listed, patterns = LISTED_RULES if listed is None else listed, PATTERN_RULES if patterns is None else patterns
    rules = [(verdict, rule, 2) for verdict, rule in listed] + [(verdict, rule, int(verdict == "allow")) for verdict, rule in patterns]
    if bare := [r[1] for r in rules if not literal_tokens(r[1])]:
        raise ValueError(f"rules without a literal token: {bare}")
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("target", F.concat("host", "path"))
    if not rules:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    fits = candidate_rules(rows.filter("target <> ''").select("target").distinct(), rules).filter(F.rlike("target", F.col("pattern")))
    best = fits.groupBy("target").agg(F.max(F.struct("tier", "size", "rule", "verdict")).alias("best"))
    judged = rows.join(best, "target", "left")
    return judged.select("page_id", "host", "path", F.when(F.col("best.tier") == 2, F.col("best.rule")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def oracle() -> str:
    """DuckDB SQL for judge_urls over the table pages with the default rules: listed rules by their host and path, pattern rules by the host's words."""
    listed = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in LISTED_RULES)
    pairs = ", ".join(str(re.findall("[a-z]+", r)) for r in EXCEPTIONS)
    return f"""
    WITH rules(verdict, rule, h, p) AS (VALUES {listed}),
    rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    numbered AS (SELECT *, row_number() OVER () AS k, string_split_regex(host, '[^a-z0-9]+') AS w FROM parts),
    fits AS (SELECT k, verdict, rule, row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, rule DESC, verdict DESC) AS place
             FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
    judged AS (SELECT *, len(list_intersect(w, {HOST_WORDS})) > 0 AND path LIKE '/%' AS unwanted,
                      len(list_filter([{pairs}], lambda x: len(list_filter(range(1, len(w) + 1), lambda i: w[i] = x[1] AND list_contains(w[i + 1:], x[2]))) > 0)) > 0 AS excepted FROM numbered)
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN unwanted AND NOT excepted THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (k)"""
