"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host`` + ``path`` (or over the whole URL) together with
the literal tokens that any matching URL must contain. Token counts over the URL table choose the
rarest token of each rule as its index key. The tokens of a URL fetch candidate rules by a join, and
only candidates run their expression. Each distinct URL is judged once.

Defined cases: a null URL or one without ``://`` has empty host and path and gets the method's
verdict; repeated rows each keep their own result; an empty table gives no rows; extra columns do
not matter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Index tables up to this many rules are hinted for broadcast; longer lists join by shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``name`` is shown; ``length`` decides between matches of one tier; tier 0 goes before tier 1."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    length: int
    tier: int = 0


def place_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule on a host with all its subdomains and on a path's beginning."""
    literal = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", host + path)
    whole = re.findall(r"[a-z0-9]+(?![a-z0-9]*$)", (host + path).lower())
    tokens = tuple(dict.fromkeys(whole)) or tuple(re.findall(r"[a-z0-9]+", host.lower()))
    return Rule(host + path, verdict, rf"^([^/]*\.)?{literal}", tokens, len(host + path))


def pattern_rule(name: str, verdict: str, pattern: str, tokens: Sequence[str]) -> Rule:
    """A rule of the method itself: consulted where no place rule matches."""
    return Rule(name, verdict, pattern, tuple(tokens), len(pattern), 1)


#: What the method blocks where no place rule fits: pages that are no prose.
METHOD_RULES = (
    pattern_rule("login", "block", r"/(login|wp-login\.php)\b", ("login",)),
    pattern_rule("signin", "block", r"/signin\b", ("signin",)),
    pattern_rule("cgi", "block", r"/cgi-bin/", ("cgi", "bin")),
    pattern_rule("cart", "block", r"/cart/", ("cart",)),
    pattern_rule("checkout", "block", r"/checkout/", ("checkout",)),
    pattern_rule("feed", "block", r"/feed/?$", ("feed",)),
    pattern_rule("archive", "block", r"\.zip$", ("zip",)),
    pattern_rule("program", "block", r"\.exe$", ("exe",)),
    pattern_rule("picture", "block", r"\.jpg$", ("jpg",)),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def url_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def rarest_tokens(tokens: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """Counts of the rules' own tokens over all URLs; at most one row per token of the rule list."""
    names = sorted({t for r in rules for t in r.tokens})
    wanted = tokens.sparkSession.createDataFrame([(t,) for t in names], "token string")
    wanted = F.broadcast(wanted) if len(rules) <= BROADCAST_RULES else wanted
    found = tokens.join(wanted, "token").groupBy("token").count().collect()
    return {t: 0 for t in names} | {r["token"]: r["count"] for r in found}


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (name of the fitting place rule or null), verdict, method_rule."""
    urls = pages.select(F.coalesce(F.col("url"), F.lit("")).alias("_url")).distinct()
    host, path = url_parts(F.col("_url"))
    urls = urls.select("_url", host.alias("host"), path.alias("path"))
    subject = F.concat("host", "path")
    tokens = urls.select("_url", subject.alias("_subject"), F.explode(url_tokens(subject)).alias("token"))
    counts = rarest_tokens(tokens, rules)
    index = pages.sparkSession.createDataFrame(
        [(min(r.tokens, key=lambda t: (counts[t], t)), r.name, r.verdict, r.pattern, r.length, r.tier) for r in rules],
        "token string, _name string, _verdict string, _pattern string, _length int, _tier int",
    )
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    best = (
        tokens.join(index, "token")
        .where(F.expr("_subject rlike _pattern"))
        .groupBy("_url")
        .agg(F.min_by(F.struct("_name", "_verdict", "_tier"), F.struct(F.col("_tier"), -F.col("_length"), F.col("_name"))).alias("_best"))
    )
    judged = urls.join(best, "_url", "left").select(
        "_url", "host", "path",
        F.when(F.col("_best._tier") == 0, F.col("_best._name")).alias("rule"),
        F.coalesce(F.col("_best._verdict"), F.lit(default)).alias("verdict"),
        F.when(F.col("_best._tier") == 1, F.col("_best._name")).alias("method_rule"),
    )
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("_url"))
    return rows.join(judged, "_url").select("page_id", "host", "path", "rule", "verdict", "method_rule")
