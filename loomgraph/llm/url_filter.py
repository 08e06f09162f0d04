"""URL filters: pattern rules indexed by their rarest literal token.

A URL's tokens fetch the rules that could fit it, and only those run their regular expressions. Host
and path rules compile to patterns over ``host + path`` and share the index with free patterns over the
whole URL. The rule set is a parameter of fixed size and travels with the task; URLs are judged row by
row, so nothing is shuffled but the bounded token counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, table

TOKEN = re.compile(r"[A-Za-z0-9]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: (verdict, host and path).
HOST_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Patterns for URLs that no host rule fits. ``||`` anchors at a host label, ``^`` is a separator or the
#: end, ``*`` is anything, a leading ``@@`` allows what other patterns block.
PATTERNS = ("||spam-farm.", "||spam.", "||casino.", "/phishing^", "||malware.", "@@||example.org/safe/")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: re.Pattern = field(repr=False)
    tokens: tuple[str, ...]
    whole_url: bool
    weight: tuple[int, int] = (0, 0)


def host_rule(verdict: str, text: str) -> Rule:
    """Fits the host and all its subdomains, if the path starts with the rule's."""
    host, slash, path = text.partition("/")
    path = slash + path
    found = TOKEN.findall(host) + [m.group() for m in TOKEN.finditer(path) if m.end() < len(path)]
    return Rule(text, verdict, re.compile(r"(?:[^/]*\.)?" + re.escape(host + path), re.S), tuple(found), False, (len(host), len(path)))


def pattern_rule(text: str) -> Rule:
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    label = body.startswith("||")
    body = body[2:] if label else body
    regex = r"[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if label else ".*"
    regex += "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c) or re.escape(c) for c in body)
    tokens = []
    for m in TOKEN.finditer(body):
        left, right = body[m.start() - 1 : m.start()], body[m.end() : m.end() + 1]
        if (label if not m.start() else left != "*") and right and right != "*":
            tokens.append(m.group())
    return Rule(text, verdict, re.compile(regex, re.S), tuple(tokens), True)


class RuleIndex:
    """Rules by their rarest token; those without a safe token are always candidates."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        for rule in rules:
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
            else:
                self.always.append(rule)

    def candidates(self, tokens: set[str]) -> list[Rule]:
        out = list(self.always)
        for t in tokens:
            out += self.by_token.get(t, ())
        return out

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        lowered = (url or "").translate(LOWER)
        spot = host + path
        best, blocked, excepted = None, False, False
        for rule in self.candidates({*TOKEN.findall(spot), *TOKEN.findall(lowered)}):
            if rule.whole_url:
                if rule.regex.match(lowered):
                    blocked, excepted = blocked or rule.verdict == "block", excepted or rule.verdict == "allow"
            elif host and (best is None or (sum(rule.weight), rule.weight) > (sum(best.weight), best.weight)) and rule.regex.match(spot):
                best = rule
        if best:
            return host, path, best.name, best.verdict
        return host, path, None, "block" if blocked and not excepted else "allow"


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:end], rest[end:]
    return host.translate(LOWER), re.split(r"[?#]", rest, maxsplit=1)[0]


def token_counts(urls: DataFrame, url: str, rules: list[Rule]) -> dict[str, int]:
    """How many times each of the rules' tokens occurs in all URLs: as many rows as the rules have tokens at most."""
    wanted = sorted({t for r in rules for t in r.tokens})
    found = urls.select(F.explode(F.regexp_extract_all(F.col(url), F.lit("([A-Za-z0-9]+)"))).alias("t"))
    rows = found.where(F.col("t").isin(wanted)).groupBy("t").count().collect() if wanted else []
    return {r["t"]: r["count"] for r in rows}


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS, id: str = "page_id", url: str = "url") -> DataFrame:
    """Every row with (id, host, path, rule, verdict).

    - A null url, or one without ``://``, has an empty host and path, no rule, and the patterns' verdict.
    - The longest host rule wins, ties to the longer host; where none fits, exceptions beat blocks, and the rest is allowed.
    - Repeated rows are judged one by one; very long URLs whole. An empty table gives an empty result.
    - Other columns are not read, whatever their names.
    """
    bounded_batches(pages.sparkSession)
    rules = [host_rule(*r) for r in host_rules] + [pattern_rule(p) for p in patterns]
    index = RuleIndex(rules, token_counts(pages, url, rules))
    kind = dict(pages.dtypes)[id]

    def rows(batch):
        host, path, rule, verdict = zip(*map(index.judge, batch["_url"]), strict=True) if batch["_url"] else ((), (), (), ())
        return {id: batch["_id"], "host": list(host), "path": list(path), "rule": list(rule), "verdict": list(verdict)}

    picked = pages.select(F.col(id).alias("_id"), F.col(url).alias("_url"))
    return map_batches(picked, rows, f"`{id}` {kind}, host string, path string, rule string, verdict string")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP2_SQL = r"""
WITH u AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                  CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
m AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM h, r
      WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
        AND starts_with(path, substr(rule, position('/' IN rule))) GROUP BY page_id)
SELECT h.page_id, host, path, m.rule, coalesce(m.verdict,
  CASE WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?(spam-farm|spam|casino|malware)\.') OR regexp_matches(low, '/phishing([^a-z0-9_.%-]|$)')
       THEN CASE WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?example\.org/safe/') THEN 'allow' ELSE 'block' END
       ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m ON h.page_id = m.page_id
"""
