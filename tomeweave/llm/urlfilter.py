"""URL filtering with pattern rules that are looked up by their rarest literal token.

Every rule names tokens that each URL it matches must hold. It is filed under
the one that is rarest in the URLs at hand. The tokens of a URL fetch the
candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.base import ascii_lower
from tomeweave.session import ship_package

TOKEN = re.compile("[a-z0-9]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
MAX_RULE_BYTES = 256 * 1024 * 1024
HOST_RULE, PATTERN_RULE = 1, 0


@dataclass(frozen=True)
class Rule:
    """``literals``: tokens every match holds as whole tokens; without any, the rule is run on every URL."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    kind: int = PATTERN_RULE


def host_rule(verdict: str, name: str) -> Rule:
    """A rule for a host, its subdomains and a path prefix, written ``host/path``."""
    host, slash, path = name.partition("/")
    # The last token of the path may go on in the URL, unless a separator ends it.
    whole = re.sub("[a-z0-9]+$", "", f"{host.lower()}/{path.lower()}") if path else f"{host.lower()}/"
    pattern = f"(?:[^/]*\\.)?{re.escape(host.lower())}{re.escape(slash + path) or '(?:/|$)'}"
    return Rule(name, verdict, pattern, tuple(TOKEN.findall(whole)), HOST_RULE)


def word_rule(verdict: str, *words: str) -> Rule:
    """A rule for a host label or path part made of these words, joined by hyphens."""
    text = "-".join(words)
    return Rule(text, verdict, f".*(?<![a-z0-9]){re.escape(text)}(?![a-z0-9])", tuple(words))


#: Kinds of site that a text corpus leaves out.
BLOCKED_WORDS = (
    ("cheap", "pills"), ("online", "pharmacy"), ("free", "bets"), ("casino",), ("jackpot",), ("adult",), ("porn",),
    ("xxx",), ("escort",), ("ads", "track"), ("adserver",), ("spam", "farm"), ("link", "farm"), ("payday", "loans"),
    ("warez",), ("torrent",), ("phishing",), ("malware",),
)
PATTERNS = tuple(word_rule("block", *w) for w in BLOCKED_WORDS)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, tokens: Iterable[str]) -> dict[str, int]:
    """In how many of all URLs each token of the rules occurs; at most as many rows as tokens reach the driver."""
    wanted = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in sorted(set(tokens))], "token string"))
    found = F.array_distinct(F.regexp_extract_all(ascii_lower(F.concat("host", "path")), F.lit("([a-z0-9]+)"), 1))
    rows = urls.select(F.explode(found).alias("token")).join(wanted, "token").groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


class Index:
    """Rules by the token they are filed under."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.rules = list(rules)
        for k, rule in enumerate(self.rules):
            token = min(rule.literals, key=lambda t: (counts.get(t, 0), t), default="")
            self.by_token.setdefault(token, []).append(k)
        self.compiled: dict[int, re.Pattern] = {}

    def __getstate__(self):
        return {**self.__dict__, "compiled": {}}

    def best(self, host: str, path: str) -> Rule | None:
        """Host rules go before patterns, longer names before shorter ones, earlier rules before later ones."""
        url, best, rank = host + path, None, None
        low = url.translate(LOWER)  # patterns have no case, the paths of host rules have
        for token in {"", *TOKEN.findall(low)}:
            for k in self.by_token.get(token, ()):
                rule = self.rules[k]
                if k not in self.compiled:
                    self.compiled[k] = re.compile(rule.pattern, re.DOTALL)
                own = (rule.kind, len(rule.name), -k)
                if (rank is None or own > rank) and self.compiled[k].match(url if rule.kind == HOST_RULE else low):
                    best, rank = rule, own
        return best


def judge(pages: DataFrame, host_rules: Sequence[Rule], patterns: Sequence[Rule] = PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, matched, verdict) for every row.

    ``rule`` is the longest host rule that fits, else null, and then the longest
    pattern decides; without any the URL is allowed. A URL that is null or has no
    ``://`` has an empty host and path and is allowed. Repeated rows are judged
    alike, other columns are ignored, and a null id stays null.
    The rules are the caller's list; what is broadcast is checked against ``MAX_RULE_BYTES``.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rules = [*host_rules, *patterns]
    if sum(len(r.pattern) + len(r.name) + 200 for r in rules) > MAX_RULE_BYTES:
        raise ValueError("the rules are too large to broadcast; split the list")
    urls = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    shared = spark.sparkContext.broadcast(Index(rules, token_counts(urls, {t for r in rules for t in r.literals})))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for frame in frames:
            found = [index.best(h, p) for h, p in zip(frame["host"], frame["path"], strict=True)]
            frame["rule"] = [r.name if r and r.kind == HOST_RULE else None for r in found]
            frame["matched"] = [r.name if r else None for r in found]
            frame["verdict"] = [r.verdict if r else "allow" for r in found]
            frame["page_id"] = frame["page_id"].astype("Int64")
            yield frame

    return urls.mapInPandas(decide, "page_id bigint, host string, path string, rule string, matched string, verdict string")
