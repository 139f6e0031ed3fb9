"""URL filtering by host and path rules and by a weighted vocabulary."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cache
from importlib import resources

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A URL whose distinct terms weigh REJECT is rejected; a strict term weighs as much, a soft one less.
REJECT = 2
#: Terms, and rules, that a vocabulary may have (some 200 bytes each in every worker).
MOST = 200_000


@cache
def listed_terms() -> dict[str, int]:
    """The terms and weights of the list that comes with the operator."""
    with resources.files(__package__).joinpath("url_terms.csv").open(encoding="utf-8") as f:
        return {r["term"]: int(r["weight"]) for r in csv.DictReader(f)}


@dataclass(frozen=True)
class Rule:
    """host: fits itself and its subdomains; path: what the URL's path must start with."""

    host: str
    path: str
    verdict: str

    @property
    def label(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class Vocabulary:
    """terms: weights of terms in lower case; rules."""

    terms: Mapping[str, int] = field(default_factory=listed_terms)
    rules: Sequence[Rule] = ()
    reject: int = REJECT

    @classmethod
    def of(cls, terms: DataFrame | None = None, rules: DataFrame | None = None, reject: int = REJECT) -> Vocabulary:
        """From tables (term, weight) and (host, path, verdict), of MOST rows at most.

        A null term or host is left out, a null weight is 1, a null path any path; of a term's
        weights the highest counts.
        """

        def rows(df: DataFrame) -> list:
            got = df.limit(MOST + 1).collect()
            if len(got) > MOST:
                raise ValueError(f"a vocabulary has more than {MOST} rows")
            return got

        own: dict[str, int] = {} if terms is not None else dict(listed_terms())
        for r in rows(terms.select("term", "weight")) if terms is not None else ():
            if r["term"]:
                own[r["term"].lower()] = max(own.get(r["term"].lower(), 0), 1 if r["weight"] is None else int(r["weight"]))
        found = [Rule(r["host"].lower(), r["path"] or "/", r["verdict"]) for r in rows(rules.select("host", "path", "verdict")) if r["host"]] if rules is not None else []
        return cls(own, tuple(found), reject)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? or #.

    A null URL, and one without ://, has both empty.
    """
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


class Rules:
    """The rules by host, the one that wins first."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=_worth):
            self.by_host.setdefault(r.host, []).append(r)

    def fitting(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; ties: block wins, then the label."""
        found, at = [], 0
        while at >= 0:
            found += next(([r] for r in self.by_host.get(host[at:], ()) if path.startswith(r.path)), [])
            at = host.find(".", at) + 1 or -1
        return min(found, key=_worth, default=None)


def _worth(r: Rule) -> tuple:
    return (-len(r.label), r.verdict != "block", r.label)


def automaton(terms: Mapping[str, int]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t, weight in terms.items():
        a.add_word(t, (t, weight))
    if terms:
        a.make_automaton()
    return a


def _letter(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def term_hits(a: ahocorasick.Automaton, url: str | None, reject: int = REJECT) -> tuple[int, int, int]:
    """Distinct strict and soft terms between boundaries in the URL (any character but a-z, 0-9), and what all weigh."""
    if not url or not len(a):
        return 0, 0, 0
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url) if not url.isascii() else url.lower()
    hits = {}
    for end, (t, weight) in a.iter(low):
        begin = end - len(t) + 1
        if not (begin and _letter(low[begin - 1])) and not (end + 1 < len(low) and _letter(low[end + 1])):
            hits[t] = weight
    strict = sum(w >= reject for w in hits.values())
    return strict, len(hits) - strict, sum(hits.values())


def judge_urls(df: DataFrame, vocabulary: Vocabulary, url: str = "url") -> DataFrame:
    """Adds host, path, rule, strict_hits, soft_hits and verdict (allow or block) to each row.

    The longest fitting rule decides (of equally long ones one that blocks); without one, the URL is
    blocked if its distinct terms weigh `reject` together: one strict term, or several soft ones. No
    shuffle; a row needs nothing but itself. Null and empty URLs: empty host and path, no hits,
    allowed. Very long URLs are scanned once, whole. Repeated rows stay; other columns stay, and a
    column that has the name of an added one is replaced by it. No rows: none.
    """
    terms, rules, reject = dict(vocabulary.terms), tuple(vocabulary.rules), vocabulary.reject

    @F.pandas_udf("struct<rule:string,verdict:string,strict_hits:int,soft_hits:int>")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        a, index = automaton(terms), Rules(rules)
        for urls, hosts, paths in parts:
            rows = []
            for u, h, p in zip(urls, hosts, paths, strict=True):
                strict, soft, weight = term_hits(a, u, reject)
                rule = index.fitting(h, p)
                rows.append((rule and rule.label, rule.verdict if rule else "block" if weight >= reject else "allow", strict, soft))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "strict_hits", "soft_hits"]).astype({"strict_hits": "int32", "soft_hits": "int32"})

    host, path = host_and_path(F.col(f"`{url}`"))
    host, path = F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))
    taken = {"host", "path", "rule", "strict_hits", "soft_hits", "verdict"}
    kept = [F.col(f"__in.`{c}`") for c in df.columns if c not in taken]
    out = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__in"), host.alias("host"), path.alias("path"), judged(F.col(f"`{url}`"), host, path).alias("__j"))
    return out.select(*kept, "host", "path", "__j.rule", "__j.strict_hits", "__j.soft_hits", "__j.verdict")
