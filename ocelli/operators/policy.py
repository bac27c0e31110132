"""Block policy: ordered patterns as one column expression, or an index of many, so no join is needed.

Four kinds of pattern, by their form: an absolute URL (glob or prefix), one with
a slash (glob anywhere in the URL), ``*.domain`` (suffix or glob of the host),
and a host (itself, its subdomains, or a glob).  Hosts are compared without port
and user, so ``blocked.org:8080`` doesn't escape the rule for ``blocked.org``.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.text import any_term, text

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rule:
    pattern: str
    reason: str | None = None


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression that both Java and Python read alike."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inside = pattern[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]")
            k = end
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        k += 1
    return "(?s)^" + "".join(out) + "$"


def _matches(pattern: str, host: Column, low: Column) -> Column:
    if pattern.startswith(("http://", "https://")):
        return low.rlike(glob_regex(pattern)) | low.startswith(pattern.rstrip("*"))
    if "/" in pattern:
        return low.rlike(glob_regex(f"*{pattern}*"))
    if pattern.startswith("*."):
        return host.endswith(pattern[1:]) | host.rlike(glob_regex(pattern))
    return (host == pattern) | host.endswith("." + pattern) | host.rlike(glob_regex(pattern))


def _pieces(pattern: str) -> list[str]:
    """The literal pieces of a glob, which every text that it matches holds."""
    out, k = [""], 0
    while k < len(pattern):
        end = pattern.find("]", k + 2) if pattern[k] == "[" else -1
        if pattern[k] in "*?" or end > 0:
            out.append("")
            k = max(k, end) + 1
        else:
            out[-1] += pattern[k]
            k += 1
    return out


class RuleIndex:
    """Finds the first of many rules that matches a URL, in time that hardly depends on their number.

    Literal hosts are looked up by each suffix of the host that begins at a label;
    of the other rules, those are tested whose longest literal piece an Aho-Corasick
    automaton finds in the URL or host.
    """

    def __init__(self, patterns: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.hosts: dict[str, int] = {}
        self.below: dict[str, int] = {}
        self.tests: dict[int, tuple[bool, str | None, re.Pattern | None]] = {}
        self.always: list[int] = []
        self.found = {False: ahocorasick.Automaton(), True: ahocorasick.Automaton()}
        words: dict[tuple[bool, str], list[int]] = {}
        for n, p in patterns:
            of_url = "/" in p
            whole = p.startswith(("http://", "https://"))
            glob = f"*{p}*" if of_url and not whole else p
            if not of_url and len(_pieces(p.removeprefix("*."))) == 1:
                known = self.below if p.startswith("*.") else self.hosts
                known.setdefault(p.removeprefix("*."), n)
                continue
            if not of_url:  # the pattern as a literal, too
                (self.below if p.startswith("*.") else self.hosts).setdefault(p.removeprefix("*."), n)
            self.tests[n] = (of_url, p.rstrip("*") if whole else None, re.compile(glob_regex(glob)))
            piece = max(_pieces(glob), key=len)
            if piece:
                words.setdefault((of_url, piece), []).append(n)
            else:
                self.always.append(n)
        for (of_url, piece), numbers in words.items():
            self.found[of_url].add_word(piece, numbers)
        for a in self.found.values():
            a.make_automaton()

    def first(self, low: str, host: str) -> int | None:
        best = self.hosts.get(host)
        at = host.find(".")
        while at >= 0:
            for known in (self.hosts, self.below):
                n = known.get(host[at + 1 :])
                best = n if best is None or (n is not None and n < best) else best
            at = host.find(".", at + 1)
        near = set(self.always)
        for of_url, s in ((True, low), (False, host)):
            if len(self.found[of_url]):
                for _, numbers in self.found[of_url].iter(s):
                    near.update(numbers)
        for n in sorted(near):
            if best is not None and n > best:
                break
            of_url, prefix, glob = self.tests[n]
            s = low if of_url else host
            if (prefix is not None and s.startswith(prefix)) or glob.match(s):
                return n
        return best


#: Rules up to which a policy is one CASE expression.
FEW_RULES = 64
_INDEXES: dict[tuple, RuleIndex] = {}


def _indexed(low: Column, host: Column, rules: list[Rule]) -> Column:
    """The reasons of many rules by one Arrow pass."""
    named = tuple((n, r.pattern.strip().lower()) for n, r in enumerate(rules) if r.pattern.strip())
    reasons = {n: rules[n].reason or f"blocked_by_pattern:{rules[n].pattern}" for n, _ in named}

    @F.pandas_udf("string")
    def reason(urls: pd.Series, hosts: pd.Series) -> pd.Series:
        if named not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[named] = RuleIndex(list(named))
        index = _INDEXES[named]
        return pd.Series([reasons.get(index.first(u, h or "")) if u else None for u, h in zip(urls, hosts)], dtype=object)

    return reason(low, host)


def block_reason(url: Column, rules: list[Rule]) -> Column:
    """Reason of the first rule that matches, or null; an expression for a few rules, an index for many."""
    low, host = F.lower(text(url)), U.host(url)
    if len(rules) > FEW_RULES:
        return _indexed(low, host, rules)
    out = F.when(text(url) == "", F.lit(None).cast("string"))
    for r in rules:
        p = r.pattern.strip().lower()
        if p:
            out = out.when(_matches(p, host, low), r.reason or f"blocked_by_pattern:{r.pattern}")
    return out.otherwise(None)


def record_block_reason(url: Column, source_url: Column, rules: list[Rule]) -> Column:
    return F.coalesce(block_reason(url, rules), block_reason(source_url, rules))


def unblocked(df: DataFrame, rules: list[Rule], *cols: str) -> DataFrame:
    """Rows none of whose URL columns a rule matches."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & block_reason(F.col(c), rules).isNull()
    return df.filter(keep) if rules else df


def split_blocked(df: DataFrame, rules: list[Rule], col: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and blocked rows with their ``blocked_reason``."""
    marked = df.withColumn("blocked_reason", block_reason(F.col(col), rules))
    return marked.filter("blocked_reason IS NULL").drop("blocked_reason"), marked.filter("blocked_reason IS NOT NULL")


# Words that are left out of a query before it is judged, and fragments that a generated query must not hold.
EXCLUDED_WORDS = ("shodan", "censys", "zoomeye", "fofa", "insecam", "login", "admin", "password", "credential", "credentials")
FORBIDDEN_FRAGMENTS = (
    "rtsp://", "rtsps://", "password", "credential", "default login", "admin login", "wp-admin", "axis-cgi", "streaming/channels", "cam/realmonitor", "192.168.", "10.",
    "172.16.", "shodan", "censys", "zoomeye", "fofa", "insecam",
)


def safe_query(query: Column) -> Column:
    """Guardrail of generated queries: about cameras, and no forbidden fragment outside of exclusions (``-word``)."""
    kept = F.regexp_replace(F.lower(text(query)), r"-(?:" + "|".join(EXCLUDED_WORDS) + r")\b", "")
    return ~any_term(kept, FORBIDDEN_FRAGMENTS) & kept.rlike(r"\b(?:camera|cameras|webcam|webcams)\b")


def operator_query(query: Column) -> Column:
    """Whether a query uses search operators."""
    return any_term(F.lower(text(query)), ("site:", "filetype:", "intitle:", "inurl:"))
