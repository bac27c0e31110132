"""Source registries: Markdown files with tables of allowed sources and blocked patterns.

A registry is a small file whose meaning depends on the order of its lines, so
it is read on the driver; its entries become a frame, its rules expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.policy import Rule

# Names of sections, and of source types.
ALLOWED = ("allowed sources", "allow sources", "sources", "directory sources")
BLOCKED = ("blocked sources", "block sources", "deny sources", "blocked patterns")
TYPES = ("page", "feed", "direct_hls", "site", "dynamic")
TRUE = ("1", "true", "yes", "on", "y", "enabled")
SCHEMA = "entry_ord int, name string, url string, source_type string, scope_hint string, enabled boolean, notes string"


@dataclass
class Registry:
    sources: list[tuple] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *row) for k, row in enumerate(self.sources)], SCHEMA)


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def separator(line: str) -> bool:
    own = [c.replace(":", "").strip() for c in cells(line)]
    return all(set(c) == {"-"} for c in own)


def parse(text: str) -> Registry:
    out, section, lines, k = Registry(), None, [x.strip() for x in text.splitlines()], 0
    while k < len(lines):
        if lines[k].startswith("#"):
            section = lines[k].lstrip("#").strip().lower()
        elif lines[k].startswith("|") and k + 1 < len(lines) and separator(lines[k + 1]):
            head = [re.sub("[ -]", "_", c.lower()) for c in cells(lines[k])]
            k += 2
            while k < len(lines) and lines[k].startswith("|"):
                _take(out, section, head, dict(zip(head, cells(lines[k]) + [""] * len(head))))
                k += 1
            continue
        k += 1
    return out


def _take(out: Registry, section: str | None, head: list[str], row: dict[str, str]) -> None:
    if section in BLOCKED or "pattern" in head and "url" not in head:
        if row.get("pattern"):
            out.rules.append(Rule(row["pattern"], row.get("reason") or None))
    elif (section in ALLOWED or "url" in head) and row.get("url"):
        kind = (row.get("type") or row.get("source_type") or "page").lower()
        enabled = not row.get("enabled") or row["enabled"].lower() in TRUE
        out.sources.append((row.get("name") or row["url"], row["url"], kind if kind in TYPES else "page", row.get("scope_hint") or None, enabled, row.get("notes") or None))


def load(spark: SparkSession, path: str | None, patterns: Iterable[str] = ()) -> Registry:
    """The registry of a file (none if it doesn't exist) with further patterns; read through Spark, so any store will do."""
    out = Registry()
    if path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            out = parse(spark.read.text(path, wholetext=True).first()[0])
    out.rules += [Rule(p.strip(), "cli_block_pattern") for p in patterns if p and p.strip()]
    return out
