"""Saved search results: pages of two engines, and a JSON engine.

Fetching is not done here.  Redirect links are unwrapped by expressions; result
pages are parsed in ``mapInPandas``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urlparse

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.text import text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Hosts of the engines themselves, and the parameters that hold a result's URL.
ENGINES = {
    "ddg": ("duckduckgo.com", ("duckduckgo.com", "www.duckduckgo.com", "html.duckduckgo.com", "lite.duckduckgo.com"), ("uddg",), "DuckDuckGo"),
    "bing": ("www.bing.com", ("bing.com", "www.bing.com", "go.microsoft.com", "login.live.com", "account.microsoft.com", "www.microsoft.com"), ("u", "url", "r"), "Bing"),
}
SCHEMA = "query string, search_engine string, _ord long, url string, title string, snippet string, source_provider string, source_kind string, source_name string"


def unwrapped(href: Column, engine: str = "ddg") -> Column:
    """External URL of a result link; empty for the engine's own links."""
    home, own, params, _ = ENGINES[engine]
    raw = F.regexp_replace(F.trim(text(href)), "^['\"]+|['\"]+$", "")
    full = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(F.lit(f"https://{home}"), raw)).otherwise(raw)
    wrapped = F.coalesce(*[F.nullif(F.regexp_extract(U.query(full), rf"(?:^|&){p}=([^&]*)", 1), F.lit("")) for p in params])
    external = F.try_url_decode(wrapped)
    return F.when(~full.rlike("^(?i:https?)://"), "").when(external.rlike("^(?i:https?)://"), external).when(F.lower(U.authority(full)).isin(*own), "").otherwise(full)


class Anchors(HTMLParser):
    """Links of a page with their text, their place's text, and whether they stand in a result or heading."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.links: list[dict] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, name, attrs):
        a = {k: v or "" for k, v in attrs}
        node = {"name": name, "attrs": a, "text": [], "holders": list(self.stack)}
        if name == "a" and a.get("href"):
            self.links.append(node)
        if name not in self.VOID:
            self.stack.append(node)

    def handle_endtag(self, name):
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k]["name"] == name), None)
        if at is not None:
            del self.stack[at:]

    def handle_data(self, data):
        for n in self.stack:
            n["text"].append(data)


def _words(node: dict, most: int = 500) -> str:
    return " ".join(" ".join(node["text"]).split())[:most]


def _classes(node: dict) -> set[str]:
    return set(node["attrs"].get("class", "").split())


def rank_of(link: dict, engine: str) -> int | None:
    """Kind of a link: lower is surer; null if it is none of a result."""
    holders = link["holders"]
    inside = lambda *names: any(_classes(h) & set(names) for h in holders)
    tags = [h["name"] for h in holders]
    if engine == "bing":
        tests = (inside("b_algo") and "h2" in tags, inside("b_algo"), any(h["attrs"].get("id") == "b_results" for h in holders) and "h2" in tags)
    else:
        test = link["attrs"].get("data-testid", "")
        tests = (
            "result__a" in _classes(link), test == "result-title-a", test == "result-title", test == "result-extras-url-link", inside("result"), inside("web-result"), inside("results"),
            "article" in tags, "h2" in tags, "h3" in tags, "uddg=" in link["attrs"]["href"],
        )
    return next((k for k, t in enumerate(tests) if t), None)


def external(href: str, engine: str) -> str:
    home, own, params, _ = ENGINES[engine]
    raw = href.strip().strip("\"'")
    raw = "https:" + raw if raw.startswith("//") else f"https://{home}{raw}" if raw.startswith("/") else raw
    try:
        parts = urlparse(raw)
    except ValueError:
        return ""
    if parts.scheme not in ("http", "https"):
        return ""
    found = next((v[0] for p in params if (v := parse_qs(parts.query).get(p)) and re.match("(?i)https?://", unquote(v[0]))), None)
    if found:
        return unquote(found).strip()
    return "" if parts.netloc.lower() in own else raw


def result_links(page: str, engine: str, most: int) -> list[tuple[str, str, str]]:
    """(URL, title, snippet) of results: surer kinds first, then page order; bare redirects last; first seen by URL."""
    found = sorted(((r, k, a) for k, a in enumerate(Anchors(page).links) if (r := rank_of(a, engine)) is not None), key=lambda x: x[:2])
    out: dict[str, tuple[str, str]] = {}
    for _, _, a in found:
        url = external(a["attrs"]["href"], engine).split("#", 1)[0]
        holder = next((h for h in reversed(a["holders"]) if re.search(r"(?i)(^|[-_ ])(result|b_algo)($|[-_ ])", h["attrs"].get("class", ""))), None)
        if url:
            out.setdefault(url, (_words(a) or url, _words(holder) if holder else ""))
    if engine == "ddg":
        for m in re.finditer(r"uddg=([^&\"'<>\s]+)", page):
            url = external(f"https://duckduckgo.com/l/?uddg={m[1]}", engine).split("#", 1)[0]
            if url:
                out.setdefault(url, (url, ""))
    return [(u, *v) for u, v in out.items()][:most]


def parse_pages(pages: DataFrame, most: int = 20) -> DataFrame:
    """Result rows of saved pages (``query, search_engine, body``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p in frame.itertuples(index=False):
                for k, (u, t, s) in enumerate(result_links(p.body or "", p.search_engine, most)):
                    rows.append((p.query, p.search_engine, k, u, t, s, f"blind:{p.search_engine}", "search_result", ENGINES[p.search_engine][3]))
            yield pd.DataFrame(rows, columns=["query", "search_engine", "_ord", "url", "title", "snippet", "source_provider", "source_kind", "source_name"])

    return pages.select("query", "search_engine", "body").mapInPandas(run, SCHEMA)


def parse_json(pages: DataFrame, most: int = 20) -> DataFrame:
    """Result rows of a JSON engine's answers (``query, body``): first seen by URL."""
    data = F.from_json("body", "struct<results:array<struct<url:string,title:string,content:string>>>")["results"]
    rows = pages.select("query", F.posexplode(data).alias("_ord", "r")).select("query", F.col("_ord").cast("long").alias("_ord"), U.without_fragment(F.trim("r.url")).alias("url"), "r.title", "r.content")
    from ..operators.admit import per_key
    from ..operators.merge import first_seen

    good = first_seen(rows.filter(F.col("url").rlike("^(?i:https?)://")), "query", "url")
    return per_key(good, ["query"], most, "_ord").select(
        "query", F.lit("searxng").alias("search_engine"), "_ord", "url", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("url")).alias("title"), F.trim(text(F.col("content"))).alias("snippet"),
        F.lit("blind:searxng").alias("source_provider"), F.lit("search_result").alias("source_kind"), F.lit("SearXNG").alias("source_name"),
    )


def diagnostics(results: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Parsed rows for each query and engine, with errors."""
    counts = results.groupBy("query", "search_engine").agg(F.count("*").alias("parsed_rows"))
    if errors is None:
        return counts.withColumn("error", F.lit(None).cast("string"))
    return counts.join(errors, ["query", "search_engine"], "full").withColumn("parsed_rows", F.coalesce("parsed_rows", F.lit(0)))
