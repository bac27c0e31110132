"""Configuration from the environment and arguments; arguments win.

Environment names are ``OCELLI_`` and the option in capitals, e.g. ``OCELLI_MAX_HLS``.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping

from .operators.policy import Rule
from .plans.harvest import HarvestConfig
from .plans.run import RunConfig

PROFILES = ("fast", "balanced", "full")


def setting(name: str, default, env: Mapping[str, str] | None = None):
    """An environment setting in the type of its default; what can't be read is the default."""
    raw = (env if env is not None else os.environ).get(f"OCELLI_{name.upper()}", "").strip()
    if not raw:
        return default
    if isinstance(default, bool):
        return raw.lower() in ("1", "true", "yes", "on", "y", "enabled")
    try:
        return type(default)(raw)
    except ValueError:
        return default


def parser(env: Mapping[str, str] | None = None) -> argparse.ArgumentParser:
    s = lambda name, default: setting(name, default, env)
    p = argparse.ArgumentParser(prog="ocelli", description="Catalogues of public live-media sources, from tables of what was fetched.")
    p.add_argument("--sources", default=s("sources", ""), help="registry of sources and block rules (Markdown)")
    p.add_argument("--block", action="append", default=[], help="a further block pattern")
    own = p.add_subparsers(dest="command", required=True)
    h = own.add_parser("harvest", help="URL records, cameras and endpoints of fetched payloads")
    h.add_argument("payloads")
    h.add_argument("out")
    h.add_argument("--media", action="append", help="media types and extensions to keep")
    h.add_argument("--image-filter", default=s("image_filter", "raw"))
    h.add_argument("--max-urls", type=int, default=s("max_urls", 0))
    h.add_argument("--query", default="")
    h.add_argument("--intermediate", action="store_true")
    for name, text in (("run", "candidates of payloads"), ("handoff", "candidates of a harvest's manifest")):
        r = own.add_parser(name, help=text + " for targets, through scope, validation and trust")
        r.add_argument("payloads" if name == "run" else "manifest")
        r.add_argument("targets")
        r.add_argument("out")
        r.add_argument("--probes", default="", help="probe results (Parquet)")
        r.add_argument("--geocodes", default="", help="geocoder answers (Parquet)")
        r.add_argument("--profile", choices=PROFILES, default=s("profile", "fast"))
        for option, default in (("max-hls", 100), ("max-images", 50), ("max-total", 0), ("max-geocodes", 0)):
            r.add_argument(f"--{option}", type=int, default=s(option.replace("-", "_"), default))
    return p


def harvest_config(args: argparse.Namespace, rules: list[Rule]) -> HarvestConfig:
    return HarvestConfig(media=args.media or ["all"], image_filter=args.image_filter, max_urls=args.max_urls, rules=rules)


def run_config(args: argparse.Namespace, rules: list[Rule]) -> RunConfig:
    return RunConfig(profile=args.profile, max_hls=args.max_hls, max_images=args.max_images, max_total=args.max_total or args.max_hls + args.max_images, max_geocodes=args.max_geocodes, rules=rules)
