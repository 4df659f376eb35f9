"""Options of a run."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ways to bound a crawl.
SCOPES = ("same-origin", "subdomains", "custom")


@dataclass(frozen=True)
class Options:
    """SRC1: constants of a plan. Limits below 1 (max_depth: below 0) are raised to it, an unknown scope is same-origin."""

    url: str
    max_pages: int = 50
    max_depth: int = 2
    scope: str = "same-origin"
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())
    respect_robots: bool = True
    subpages: bool = True
    single_file: bool = False
    strip_consent: bool = True
    user_agent: str = "*"
    delay_ms: int = 500
    concurrency: int = 2

    def __post_init__(self):
        fix = object.__setattr__
        fix(self, "max_pages", at_least(self.max_pages))
        fix(self, "concurrency", at_least(self.concurrency))
        fix(self, "max_depth", at_least(self.max_depth, 0))
        fix(self, "scope", self.scope if self.scope in SCOPES else SCOPES[0])


def at_least(value: float, least: int = 1) -> int:
    """CRW1: floored; ``least`` for smaller or non-finite values."""
    try:
        return max(least, int(value // 1))
    except (OverflowError, ValueError):
        return least


def parse_int_option(value: Column, fallback: int, least: int) -> Column:
    """SRC2: the leading integer of a text; ``fallback`` for none or one below ``least``."""
    number = F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("long")
    return F.when(number >= least, number).otherwise(F.lit(fallback).cast("long"))


def parse_arguments(arguments: list[str]) -> Options:
    """Options from a command line; of ``--single-file`` and ``--no-single-file`` the last holds."""
    p = argparse.ArgumentParser(prog="pageloom", argument_default=argparse.SUPPRESS)
    p.add_argument("url")
    for name in ("max-pages", "max-depth", "delay-ms", "concurrency"):
        p.add_argument(f"--{name}", type=int)
    for name in ("scope", "user-agent"):
        p.add_argument(f"--{name}")
    for name in ("include", "exclude"):
        p.add_argument(f"--{name}", action="append")
    for name in ("single-file", "strip-consent", "respect-robots", "subpages"):
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction)
    given = vars(p.parse_args(arguments))
    return Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
