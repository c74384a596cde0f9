"""Options of the pipelines with their defaults and limits."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FORMATS = ("markdown", "html", "rawHtml", "links", "images")
_BANNED = ("<script", "javascript:", "expression(", "@import", "url(", "data:")


class InvalidOption(ValueError):
    pass


def check(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidOption(message)


def check_url(url: str) -> None:
    check(bool(url) and len(url.encode()) <= 2048, "an address has 1 to 2048 bytes")
    check(re.match(r"^https?://[^/?#\s]+", url, re.I) is not None, f"not a web address: {url!r}")


def check_selector(selector: str) -> None:
    from .operators.htmltree import SelectorError, compile_selector

    check(0 < len(selector) <= 1000, "a selector has 1 to 1000 characters")
    check(not any(b in selector.lower() for b in _BANNED), f"not allowed in a selector: {selector!r}")
    try:
        compile_selector(selector)
    except SelectorError as e:
        raise InvalidOption(str(e)) from e


@dataclass(frozen=True)
class ScrapeOptions:
    formats: tuple[str, ...] = ("markdown",)
    include_tags: tuple[str, ...] = ()
    exclude_tags: tuple[str, ...] = ()
    only_main_content: bool = True
    headers: dict[str, str] = field(default_factory=dict)
    timeout_ms: int = 30_000
    engine: str = "auto"

    def __post_init__(self) -> None:
        for f in self.formats:
            check(f in FORMATS, f"unknown format: {f!r}")
        check(0 < self.timeout_ms <= 300_000, "timeout is 1 to 300000 ms")
        check(len(self.headers) <= 50 and all(len(v) <= 4096 for v in self.headers.values()), "at most 50 headers of 4096 characters")
        check(self.engine in ("auto", "http", "browser"), f"unknown engine: {self.engine!r}")
        for s in (*self.include_tags, *self.exclude_tags):
            check_selector(s)


ACTIONS = ("click", "type", "scroll", "wait")
MAX_ACTIONS, MAX_WAIT_MS, MAX_CONCURRENCY = 50, 30_000, 10


def check_actions(actions: tuple[dict, ...]) -> None:
    """Steps of a browser as a request may name them (they are checked, not run)."""
    check(len(actions) <= MAX_ACTIONS, f"at most {MAX_ACTIONS} actions")
    for a in actions:
        check(a.get("type") in ACTIONS, f"unknown action: {a.get('type')!r}")
        if a["type"] in ("click", "type"):
            check_selector(a.get("selector", ""))
        if a["type"] == "wait":
            check(0 <= int(a.get("milliseconds", 0)) <= MAX_WAIT_MS, f"a wait is 0 to {MAX_WAIT_MS} ms")


def check_concurrency(n: int) -> None:
    check(1 <= n <= MAX_CONCURRENCY, f"concurrency is 1 to {MAX_CONCURRENCY}")


@dataclass(frozen=True)
class CrawlOptions:
    max_depth: int = 2
    limit: int | None = 100  # documents; None: all that are reached
    include_paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    allow_backward_links: bool = False
    allow_external_links: bool = False
    detect_pagination: bool = True
    max_pagination_pages: int | None = 50  # of one chain; None: no bound
    max_pagination_depth: int = 10
    batch: int = 64  # addresses taken off the frontier a round
    queue_size: int | None = 1000  # of the frontier; None: no bound
    backpressure: float = 0.8  # of the queue, above which pages of the last level aren't queued
    retries: int = 2  # of a transient error
    breaker_threshold: int = 3
    robots_mode: str = "strict"  # strict, base or off

    def __post_init__(self) -> None:
        check(self.limit is None or 1 <= self.limit <= 10_000, "limit is 1 to 10000, or none")
        check(self.queue_size is None or self.queue_size >= 1, "a queue holds 1 or more")
        check(0 < self.backpressure <= 1 and self.retries >= 0, "backpressure is a share, retries 0 or more")
        check(self.max_depth >= 0 and self.batch >= 1, "max_depth is 0 or more, batch 1 or more")
        check(self.robots_mode in ("strict", "base", "off"), f"unknown robots mode: {self.robots_mode!r}")


@dataclass(frozen=True)
class MapOptions:
    search: str | None = None
    ignore_sitemap: bool = False
    include_subdomains: bool = True
    limit: int = 5000

    def __post_init__(self) -> None:
        check(1 <= self.limit <= 100_000, "limit is 1 to 100000")


@dataclass(frozen=True)
class ExtractOptions:
    selectors: dict[str, str] = field(default_factory=dict)
    schema: dict = field(default_factory=dict)
    mode: str = "auto"
    completeness: float = 0.5
    prompt: str | None = None

    def __post_init__(self) -> None:
        check(self.mode in ("auto", "css", "llm"), f"unknown mode: {self.mode!r}")
        for s in self.selectors.values():
            check_selector(s)


@dataclass(frozen=True)
class DigestOptions:
    max_urls: int | None = 20  # None: all
    show_full_text: bool = True
    include_subdomains: bool = True

    def __post_init__(self) -> None:
        check(self.max_urls is None or 1 <= self.max_urls <= 500, "max_urls is 1 to 500, or none")
