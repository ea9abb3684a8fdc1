"""Conversion settings: defaults, a JSON file merged over them, checks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass

STRATEGIES = ("simple",)
ORDERS = ("y_sort", "xy_cut", "column_based")


@dataclass(frozen=True)
class PageRanges:
    start: int | None = None
    end: int | None = None
    skip: tuple[int, ...] = ()


@dataclass(frozen=True)
class ExcludeRegions:
    """Shares of the page at its edges whose blocks are left out."""

    top: float = 0.0
    bottom: float = 0.0
    left: float = 0.0
    right: float = 0.0


@dataclass(frozen=True)
class MultiColumn:
    """Pages of several columns are read column by column, as their gaps have them."""

    enabled: bool = False
    column_count: int = 1


@dataclass(frozen=True)
class Headings:
    font_size_threshold: float = 1.2


@dataclass(frozen=True)
class Footnotes:
    """References become links unless that is off; notes link back to the first chapter if wanted."""

    enabled: bool = True
    generate_backlinks: bool = False
    patterns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Images:
    enabled: bool = True
    max_width: int = 1200
    max_height: int = 1600
    jpeg_quality: int = 85
    convert_png_to_jpeg: bool = False


@dataclass(frozen=True)
class Metadata:
    title: str | None = None
    author: str | None = None
    language: str = "en"


@dataclass(frozen=True)
class Config:
    strategy: str = "simple"
    reading_order_strategy: str = "y_sort"
    page_ranges: PageRanges = field(default_factory=PageRanges)
    exclude_regions: ExcludeRegions = field(default_factory=ExcludeRegions)
    multi_column: MultiColumn = field(default_factory=MultiColumn)
    heading_detection: Headings = field(default_factory=Headings)
    footnote_processing: Footnotes = field(default_factory=Footnotes)
    image_optimization: Images = field(default_factory=Images)
    metadata: Metadata = field(default_factory=Metadata)

    def __post_init__(self) -> None:
        if self.reading_order_strategy not in ORDERS:
            raise ValueError(f"reading_order_strategy must be one of {ORDERS}")
        edges = self.exclude_regions
        if not all(0 <= x <= 1 for x in (edges.top, edges.bottom, edges.left, edges.right)):
            raise ValueError("exclude_regions must lie between 0 and 1")
        if self.multi_column.column_count < 1 or self.heading_detection.font_size_threshold <= 0:
            raise ValueError("column_count and font_size_threshold must be positive")


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, dictionaries member by member; anything else replaces."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def _made(kind: type, values: dict):
    """A settings object from a dictionary; unknown keys are ignored."""
    known = {}
    for f in fields(kind):
        if f.name not in values:
            continue
        value = values[f.name]
        default = f.default_factory() if callable(f.default_factory) else f.default  # type: ignore[misc]
        if is_dataclass(default) and isinstance(value, dict):
            value = _made(type(default), value)
        elif isinstance(value, list):
            value = tuple(value)
        known[f.name] = value
    return kind(**known)


def from_dict(*layers: dict) -> Config:
    """Settings from dictionaries, later ones over earlier ones."""
    values: dict = {}
    for layer in layers:
        values = merged(values, layer)
    return _made(Config, values)


def load(path: str, **overrides) -> Config:
    with open(path, encoding="utf-8") as f:
        return from_dict(json.load(f), overrides)
