"""Options with defaults; non-positive thresholds mean the default."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column

from .constants import BLOCK_DOMAINS, MAX_BODY_BYTES, MAX_TEXT_BYTES, PENALTIES


@dataclass(frozen=True)
class ExtractorOption:
    """Override of one extractor. An entry without ``enabled`` disables it."""

    enabled: bool = False
    confidence: float = 0.0


@dataclass(frozen=True)
class CustomExtractor:
    """A caller's own extractor: ``entries`` maps the node array to ``array<struct<key,value>>``."""

    name: str
    priority: int
    confidence: float
    selectors: Mapping[str, bool]  # selector -> wants text
    entries: Callable[[Column], Column]
    first_wins: bool = False


def _positive(value, default):
    return value if value is not None and value > 0 else default


@dataclass(frozen=True)
class Options:
    threshold: float = 0.70
    link_rich_min_links: int = 10
    tiny_body_bytes: int = 5120
    text_density_ratio: float = 0.05
    penalties: Mapping[str, float] = field(default_factory=dict)
    min_confidence: float = 0.50
    extractors: Mapping[str, ExtractorOption] = field(default_factory=dict)
    custom_extractors: tuple[CustomExtractor, ...] = ()
    dom_text_selectors: Mapping[str, str] = field(default_factory=dict)
    # False ignores completions and asks for none; a configuration without an entry says False.
    fallback_enabled: bool = True
    fallback_confidence: float = 0.70
    max_text_bytes: int = MAX_TEXT_BYTES
    max_body_bytes: int = MAX_BODY_BYTES
    # Hosts kept out of requests, for tier 3 and for tier 4.
    block_domains: tuple[str, ...] = BLOCK_DOMAINS
    tier4_block_domains: tuple[str, ...] = BLOCK_DOMAINS
    # True cuts trailing zeros of every JSON number (100 -> 1), as the reference results do.
    legacy_numbers: bool = False
    # True escalates every page without fields, not only the hollow ones.
    escalate_empty: bool = False
    # True stores aborted pages with the status "aborted".
    mark_aborted: bool = False

    def __post_init__(self):
        for name in ("threshold", "link_rich_min_links", "tiny_body_bytes", "text_density_ratio", "min_confidence"):
            object.__setattr__(self, name, _positive(getattr(self, name), _DEFAULTS[name]))
        for name in ("max_text_bytes", "max_body_bytes"):
            object.__setattr__(self, name, _positive(getattr(self, name), _DEFAULTS[name]))

    def penalty(self, signal: str) -> float:
        """Configured penalty if the key exists, even 0; only the challenge falls back on a non-positive one."""
        value = self.penalties.get(signal, PENALTIES[signal])
        return _positive(value, PENALTIES[signal]) if signal == "cf-challenge" else value

    def blocked_in(self, tier: int) -> tuple[str, ...]:
        return self.tier4_block_domains if tier == 4 else self.block_domains

    def register(self, extractor: CustomExtractor) -> Options:
        return replace(self, custom_extractors=(*self.custom_extractors, extractor))

    @classmethod
    def from_mapping(cls, config: Mapping) -> Options:
        """Options of a nested configuration (``tier2.hollow.threshold`` and so on)."""
        tier2 = config.get("tier2") or {}
        hollow, merge, text = (tier2.get(k) or {} for k in ("hollow", "merge", "llm"))
        values = {k: hollow.get(k) for k in ("threshold", "link_rich_min_links", "tiny_body_bytes", "text_density_ratio")}
        values["penalties"] = {k: float(v) for k, v in (hollow.get("penalties") or {}).items()}
        values["min_confidence"] = merge.get("min_confidence")
        values["extractors"] = {
            name: ExtractorOption(bool(o.get("enabled", False)), float(o.get("confidence", 0)))
            for name, o in ((n, o or {}) for n, o in (tier2.get("extractors") or {}).items())
        }
        values["fallback_confidence"] = text.get("confidence", cls.fallback_confidence)
        values["max_text_bytes"] = text.get("max_text_bytes")
        values["fallback_enabled"] = bool(text.get("enabled", False))
        for name, tier in (("block_domains", "tier3"), ("tier4_block_domains", "tier4")):
            values[name] = tuple((config.get(tier) or {}).get("block_domains", BLOCK_DOMAINS))
        return cls(**values)

    @classmethod
    def from_yaml(cls, path: str) -> Options:
        """Options of a YAML file; defaults when the file does not exist."""
        import yaml  # only needed here

        try:
            with open(path, encoding="utf-8") as f:
                return cls.from_mapping(yaml.safe_load(f) or {})
        except FileNotFoundError:
            return cls()


_DEFAULTS = {f.name: f.default for f in fields(Options)}
