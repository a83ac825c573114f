"""Options of a packing run: defaults, then a JSON section, then what is given."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

FORMATS = ("md", "txt", "jsonl")
STRATEGIES = ("size", "semantic")
DEDUP = ("off", "exact", "fuzzy", "both")
PRESETS = ("notebooklm", "rag-standard")

# Caps of the notebooklm preset.
NOTEBOOKLM_CHUNKS = 50
NOTEBOOKLM_WORDS = 500_000


@dataclass(frozen=True)
class PackOptions:
    max_words_per_chunk: int = 500_000
    max_chunks: int = 50
    strategy: str = "size"
    ignore: tuple[str, ...] = ()
    prefix: str = "docs_chunk_"
    with_index: bool = True
    format: str = "md"
    no_extract: bool = False
    show_tokens: bool = False
    token_encoding: str = "byte_bpe_50k"
    dry_run: bool = False
    dedup: str = "off"
    dedup_threshold: int = 3
    delimiter: str = "\n\n"
    context_header: bool = False
    cross_refs: bool = False
    delta: bool = False
    bundle: str | None = None
    score: bool = False
    legacy_headers: bool = False
    header_tag: str = "context-v1"

    def __post_init__(self) -> None:
        for name, allowed in (("format", FORMATS), ("strategy", STRATEGIES), ("dedup", DEDUP)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}; XML is not supported" if name == "format" else f"{name} must be one of {', '.join(allowed)}")
        if self.bundle is not None and self.bundle not in PRESETS:
            raise ValueError(f"bundle must be one of {', '.join(PRESETS)}")

    def preset(self) -> PackOptions:
        """With the bundle's caps; rag-standard changes nothing."""
        if self.bundle == "notebooklm":
            return replace(self, max_chunks=min(self.max_chunks, NOTEBOOKLM_CHUNKS), max_words_per_chunk=min(self.max_words_per_chunk, NOTEBOOKLM_WORDS))
        return self


def load_options(config: str | None = None, section: str = "pack", **given) -> PackOptions:
    """Given values win over the section of the JSON text, and that over the
    defaults; keys may be written with hyphens.  Unknown keys are ignored."""
    known = {f.name for f in fields(PackOptions)}
    values: dict = {}
    if config:
        try:
            found = json.loads(config)
        except json.JSONDecodeError as e:
            raise ValueError(f"configuration is not valid JSON: line {e.lineno}, column {e.colno}: {e.msg}") from e
        values = {k.replace("-", "_"): v for k, v in (found.get(section) or {}).items()}
    values |= {k: v for k, v in given.items() if v is not None}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
    return PackOptions(**values)
