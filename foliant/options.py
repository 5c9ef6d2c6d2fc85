"""Options of cleanup, heading analysis and rendering."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Cleanup:
    """Which stages clean a text; their order is fixed."""

    normalize: bool = True
    private_use: bool = False
    lines: bool = False
    structure: bool = False
    final: bool = True
    preserve_frontmatter: bool = False

    @classmethod
    def minimal(cls) -> Cleanup:
        return cls()

    @classmethod
    def default(cls) -> Cleanup:
        return cls(lines=True, preserve_frontmatter=True)

    @classmethod
    def aggressive(cls) -> Cleanup:
        return cls(True, True, True, True, True, True)

    @classmethod
    def named(cls, name: str) -> Cleanup:
        return {"minimal": cls.minimal, "default": cls.default, "aggressive": cls.aggressive}[name]()


@dataclass(frozen=True)
class HeadingConfig:
    max_level: int = 4
    max_text: int = 80
    size_ratio: float = 1.2
    min_sequence: int = 2
    trust_explicit: bool = True
    analyze_sequences: bool = True
    style_names: dict[str, int] = field(default_factory=dict)
    style_ids: dict[str, int] = field(default_factory=dict)

    def with_max_level(self, level: int) -> HeadingConfig:
        return replace(self, max_level=min(max(level, 1), 6))

    def with_size_ratio(self, ratio: float) -> HeadingConfig:
        return replace(self, size_ratio=max(ratio, 1.0))

    def with_style(self, level: int, name: str | None = None, style_id: str | None = None) -> HeadingConfig:
        names = self.style_names | ({name.lower(): level} if name else {})
        return replace(self, style_names=names, style_ids=self.style_ids | ({style_id: level} if style_id else {}))


@dataclass(frozen=True)
class RenderOptions:
    """table: markdown, html (for merged tables) or ascii; revisions: accept, reject or markup."""

    frontmatter: bool = False
    table: str = "markdown"
    max_heading: int = 4
    escape: bool = True
    image_prefix: str = ""
    revisions: str = "accept"
    headers_footers: bool = False
    notes: bool = True
    section_markers: bool = False
    callouts: bool = False
    preserve_breaks: bool = False
    refine: bool = False
    cleanup: Cleanup | None = None
    headings: HeadingConfig | None = None

    @classmethod
    def lossless(cls) -> RenderOptions:
        return cls(frontmatter=True, headers_footers=True, section_markers=True, preserve_breaks=True, revisions="markup")

    def with_(self, **changes) -> RenderOptions:
        return replace(self, **changes)
