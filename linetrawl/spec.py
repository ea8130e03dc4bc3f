"""Search and scan parameters, validated once on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

MODES = ("keyword", "regex", "fuzzy")
OPERATORS = ("and", "or")

# Default scan settings.
DEFAULT_EXTENSIONS = (
    ".txt", ".csv", ".log", ".md", ".tsv",
    ".xlsx", ".xlsm", ".xls",
    ".docx", ".doc",
    ".pptx", ".ppt",
)
DEFAULT_EXCLUDE_DIRS = (".git", ".svn", "node_modules", "__pycache__", ".venv", "venv")
DEFAULT_EXCLUDE_PATTERNS = ("~$*", "*.tmp", ".DS_Store", "Thumbs.db")


@dataclass(frozen=True)
class SearchSpec:
    """What to look for. ``operator`` only applies to keyword mode."""

    keywords: tuple[str, ...]
    mode: str = "keyword"
    operator: str = "and"
    case_sensitive: bool = False
    normalize_width: bool = True
    fuzzy_threshold: float = 0.80
    snippet_chars: int = 60
    max_hits_per_file: int = 20

    def __post_init__(self):
        object.__setattr__(self, "keywords", tuple(k for k in self.keywords if k))
        problems = []
        if self.mode not in MODES:
            problems.append(f"mode must be one of {MODES}, got {self.mode!r}")
        if self.operator not in OPERATORS:
            problems.append(f"operator must be one of {OPERATORS}, got {self.operator!r}")
        if not 0.0 <= float(self.fuzzy_threshold) <= 1.0:
            problems.append(f"fuzzy_threshold must be within 0..1, got {self.fuzzy_threshold}")
        if not _is_int(self.snippet_chars) or self.snippet_chars < 0:
            problems.append("snippet_chars must be an integer >= 0")
        if not _is_int(self.max_hits_per_file) or self.max_hits_per_file < 1:
            problems.append("max_hits_per_file must be an integer >= 1")
        if problems:
            raise ValueError("; ".join(problems))
        if self.mode == "regex":
            for pattern in self.keywords:
                re.compile(pattern)


@dataclass(frozen=True)
class ScanSpec:
    """Which files to look at. ``manifest_name`` is the one file name under which exports keep their manifest."""

    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS
    exclude_dirs: tuple[str, ...] = DEFAULT_EXCLUDE_DIRS
    exclude_patterns: tuple[str, ...] = DEFAULT_EXCLUDE_PATTERNS
    max_size_mb: int | None = 100
    xlsx_granularity: str = "cell"
    manifest_name: str | None = None

    @property
    def extension_filter(self) -> list[str] | None:
        """Lower-cased allow-list, or None when every extension passes."""
        wanted = [e.lower() for e in self.extensions if e]
        return None if not wanted or "*" in wanted else wanted


def _is_int(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)
