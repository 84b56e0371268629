"""Limits, names and patterns that define the results."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values -----------------------------------------------------------
ALLOWED_EXTENSIONS = (".pdf", ".txt", ".md", ".docx", ".csv", ".json", ".xml")
PARSEABLE_EXTENSIONS = (".pdf", ".md", ".txt")
MAX_UPLOAD_BYTES = 50 * 1024 * 1024

STATUSES = ("uploaded", "parsing", "chunking", "ready", "failed")
BLOCK_TYPES = ("paragraph", "heading", "table", "code", "list_item")
UNSPLITTABLE_TYPES = ("heading", "code")
PAGE_TYPES = ("text", "scanned", "hybrid", "blank")

DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
SORTABLE_COLUMNS = ("created_at", "filename", "file_size")
HOT_TOP_N = 20
RECENT_PER_USER = 20
SESSION_IDLE_MINUTES = 30

BLANK_TEXT_CHARS = 10
NOISE_PRINTABLE_SHARE = 0.6
GARBLED_SHARE = 0.05
BLANK_PAGE_CHARS = 10
SCANNED_PAGE_CHARS = 50
SCANNED_IMAGE_SHARE = 0.3

HEADER_SHARE = 0.15
FOOTER_SHARE = 0.85
REPEAT_SHARE = 0.5
REGION_MAX_CHARS = 200
REGION_MIN_PAGES = 3
REGION_LABEL_CHARS = 80

CUT_WINDOW_CHARS = 200
SPLIT_DELIMITERS = ("\n\n", "\n", "。", "；", "，")

DEFAULT_MAX_TOKENS = 16000
DEFAULT_EFFORT = "high"
DEFAULT_THINKING = True
DEFAULT_FINISH_REASON = "stop"
CITATION_MARKERS = ("[1]", "[2]", "来源", "reference", "Reference", "引用", "参见")
EXCERPT_CHARS = 500

# White space of any script, as a pattern and as the characters themselves, and
# the control characters a text column may not hold (tab, line feed and return stay).
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
CONTROL_CHARS = r"[\p{Cc}&&[^\t\n\r]]"
# ----------------------------------------------------------------------------

REPLACEMENT_CHAR = "�"


@dataclass(frozen=True)
class ChunkingConfig:
    """Sizes, in characters, that drive splitting and merging."""

    max_chars: int = 1000
    overlap_chars: int = 200
    merge_short_threshold: int = 100
    split_on: tuple[str, ...] = SPLIT_DELIMITERS

    def __post_init__(self) -> None:
        if self.max_chars < 1:
            raise ValueError("max_chars must be at least 1")
        if not 0 <= self.overlap_chars < self.max_chars:
            raise ValueError("overlap_chars must be in [0, max_chars)")
        if self.merge_short_threshold < 0:
            raise ValueError("merge_short_threshold must not be negative")
        if any(not d for d in self.split_on):
            raise ValueError("split_on must not hold empty delimiters")
        if any(len(d) > CUT_WINDOW_CHARS for d in self.split_on):
            raise ValueError("a delimiter must fit in the window it is looked for in")
