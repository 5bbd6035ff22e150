"""Text column functions: tagged-section extraction, Unicode strip, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point Python's ``str.isspace`` accepts, written as
# a regex class both Java and RE2 understand.
UNICODE_SPACE_CLASS = (
    r"[\t\n\x{0b}\x{0c}\r\x{1c}\x{1d}\x{1e}\x{1f} \x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STRIP_PATTERN = rf"^{UNICODE_SPACE_CLASS}+|{UNICODE_SPACE_CLASS}+\z"

# Fixed value: the text an unreadable answer maps to.
MISSING = "n/a"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_strip(c) -> Column:
    """Strip leading/trailing whitespace in the Unicode sense (not only ' ')."""
    return F.regexp_replace(_col(c), STRIP_PATTERN, "")


def tag_section(c, tag: str) -> Column:
    """Text after the last ``<tag>`` up to the first following ``</tag>``.

    No opening tag → from the start; no closing tag → to the end.  NULL input
    stays NULL (see :func:`extract_tag`).
    """
    after_open = F.substring_index(_col(c), f"<{tag}>", -1)
    return F.substring_index(after_open, f"</{tag}>", 1)


def extract_tag(c, tag: str, lower: bool = True) -> Column:
    """Tagged section, Unicode-stripped, lower-cased; NULL input → ``'n/a'``."""
    out = unicode_strip(tag_section(c, tag))
    if lower:
        out = F.lower(out)
    return F.coalesce(out, F.lit(MISSING))


def strip_lower(c) -> Column:
    """Unicode strip then lower-case."""
    return F.lower(unicode_strip(c))


def strip_suffix(c, pattern: str) -> Column:
    """Remove a regex-anchored suffix, e.g. ``(_test|_val)$``."""
    return F.regexp_replace(_col(c), pattern, "")


def replace_literal(c, *needles: str) -> Column:
    """Remove each literal substring anywhere, in the given order."""
    out = _col(c)
    for n in needles:
        out = F.replace(out, F.lit(n), F.lit(""))
    return out
