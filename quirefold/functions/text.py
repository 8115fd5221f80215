"""Column expressions on document text.

Everything here stays in the JVM: built-in string functions, Java regular
expressions and higher-order functions on arrays inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space or line end when text
# is trimmed (general category Z plus tab, LF, VT, FF, CR and NEL).
WHITESPACE_CODE_POINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WHITESPACE = "".join(map(chr, WHITESPACE_CODE_POINTS))

# Fixed value: the line separators of the title rule.
ANY_NEWLINE = r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"

# Default and least chunk length in characters.
DEFAULT_CHUNK_LIMIT = 1200
MIN_CHUNK_LIMIT = 200

# Texts made only of these code points have one grapheme cluster per code point,
# so the cheap length is exact. Anything else takes the \X path.
_NOT_STANDALONE = (
    r"[^\x00-\x0C\x0E-\x{2FF}\x{370}-\x{482}\x{48A}-\x{52F}\x{2010}-\x{2027}"
    r"\x{2030}-\x{205E}\x{3001}-\x{3029}\x{3031}-\x{3096}\x{30A0}-\x{312F}"
    r"\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"
)
# A quick first test: no Latin text without CR holds one of these.
_BEYOND_LATIN = r"[\x0D\x{300}-\x{10FFFF}]"
# A space followed by one of these is part of a longer cluster, not a separator.
_JOINS_LEFT = r"[\p{M}\x{200C}\x{200D}\x{1F3FB}-\x{1F3FF}]"


def chunk_limit(limit: int = DEFAULT_CHUNK_LIMIT) -> int:
    return max(MIN_CHUNK_LIMIT, limit)


def normalize_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def trim_unicode(text: Column) -> Column:
    """Strip white space and line ends of any script on both sides."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_heading_marks(text: Column) -> Column:
    return F.btrim(text, F.lit("# "))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def file_extension(path: Column) -> Column:
    """Lower-cased extension without the dot; a leading dot does not start one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^./]+)$", 1))


def file_stem(path: Column) -> Column:
    """Last path component without its extension."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^./]+$", "$1")


def first_heading(text: Column) -> Column:
    """First line that starts with ``#`` once trimmed, without marks; null if there is none.

    A line of marks only gives an empty string.
    """
    lines = F.transform(F.split(text, ANY_NEWLINE), trim_unicode)
    return F.try_element_at(
        F.transform(F.filter(lines, lambda line: line.startswith("#")), strip_heading_marks), F.lit(1)
    )


def document_title(text: Column, path: Column) -> Column:
    return F.coalesce(first_heading(text), file_stem(path))


def segments(text: Column) -> Column:
    """Paragraphs: split on two LFs, trimmed, empty ones dropped."""
    parts = F.transform(F.split(text, "\n\n", -1), trim_unicode)
    return F.filter(parts, lambda part: part != "")


def heading_title(segment: Column, first_line_only: bool = False) -> Column:
    """Title of a heading segment, null for any other segment.

    The title is the whole segment without marks at its ends, so lines after a
    single LF stay in it unless ``first_line_only`` is set.
    """
    body = F.substring_index(segment, "\n", 1) if first_line_only else segment
    title = trim_unicode(strip_heading_marks(body))
    return F.when(segment.startswith("#") & (title != ""), title)


def heading_level(segment: Column) -> Column:
    """Count of leading marks, at least 1; only meaningful where a title exists."""
    return F.greatest(F.lit(1), F.char_length(segment) - F.char_length(F.ltrim(segment, F.lit("#"))))


def has_clusters(text: Column) -> Column:
    """True if the text may hold grapheme clusters of more than one code point.

    Three tests from cheap to exact: plain ASCII, Latin, and the list above.
    """
    beyond_ascii = (F.octet_length(text) > F.char_length(text)) | F.contains(text, F.lit("\r"))
    return beyond_ascii & text.rlike(_BEYOND_LATIN) & text.rlike(_NOT_STANDALONE)


def text_length(text: Column, unit: str = "grapheme") -> Column:
    """Length in grapheme clusters (default) or code points."""
    if unit == "codepoint":
        return F.char_length(text)
    return F.when(has_clusters(text), F.regexp_count(text, F.lit(r"\X"))).otherwise(F.char_length(text))


def _fill(text: Column, space: str, character: str, limit: int) -> Column:
    """Greedy line filling as one regular expression over space-joined words.

    From the start of a word, take the longest run of at most ``limit`` characters
    that ends at a word end, or else one over-long word whole.
    """
    joined = F.regexp_replace(text, f"{space}{{2,}}", " ")
    if space == " ":
        joined = F.btrim(joined, F.lit(" "))
    else:
        joined = F.regexp_replace(joined, f"^{space}|{space}$", "")
    word = rf"(?:(?!{space})\X)++" if character == r"\X" else "[^ ]+"
    pattern = rf"(?s)({character}{{1,{limit}}}(?={space}|\z)|{word})(?:{space}|\z)"
    return F.regexp_extract_all(joined, F.lit(pattern), F.lit(1))


def pack_words(text: Column, limit: int = DEFAULT_CHUNK_LIMIT, unit: str = "grapheme") -> Column:
    """Pieces of at most ``limit`` characters, broken at spaces.

    A text within the limit is returned unchanged; a word longer than the limit
    makes a piece of its own.
    """
    limit = chunk_limit(limit)
    whole = F.array(text)

    def by_code_point(value: Column) -> Column:
        return _fill(value, " ", ".", limit)

    short = F.char_length(text) <= limit
    if unit == "codepoint":
        pieces = by_code_point(text)
    else:
        by_cluster = F.when(F.regexp_count(text, F.lit(r"\X")) <= limit, whole).otherwise(
            _fill(text, f"(?: (?!{_JOINS_LEFT}))", r"\X", limit)
        )
        pieces = F.when(has_clusters(text), by_cluster).otherwise(by_code_point(text))
    # A text of spaces only has no words and stays whole.
    return F.when(short | (F.btrim(text, F.lit(" ")) == ""), whole).otherwise(pieces)


def let(value: Column, body) -> Column:
    """``body`` applied to ``value`` evaluated once, for use inside array functions."""
    return F.element_at(F.transform(F.array(value), body), 1)
