"""Native column expressions for text: term patterns, HTML stripping, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character references that occur in exports, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
#: Endings after which a snippet is taken to be cut off.
ABBREVIATIONS = ("No.", "Jr.", "Sr.", "Dr.", "Mr.", "Ms.", "etc.", "vs.")
_HIDDEN = r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|template)\b.*?</\1\s*>"
_TAG = r"</?[A-Za-z][^>]*>"


def term_pattern(term: str, case_sensitive: bool = False) -> str:
    """A Java pattern for ``term`` as whole words, Unicode letters counting as such; blanks match any white space."""
    words = (term if case_sensitive else term.lower()).split()
    literal = r"\s+".join("".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in w) for w in words)
    return rf"(?U)\b{literal}\b"


def has_term(text: Column, term: str, case_sensitive: bool = False) -> Column:
    """Whether the text has the term; false for a null text."""
    return F.coalesce((text if case_sensitive else F.lower(text)).rlike(term_pattern(term, case_sensitive)), F.lit(False))


def unescape(text: Column) -> Column:
    for reference, char in ENTITIES.items():
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


def collapse(text: Column) -> Column:
    """Runs of white space (no-break spaces too) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_html(html: Column) -> Column:
    """Visible text, tags leaving nothing behind."""
    return collapse(unescape(F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), _TAG, "")))


def spaced_html(html: Column) -> Column:
    """Visible text, each tag leaving a blank."""
    return collapse(unescape(F.regexp_replace(F.regexp_replace(html, _HIDDEN, " "), r"<[^>]+>", " ")))


def has_content(value: Column, kind: str = "string") -> Column:
    """Whether there is anything: a text beyond white space, an array or map with elements, a number that isn't zero."""
    if kind in ("array", "map"):
        test = F.size(value) > 0
    elif kind == "string":
        test = F.length(F.regexp_replace(value, r"(?U)\s+", "")) > 0
    elif kind == "boolean":
        test = value
    else:
        test = value.isNotNull() if kind == "struct" else value != 0
    return F.coalesce(test, F.lit(False))


def has_visible_content(html: Column) -> Column:
    """As ``has_content`` of what is left without tags; an image counts."""
    return F.coalesce(html.rlike(r"(?i)<img\b"), F.lit(False)) | has_content(unescape(F.regexp_replace(html, r"<[^>]+>", "")))


def has_lower_term(low: Column, term: str) -> Column:
    """As ``has_term`` of a text in lower case: a plain search for its longest word first, the pattern only where that is found."""
    longest = max(term.lower().split(), key=len, default="")
    return F.coalesce(F.contains(low, F.lit(longest)) & low.rlike(term_pattern(term)), F.lit(False))


def first_position(low: Column, term: str) -> Column:
    """1-based position of the term's first occurrence in a text in lower case; 0 if it has none."""
    longest = max(term.lower().split(), key=len, default="")
    return F.when(F.contains(low, F.lit(longest)), F.regexp_instr(low, F.lit(term_pattern(term)))).otherwise(0)


def sentence_around(text: Column, at: Column, size: Column) -> Column:
    """The sentence of a cleaned text around ``size`` characters from position ``at`` on; null if cut off.

    Starts after the last full stop, exclamation or question mark that stands before an upper-case
    character at or before ``at``; ends with the first such mark after these characters.
    """
    skipped = F.length(F.regexp_extract(F.substring(text, F.lit(1), at), r"^(.*[.!?] *)\p{Lu}", 1))
    tail = F.regexp_extract(F.substring(text, at + size, F.length(text)), r"^[^.!?]*[.!?]?", 0)
    body = F.trim(F.concat(F.substring(text, skipped + 1, at + size - skipped - 1), tail))
    broken = body.rlike(r"\((www\.)?$") | F.trim(F.right(body, F.lit(4))).isin(*ABBREVIATIONS)
    return F.when(~broken, body)


def snippet(text: Column, term: str) -> Column:
    """The sentence around the first occurrence of ``term`` in a cleaned text; null if none or cut off."""
    at = first_position(F.lower(text), term)
    return F.when(at > 0, sentence_around(text, at, F.lit(term_length(term))))


def term_length(term: str) -> int:
    """Characters a term takes in a cleaned text."""
    return len(" ".join(term.split()))


def without_overlaps(snippets: Column) -> Column:
    """Snippets in order, each one left out that holds, or is held by, one already taken."""
    held = lambda taken, x: F.exists(taken, lambda y: F.contains(y, x) | F.contains(x, y))
    return F.aggregate(snippets, F.array().cast("array<string>"), lambda taken, x: F.when(x.isNull() | held(taken, x), taken).otherwise(F.concat(taken, F.array(x))))


def split_case_flag(term: str) -> tuple[str, bool]:
    """``cs:`` in front of a term asks for its exact case."""
    return (term[3:], True) if term.startswith("cs:") else (term, False)


def parse_term_groups(groups: list[str]) -> dict[str, list[str]]:
    """``name=one|two`` as name to spellings; a name that comes again adds to its spellings."""
    found: dict[str, list[str]] = {}
    for group in groups:
        name, sign, spellings = group.partition("=")
        terms = [t.strip() for t in spellings.split("|") if t.strip()]
        if not sign or not name.strip() or not terms:
            raise ValueError(f"a term group is name=one|two, not {group!r}")
        known = found.setdefault(name.strip(), [])
        known += [t for t in terms if t not in known]
    return found
