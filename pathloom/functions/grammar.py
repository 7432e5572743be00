"""Citations read by a grammar: one pass makes tokens, rules over the kinds of tokens name the parts.

A token's kind is one character, so a citation is a short string of kinds beside the tokens'
places in the text, and a rule is a pattern over kinds whose group is the part.  Both kinds of
entry are read so: short citations of curated lists (``citation_record``) and entries of a
reference section (``reference_entry``).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .citations import AGENCY_WORDS, ARTICLE_FORM, BOOK_WORDS, SHORT_FORM, SOURCE_PHRASES

# Books that are recorded whole, by the edition named.
KNOWN_BOOK = "Emergency Care for Hazardous Materials Exposure"
KNOWN_EDITIONS = {
    "2nd": "Bronstein, A.C., Currance, P.L.",
    "3rd": "Currance, P.L., Clements, B., Bronstein, A.C.",
}
#: Words that end an organization's name.
BODIES = ("Agency", "Administration", "Institute", "Organization", "Commission", "Department", "Service", "Programme")
#: Shortest title, longest list of authors, longest rest.
LEAST_TITLE, MOST_AUTHORS, MOST_REST = 6, 10, 150

#: Kinds of tokens: the first that fits.  Marks stand for themselves.
_KINDS = [
    ("U", r"(?:https?://|www\.)\S+"),
    ("o", r"\d+(?:st|nd|rd|th)\b"),
    ("9", r"\d{4}(?!\d)"),
    ("d", r"\d+"),
    ("e", r"et\b"),
    ("l", r"al\b"),
    ("a", r"and\b"),
    ("n", r"(?i:edition|ed)\b"),
    ("E", r"Eds?\b"),
    ("B", rf"(?:{'|'.join(BODIES)})\b"),
    ("A", r"[A-Z]{2,10}\b"),
    ("N", r"[A-Z][a-z]+(?![A-Za-z])"),
    ("I", r"[A-Z](?![A-Za-z])"),
    ("w", r"[^\W\d_]+"),
    ("-", r"[-–]"),
    ("m", r"[.,;:()]"),
    ("?", r"\S"),
]
_TOKEN = re.compile("|".join(f"({pattern})" for _, pattern in _KINDS))

# "E" is a name of its own only behind "(": elsewhere "Ed." counts as a mark of an edition, which comes first above.
_AUTHOR = r"N(?:,(?:I\.?I?\.?|A\.?))?"
#: Parts of a short citation: rules over kinds, tried in turn; the group is the part.
_RULES = {
    "short_authors": [r"^(Nel)\.?9"],
    "agency": [r"^A-"],
    "book_authors": [r"^([^;]*?N,I\.[^;]*?)(?:\([En]\.?\)\.?)?;"],
    "listed_authors": [rf"^({_AUTHOR}(?:[,;]a?{_AUTHOR})*)"],
    "article_title": [r"^NI?el\.?(.+?)\.A"],
    "edition_title": [r"^[^;]+;(?!Nel|N[NIAB])([^.]+)\.(?:[od]\w*n|.*9)"],
    "report_title": [r"\(9\)\.([^.]+)", r"\.9\.([^.]+)"],
    "organization": [r"^([NIAwBa.]*B)\.9\.", r"^(A-[^(]+)\(9\)", r"^([NIAwBa]+\(A\))(?=[NIAB]|$)", r"^([NIAwBa.]*B)\(9\)"],
}
_RULES = {part: [re.compile(rule) for rule in rules] for part, rules in _RULES.items()}


class Tokens:
    """A citation's tokens: ``kinds`` (a character each) and where each stands in the text."""

    def __init__(self, text: str) -> None:
        self.text, self.spans, kinds = text, [], []
        for m in _TOKEN.finditer(text):
            self.spans.append(m.span())
            kind = _KINDS[m.lastindex - 1][0]
            kinds.append(m[0] if kind == "m" else kind)
        self.kinds = "".join(kinds)

    def part(self, name: str) -> str | None:
        """The text of the first rule for a part that fits."""
        for rule in _RULES[name]:
            if m := rule.search(self.kinds):
                first, end = m.span(m.lastindex or 0)
                return self.text[self.spans[first][0] : self.spans[end - 1][1]].strip()
        return None

    def authors(self) -> str | None:
        if (short := self.part("short_authors")) is not None:
            return short
        if self.part("agency") is not None:
            return None
        listed = self.part("listed_authors")
        return self.part("book_authors") or (listed if listed and "," in listed and len(listed) > 3 else None)

    def title(self) -> str | None:
        low = self.text.replace("&", "and").lower()
        known = next((p for p in SOURCE_PHRASES if p.lower() in low), None)
        found = (self.part(p) for p in ("article_title", "edition_title", "report_title"))
        return known or next((t for t in found if t and len(t) >= LEAST_TITLE), None)

    def of_kind(self, kind: str) -> list[str]:
        return [self.text[a:b] for (a, b), k in zip(self.spans, self.kinds, strict=True) if k == kind]


def _kind(text: str) -> str:
    low = text.lower()
    named = lambda words: any(w in low for w in words)
    ladder = [
        ("journal_pmid", named(["pmid"])), ("author_year_short", re.match(SHORT_FORM, text)), ("agency_report", named(AGENCY_WORDS)), ("book", named(BOOK_WORDS)),
        ("journal_article", re.match(ARTICLE_FORM, text)), ("database", named(["http", "www."]) and named(["database", "haz-map"])),
    ]
    return next((name for name, holds in ladder if holds), "other")


def record_of(raw: str | None) -> dict | None:
    """A short citation's parts; null for a blank one.  A known book has the parts recorded for its edition."""
    text = (raw or "").strip()
    if not text:
        return None
    tokens = Tokens(text)
    years = [y for y in re.findall(r"\b(?:19|20)\d\d\b", text)]
    out = {"raw": text, "year": years[-1] if years else None, "url": None, "organization": None}
    edition = next((e for e in KNOWN_EDITIONS if e in text.lower()), None) if KNOWN_BOOK.lower() in text.lower() else None
    if edition:
        return out | {"authors": KNOWN_EDITIONS[edition], "title": KNOWN_BOOK, "kind": "book"}
    return out | {"url": next(iter(tokens.of_kind("U")), None), "authors": tokens.authors(), "title": tokens.title(), "organization": tokens.part("organization"), "kind": _kind(text)}


# How the parts of an entry in a reference section are written.  Of a part the first pattern that is found.
_YEAR = (r"\((\d{4})\)", r"(?:^|\s)(\d{4})[a-z]?[\s.]")
_DOI = r"(?i)(?:doi:?\s*)?(?:https?://doi\.org/)?(?:doi:?\s*)?([0-9.]+/[^\s)]+)"
_LINK = r"https?://[^\s)>\]<\"]+"
_BODY, _GUIDELINE, _PRESS = r"\bOECD\b", r"(?i)Test No\.\s*\d+", "OECD Publishing"
_GUIDELINE_TITLE = r"(?i)Test No\.\s*\d+:\s*([^,]+)"
_AUTHORS_END = r"\s*[(\[]?(?:\d{4}|[Ii]n|[Jj]ournal|Test)"
_NOT_AUTHORS = ("available", "Retrieved")
_QUOTED = r"[\"']([^\"']{10,})[\"']"
_SENTENCE = r"(?:^[^.]*?\.?\s+)?([A-Z][^.]{10,}?)\s+(?:Journal|in|In|Environ|Toxicol|Rev|Sci|Nature|Science)"
_JOURNAL = (
    r"(?:Journal of|journal of|Journal|journal)\s+([A-Za-z\s&]+?)\s*[.,]",
    r"in\s+([A-Z][a-z\s&]+?)\s+(?:\d{4}|Vol\.|volume|no\.|pp\.)",
    r"([A-Z][a-z\s]+(?:Journal|Review|Proceedings|Letters|Science|Nature|Toxicology|Environmental)[\w\s&]*?)\s*[.,:\s]",
)


class _Entry:
    """Parts found in an entry and what is left of it when they are taken out."""

    def __init__(self, text: str) -> None:
        self.text, self.taken = text, []

    def take(self, *patterns: str, whole: bool = True) -> str | None:
        for pattern in patterns:
            if m := re.search(pattern, self.text):
                self.taken.append(m[0] if whole else m[1])
                return m[1] if m.re.groups else m[0]
        return None

    def rest(self) -> str:
        left = self.text
        for part in self.taken:
            left = re.sub(re.escape(part), "", left, flags=re.IGNORECASE)
        return re.sub(r"\s+", " ", left).strip().strip(".,;: ")[:MOST_REST]


def entry_of(raw: str) -> dict:
    """Year, DOI, links, authors, title, journal and the rest of an entry; guidelines of a test programme have a form of their own."""
    entry = _Entry(raw)
    out = {"year": entry.take(*_YEAR) or "N/A", "doi": entry.take(_DOI), "urls": sorted(set(re.findall(_LINK, raw))), "authors": [], "title": "", "journal": ""}
    entry.taken += out["urls"]
    if re.search(_BODY, raw):
        if re.search(_GUIDELINE, raw):
            entry.taken.append("OECD")
            out |= {"authors": ["OECD"], "title": (entry.take(_GUIDELINE_TITLE) or "").strip(), "journal": entry.take(_PRESS) or ""}
    else:
        end = re.search(_AUTHORS_END, raw)
        listed = raw[: end.start()] if end else ""
        names = [] if "(" in listed else [n.strip() for n in re.split(r"\sand\s|&|,", listed)]
        names = [n for n in names if len(n) > 2 and not any(w in n for w in _NOT_AUTHORS)]
        entry.taken += names
        title = entry.take(_QUOTED) or (entry.take(_SENTENCE, whole=False) or "").strip(".,")
        out |= {"authors": names[:MOST_AUTHORS], "title": title, "journal": (entry.take(*_JOURNAL, whole=False) or "").strip()}
    return out | {"other_info": entry.rest()}


_TEXT = StringType()
_RECORD = StructType([StructField(n, _TEXT) for n in ("raw", "year", "url", "authors", "title", "organization", "kind")])
_ENTRY = StructType([StructField(n, ArrayType(_TEXT) if n in ("urls", "authors") else _TEXT) for n in ("year", "doi", "urls", "authors", "title", "journal", "other_info")])


@F.pandas_udf(_RECORD)
def citation_record(raw: pd.Series) -> pd.DataFrame:
    """raw, year, url, authors, title, organization and kind of a short citation; all null for a blank one."""
    nothing = dict.fromkeys(_RECORD.names)
    return pd.DataFrame([record_of(r) or nothing for r in raw], columns=_RECORD.names)


@F.pandas_udf(_ENTRY)
def reference_entry(raw: pd.Series) -> pd.DataFrame:
    """year, doi, urls, authors, title, journal and other_info of an entry of a reference section."""
    return pd.DataFrame([entry_of(r or "") for r in raw], columns=_ENTRY.names)
