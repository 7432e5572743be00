"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans (emails, IP addresses, card and phone numbers), each found in time
linear in the text.  The random field adds what they leave: candidate segments of up to
``MOST_TOKENS`` tokens are scored whole (shape, counts of digits, check sums, separators, what
stands before), and dynamic programming over segment ends picks boundaries and types jointly.
Only segments holding a digit, an at sign or a written-out one ("(at)", "[at]", "at ... dot")
can be entities; elsewhere the best path is outside, so only regions around these are decoded.  The field is trained here, on
sentences made up from a fixed seed.

Defined cases: a null text counts as empty and has no spans; a long text, digits alone or not, is
scored in windows that overlap by the bound of an entity; null keys and repeated rows are
kept one for one; other columns are ignored; empty tables give an empty result.  Offsets are
code points, ends exclusive.  Added spans never touch a base span or one another.
"""

from __future__ import annotations

import math
import random
import re
from array import array
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text

KINDS = ("email", "ip", "card", "phone")
ADDED = (*KINDS, "secret")
ORDER = {kind: i for i, kind in enumerate(ADDED)}
Span = tuple[int, int, str]

# Base patterns.

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        if i % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    found, at, taken = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        taken = domain.end() if domain else at + 1
        if domain:
            found.append((start, taken, "email"))
        at = text.find("@", taken)
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start, then kind."""
    found = _emails(text)
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


# The random field.

#: Bounds of an entity of several tokens; one of a single token has any length.
MOST_TOKENS = 14
MOST_CHARS = 96
MOST_GAPS = 6
AROUND = 64
_TRIGGER = re.compile(r"[0-9@]|(?:(?<=[\[(])|(?<=[\[(]\s))at(?=\s?[\])])|\bat(?=\s{1,3}[a-z0-9-]{1,63}\s{0,3}(?:[\[(]\s?)?dot\b)", re.IGNORECASE)
_TOP = re.compile(r"\b(?:com|org|net|edu|gov|mil|info|biz|[a-z]{2})$")
_TOKEN = re.compile(r"[^\W_]+|_+|[^\w\s]")
_WORDS = {"password": 0, "passwd": 0, "pwd": 0, "token": 0, "secret": 0, "key": 0, "apikey": 0, "phone": 1, "tel": 1, "call": 1, "fax": 1, "mobile": 1, "card": 2, "visa": 2, "email": 3, "mail": 3, "contact": 3, "ip": 4, "host": 4, "address": 4, "version": 5, "v": 5, "license": 5, "page": 5, "year": 5}
_OPENERS, _CLOSERS = set("+("), set(")")


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within ``AROUND`` characters of a digit, at sign or written-out one, out to the ends of runs of letters and digits; overlapping ones merged."""
    found: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        known = found[-1][1] if found else 0
        high = min(len(text), m.end() + AROUND)
        if found and high <= known:
            continue
        while 0 < high < len(text) and text[high - 1].isalnum() and text[high].isalnum():
            high += 1
        low = max(known, m.start() - AROUND)
        while low > known and text[low - 1].isalnum() and text[low].isalnum():
            low -= 1
        if found and low <= known:
            found[-1] = (found[-1][0], high)
        else:
            found.append((low, high))
    return found


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Segments (first token, token after the last) that could be an entity."""
    found = []
    kinds = [text[s] for s, _ in tokens]
    at = np.array([m.start() for m in _TRIGGER.finditer(text)], dtype=np.int64)
    triggers = np.cumsum([0] + [a < b for a, b in np.searchsorted(at, np.array(tokens, dtype=np.int64).reshape(-1, 2)).tolist()]).tolist()
    for i, first in enumerate(kinds):
        if not (first.isalnum() or first in _OPENERS):
            continue
        gaps = 0
        for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
            gaps += tokens[j - 1][0] > tokens[j - 2][1] and j > i + 1
            if gaps > MOST_GAPS or j > i + 1 and tokens[j - 1][1] - tokens[i][0] > MOST_CHARS:
                break
            if triggers[j] > triggers[i] and (kinds[j - 1].isalnum() or kinds[j - 1] in _CLOSERS):
                found.append((i, j))
    return found


def segment_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[float]:
    """What a whole segment looks like, and what stands around it."""
    start, end = tokens[i][0], tokens[j - 1][1]
    body = text[start:end]
    digits = _digits(body)
    n, d = len(body), len(digits)
    groups = re.split(r"[^0-9]+", body.strip("()+ "))
    letters = sum(c.isalpha() for c in body)
    spaces = sum(c.isspace() for c in body)
    low = body.lower()
    words = re.findall(r"[a-z]+", low)
    dotted = bool(_DOTTED.fullmatch(low))
    mail = bool(_MAIL.fullmatch(low))
    before = text[max(0, start - 24) : start]
    hint = [0.0] * 6
    near = re.findall(r"[a-z]+", before.lower())[-2:]
    for w in near:
        if w in _WORDS:
            hint[_WORDS[w]] = 1.0
    glued_left = start > 0 and text[start - 1].isalnum()
    glued_right = end < len(text) and text[end].isalnum()
    solid = spaces == 0
    hexed = solid and bool(re.fullmatch(r"[0-9a-f]+", body)) and letters > 0
    keyed = solid and bool(re.fullmatch(r"[A-Z0-9]+", body)) and letters > 0
    mixed = solid and bool(re.fullmatch(r"[A-Za-z0-9_+/=-]+", body)) and letters > 0 and d > 0
    return [
        1.0, float(mail), float("@" in body), float(dotted), float(dotted and all(int(g or 0) <= 255 for g in groups)),
        float(12 <= d <= 19), float(12 <= d <= 19 and luhn(digits)), float(letters == 0 and 12 <= d <= 19 and luhn(digits)),
        float(9 <= d <= 15 and letters == 0), float(d == 10 and letters == 0), float(body[0] in "+("), float(body[0] == "+"),
        float(bool(_LOCAL_PHONE.fullmatch(body))),
        float(letters == 0), d / max(1, n), float(d <= 2), float(3 <= d <= 6), float(d > 19), 0.0 if mail else spaces / 4.0, float(spaces > 4 and not mail), len(words) / 4.0, float(len(words) > 5),
        float(hexed and n >= 16), float(hexed and n >= 32), float(keyed and n >= 16), float(body.startswith("AKIA")), float(mixed and n >= 12), float(mixed and n >= 12 and hint[0] > 0),
        float(n < 6), float(n < 10), min(n, 64) / 32.0, float(glued_left), float(glued_right), float(before.endswith(("=", ":", '"', "= ", ": "))), *hint, float(d > 0 and len(words) > 1 and not mail), float(j - i == 1),
        float(mail and _TOP.search(low) is not None),
    ]


#: Tokens and characters whose segments are scored at a time.
WINDOW_TOKENS, WINDOW_CHARS = 1 << 11, 1 << 16
_MAIL = re.compile(r"[a-z0-9._%+-]+\s*(?:@|[\[(]\s*at\s*[\])]|\bat\b)\s*[a-z0-9-]+(?:\s*(?:\.|[\[(]\s*dot\s*[\])]|\bdot\b)\s*[a-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]{1,3}(?:\s*(?:\.|\[\.\]|\(\.\)|dot)\s*[0-9]{1,3}){3}")
_LOCAL_PHONE = re.compile(r"\+?[0-9]{0,3}[\s.-]*\(?[0-9]{3}\)?[\s.-]*[0-9]{3}[\s.-]+[0-9]{4}")
_KINDS_OF_CHARS = ("digit", "alpha", "space", "az", "hex", "key", "mixed", "alnum", "at", "dot")


def _kinds_of(c: str) -> list[bool]:
    plain = c.isascii()
    return [
        plain and c.isdigit(), c.isalpha(), c.isspace(), "a" <= c.lower()[0] <= "z", plain and (c.isdigit() or c in "abcdef"), plain and (c.isdigit() or c.isupper()),
        plain and (c.isalnum() or c in "_+/=-"), c.isalnum(), c == "@", c == ".",
    ]


class _Counts:
    """Running counts of kinds of characters of a stretch, so that a segment's counts are differences."""

    def __init__(self, text: str) -> None:
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known, place = np.unique(self.codes, return_inverse=True)
        self.flags = dict(zip(_KINDS_OF_CHARS, np.array([_kinds_of(chr(c)) for c in known.tolist()], dtype=bool).reshape(-1, len(_KINDS_OF_CHARS)).T[:, place.ravel()], strict=True))
        self.before = {kind: self._running(flag) for kind, flag in self.flags.items()}
        # Letters a-z are one word as long as they follow one another (a dotted capital I ends its word when lower-cased).
        az, low = self.flags["az"], np.where((self.codes >= 65) & (self.codes <= 90), self.codes + 32, self.codes)
        goes_on = np.concatenate([[False], az[:-1] & (self.codes[:-1] != 0x130)])
        self.words_before = self._running(az & ~goes_on)
        spelled = lambda word: self._running(np.logical_and.reduce([np.concatenate([low[k:] == ord(c), np.zeros(min(k, len(low)), dtype=bool)]) for k, c in enumerate(word)]))
        self.at_before, self.dot_before = spelled("at"), spelled("dot")

    @staticmethod
    def _running(flag: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(flag, dtype=np.int32)])

    def number(self, kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.before[kind][b] - self.before[kind][a]

    def words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.flags["az"][a] + self.words_before[b] - self.words_before[a + 1]

    def spelled(self, before: np.ndarray, size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return before[np.maximum(b - size + 1, a)] - before[a] > 0

    def luhn(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the digits of segments pass the check: sums with every other digit doubled, for either parity, as differences."""
        values = self.codes[self.flags["digit"]].astype(np.int64) - 48
        doubled = np.where(values > 4, values * 2 - 9, values * 2)
        odd = np.arange(len(values)) % 2 == 1
        sums = [np.concatenate([[0], np.cumsum(np.where(odd == parity, doubled, values))]) for parity in (False, True)]
        first, end = self.before["digit"][a], self.before["digit"][b]
        return np.where(end % 2 == 0, sums[0][end] - sums[0][first], sums[1][end] - sums[1][first]) % 10 == 0


def _start_features(text: str, start: int) -> list[float]:
    """What stands before a segment: hints by the last two words, and whether a sign introduces it."""
    before = text[max(0, start - 24) : start]
    hint = [0.0] * 6
    for w in re.findall(r"[a-z]+", before.lower())[-2:]:
        if w in _WORDS:
            hint[_WORDS[w]] = 1.0
    return [float(before.endswith(("=", ":", '"', "= ", ": "))), *hint]


def window_features(text: str, counts: _Counts, base: int, starts: np.ndarray, ends: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """``segment_features`` of many segments at once (places in ``text``, ``counts`` of it from ``base`` on, numbers of tokens); patterns are tried where the counts allow them."""
    a, b = starts - base, ends - base
    n = b - a
    d, letters, spaces = (counts.number(k, a, b) for k in ("digit", "alpha", "space"))
    words = counts.words(a, b)
    flag = lambda kind, at: counts.flags[kind][at]

    def tried(where: np.ndarray, test: Callable[[str], bool]) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        for s in np.flatnonzero(where).tolist():
            out[s] = test(text[starts[s] : ends[s]])
        return out

    has_at = (counts.number("at", a, b) > 0) | counts.spelled(counts.at_before, 2, a, b)
    has_dot = (counts.number("dot", a, b) > 0) | counts.spelled(counts.dot_before, 3, a, b)
    mail = tried((tokens > 2) & has_at & has_dot, lambda x: _MAIL.fullmatch(x.lower()) is not None)
    top = np.zeros(len(a), dtype=bool)
    for s in np.flatnonzero(mail).tolist():
        top[s] = _TOP.search(text[starts[s] : ends[s]].lower()) is not None
    dotted = tried((d >= 4) & (d <= 12) & (n <= MOST_CHARS) & (n - d - spaces >= 3) & flag("digit", a) & flag("digit", b - 1), lambda x: _DOTTED.fullmatch(x.lower()) is not None)
    octets = tried(dotted, lambda x: all(int(g or 0) <= 255 for g in re.split(r"[^0-9]+", x)))
    tail = np.maximum(b - 4, a)
    local = tried((letters == 0) & (d >= 10) & (d <= 13) & (n >= 10) & (counts.number("digit", tail, b) == 4), lambda x: _LOCAL_PHONE.fullmatch(x) is not None)
    long = (d >= 12) & (d <= 19)
    passes = long & counts.luhn(a, b)
    bare, solid = letters == 0, spaces == 0
    first = counts.codes[a]
    glued_left = (a > 0) & flag("alnum", np.maximum(a - 1, 0))
    last = np.minimum(b, len(counts.codes) - 1)
    glued_right = (b < len(counts.codes)) & flag("alnum", last)
    hexed = solid & (counts.number("hex", a, b) == n) & (letters > 0)
    keyed = solid & (counts.number("key", a, b) == n) & (letters > 0)
    mixed = solid & (counts.number("mixed", a, b) == n) & (letters > 0) & (d > 0)
    akia = n >= 4
    for k, c in enumerate("AKIA"):
        akia = akia & (counts.codes[np.minimum(a + k, len(counts.codes) - 1)] == ord(c))
    where, which = np.unique(starts, return_inverse=True)
    ahead = np.array([_start_features(text, s) for s in where.tolist()]).reshape(-1, 7)[which.ravel()].T
    hints = ahead[1:]
    columns = [
        np.ones(len(a)), mail, counts.number("at", a, b) > 0, dotted, octets,
        long, passes, bare & passes, (d >= 9) & (d <= 15) & bare, (d == 10) & bare, (first == ord("+")) | (first == ord("(")), first == ord("+"),
        local, bare, d / np.maximum(1, n), d <= 2, (d >= 3) & (d <= 6), d > 19, np.where(mail, 0.0, spaces / 4.0), (spaces > 4) & ~mail, words / 4.0, words > 5,
        hexed & (n >= 16), hexed & (n >= 32), keyed & (n >= 16), akia, mixed & (n >= 12), mixed & (n >= 12) & (hints[0] > 0),
        n < 6, n < 10, np.minimum(n, 64) / 32.0, glued_left, glued_right, ahead[0], *hints, (d > 0) & (words > 1) & ~mail, tokens == 1,
        mail & top,
    ]
    return np.column_stack(columns).astype(np.float64)


class Field:
    """Weights of segment features for each type; outside tokens score 0."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def decode(self, text: str) -> list[Span]:
        """The best segmentation's entities in a stretch of text.

        Segments are scored window by window, and only those that score above 0 are kept, so a
        stretch of any length needs a few bytes for each token.
        """
        bounds = array("i")
        for m in _TOKEN.finditer(text):
            bounds.extend(m.span())
        tokens = np.frombuffer(bounds, dtype=np.int32).reshape(-1, 2).astype(np.int64)
        if not len(tokens):
            return []
        at = np.array([m.start() for m in _TRIGGER.finditer(text)], dtype=np.int64)
        triggers = np.concatenate([[0], np.cumsum(np.searchsorted(at, tokens[:, 0]) < np.searchsorted(at, tokens[:, 1]))])
        gaps = np.concatenate([[0], np.cumsum(tokens[1:, 0] > tokens[:-1, 1])])
        path = _Path(len(tokens))
        first = 0
        while first < len(tokens):
            end = min(first + WINDOW_TOKENS, int(np.searchsorted(tokens[:, 1], tokens[first, 0] + WINDOW_CHARS, side="right")))
            end = max(first + 1, end)
            path.extend(end, *self._scored(text, tokens, triggers, gaps, first, end))
            first = end
        return [(int(tokens[i, 0]), int(tokens[j - 1, 1]), ADDED[kind]) for i, j, kind in path.entities()]

    def _scored(self, text: str, tokens: np.ndarray, triggers: np.ndarray, gaps: np.ndarray, first: int, end: int) -> tuple[np.ndarray, ...]:
        """Segments that begin with one of some tokens and score above 0: first token, token after the last, score, type."""
        if end == first + 1 and tokens[first, 1] - tokens[first, 0] > WINDOW_CHARS:  # one token, too long to be part of more
            span = tuple(tokens[first].tolist())
            held = triggers[first + 1] > triggers[first] and text[span[0]].isalnum()
            i, j = np.array([first] * held, dtype=np.int64), np.array([first + 1] * held, dtype=np.int64)
            scores = np.array([segment_features(text, [span], 0, 1)] * held).reshape(len(i), self.weights.shape[1]) @ self.weights.T
        else:
            base = max(0, int(tokens[first, 0]) - 1)
            high = min(len(text), max(int(tokens[end - 1, 1]), int(tokens[end - 1, 0]) + MOST_CHARS) + 1)
            counts = _Counts(text[base:high])
            i = np.repeat(np.arange(first, end), MOST_TOKENS)
            j = i + 1 + np.tile(np.arange(MOST_TOKENS), end - first)
            there = (j <= len(tokens)) & (triggers[np.minimum(j, len(tokens))] > triggers[i])
            i, j = i[there], j[there]
            there = (gaps[j - 1] - gaps[i] <= MOST_GAPS) & ((j == i + 1) | (tokens[j - 1, 1] - tokens[i, 0] <= MOST_CHARS))
            i, j = i[there], j[there]
            opens, closes = tokens[i, 0] - base, tokens[j - 1, 0] - base
            is_ = lambda at, others: counts.flags["alnum"][at] | np.isin(counts.codes[at], [ord(c) for c in others])
            there = is_(opens, _OPENERS) & is_(closes, _CLOSERS)
            i, j = i[there], j[there]
            scores = window_features(text, counts, base, tokens[i, 0], tokens[j - 1, 1], j - i) @ self.weights.T if len(i) else np.zeros((0, len(self.weights)))
        best, kind = scores.max(axis=1), scores.argmax(axis=1)
        good = best > 0
        return i[good], j[good], best[good], kind[good]


class _Path:
    """The best segmentation of so many tokens, extended from window to window: a value, a start and a type for each token."""

    def __init__(self, n: int) -> None:
        self.value, self.start, self.kind, self.done = array("d", bytes(8 * (n + 1))), array("i", bytes(4 * (n + 1))), array("b", bytes(n + 1)), 0
        self.open = [np.zeros(0, dtype=np.int64)] * 4

    def extend(self, end: int, i: np.ndarray, j: np.ndarray, best: np.ndarray, kind: np.ndarray) -> None:
        """Segments of the next window, by their starts; all that end with its last token or before are known now."""
        columns = [np.concatenate(c) for c in zip(self.open, (i, j, best, kind), strict=True)]
        order = np.argsort(columns[1], kind="stable")
        columns = [c[order] for c in columns]
        ready = int(np.searchsorted(columns[1], end, side="right"))
        self.open = [c[ready:] for c in columns]
        starts, ends, scores, kinds = (c[:ready].tolist() for c in columns)
        value, s = self.value, 0
        for at in range(self.done + 1, end + 1):
            top = value[at - 1]
            while s < ready and ends[s] == at:
                now = value[starts[s]] + scores[s]
                if now > top:
                    top, self.start[at], self.kind[at] = now, starts[s], kinds[s] + 1
                s += 1
            value[at] = top
        self.done = end

    def entities(self) -> list[tuple[int, int, int]]:
        """First token, token after the last and type of each entity."""
        found, at = [], self.done
        while at > 0:
            if not self.kind[at]:
                at -= 1
                continue
            found.append((self.start[at], at, self.kind[at] - 1))
            at = self.start[at]
        return found[::-1]


def made_up(seed: int, n: int) -> list[tuple[str, list[Span]]]:
    """Sentences with entities of known place and type, and with numbers that are none."""
    draw = random.Random(seed)
    syllables = "an ber co der en fi gra ho in ka lo mi nen os pre qua re sa tion un ver wo é ción ä ñ ó ü è ".split()
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 3)))
    ascii_word = lambda: next(w for w in iter(word, "") if w.isascii())
    number = lambda k: "".join(draw.choice("0123456789") for _ in range(k))

    def card() -> str:
        head = draw.choice("3456") + number(draw.choice((13, 14, 14, 14)))
        digits = next(head + c for c in "0123456789" if luhn(head + c))
        sep = draw.choice(("", "", " ", "-", "."))
        return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4)) if sep else digits

    def unlucky() -> str:
        return next(x for x in iter(lambda: number(16), "") if not luhn(x))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return draw.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}"))

    def ip() -> str:
        return draw.choice((".", ".", "[.]", " dot ")).join(str(draw.randint(0, 255)) for _ in range(4))

    def email() -> str:
        at, dot = draw.choice((("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", ".")))
        numbered = draw.random() < 0.5
        name = word if draw.random() < 0.2 else ascii_word
        local = f"{name()}{draw.choice(('.', '_', ''))}{number(2)}" if numbered else draw.choice((name(), f"{name()}.{name()}"))
        return f"{local}{at}{name()}{number(1) if numbered else ''}{dot}{draw.choice(('com', 'org', 'net', 'example' + dot + 'com'))}"

    def secret() -> str:
        return draw.choice((lambda: "AKIA" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: "".join(draw.choice("0123456789abcdef") for _ in range(draw.choice((18, 32, 40, 64)))), lambda: "".join(draw.choice("ABCDEFGHabcdefghijkl0123456789") for _ in range(24))))()

    def plain() -> str:
        return draw.choice((f"version {number(1)}.{number(1)}", f"{draw.randint(1900, 2030)}", f"{number(2)}%", f"CC BY-NC {number(1)}.0", f"{number(1)}/{number(2)}", f"{number(1)},{number(3)},{number(3)}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"{word()}{number(1)}", f"{number(3)}.{number(2)}", f"v{number(1)}.{number(2)}.{number(1)}", f"@{word()}", f"{word()} at {word()} {number(2)}", f"{ascii_word()} at {ascii_word()} dot {ascii_word()}{ascii_word()}", number(draw.randint(1, 8)), unlucky(), unlucky()))

    makers = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    hints = {"email": ("mail ", "contact "), "ip": ("host ", "ip "), "card": ("card ", "visa "), "phone": ("call ", "tel: "), "secret": ("password=", 'token = "', "key: ", "secret ")}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(draw.randint(1, 3)):
            text += " ".join(word() for _ in range(draw.randint(1, 7))) + " "
            if draw.random() < 0.55:
                kind = draw.choice(ADDED)
                lead = draw.choice(hints[kind]) if draw.random() < (0.7 if kind == "secret" else 0.3) else ""
                made = makers[kind]()
                spans.append((len(text) + len(lead), len(text) + len(lead) + len(made), kind))
                text += lead + made + ('"' if lead.endswith('"') else "") + draw.choice((" ", ". ", ", "))
            else:
                text += plain() + draw.choice((" ", ". "))
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained_field(seed: int = 5, sentences: int = 400, rounds: int = 80) -> Field:
    """Maximum conditional likelihood over made-up sentences, by Adam on forward-backward gradients."""
    cases = []
    for text, spans in made_up(seed, sentences):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        segments = candidates(text, tokens)
        place = {(tokens[i][0], tokens[j - 1][1]): s for s, (i, j) in enumerate(segments)}
        gold = [(place[a, b], ORDER[kind]) for a, b, kind in spans if (a, b) in place]
        if segments:
            cases.append((len(tokens), segments, np.array([segment_features(text, tokens, i, j) for i, j in segments]), gold))
    weights = np.zeros((len(ADDED), cases[0][2].shape[1]))
    mean, spread = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        gradient = 2e-3 * weights * len(cases) / 10
        for n, segments, x, gold in cases:
            gradient += expected(n, segments, x @ weights.T).T @ x
            for s, k in gold:
                gradient[k] -= x[s]
        gradient /= len(cases)
        mean, spread = 0.9 * mean + 0.1 * gradient, 0.99 * spread + 0.01 * gradient**2
        weights -= 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Field(weights)


def expected(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of each segment and type over all segmentations of ``n`` tokens (log space)."""
    top = scores.max(axis=1)
    total = (top + np.log(np.exp(scores - top[:, None]).sum(axis=1))).tolist()
    ending, starting = defaultdict(list), defaultdict(list)
    for s, (i, j) in enumerate(segments):
        ending[j].append((i, total[s]))
        starting[i].append((j, total[s]))

    def summed(values: list[float]) -> float:
        peak = max(values)
        return peak + math.log(sum(math.exp(v - peak) for v in values))

    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = summed([forward[j - 1], *(forward[i] + v for i, v in ending[j])])
    for i in range(n - 1, -1, -1):
        backward[i] = summed([backward[i + 1], *(backward[j] + v for j, v in starting[i])])
    outside = np.array([forward[i] + backward[j] - forward[n] for i, j in segments])
    return np.exp(scores + outside[:, None])


def find_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and what the field adds."""
    if not text or _TRIGGER.search(text) is None:
        return [], []
    base = base_spans(text)
    added, b = [], 0
    cover = []
    for s, e, _ in sorted(base):
        if cover and s <= cover[-1][1]:
            cover[-1] = (cover[-1][0], max(e, cover[-1][1]))
        else:
            cover.append((s, e))
    for low, high in regions(text):
        for s, e, kind in field.decode(text[low:high]):
            s, e = s + low, e + low
            while b < len(cover) and cover[b][1] <= s:
                b += 1
            if b == len(cover) or cover[b][0] >= e:
                added.append((s, e, kind))
    return base, sorted(base + added, key=lambda x: (x[0], ORDER[x[2]]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SPAN_TYPE = "array<struct<start:int,end:int,kind:string,base:boolean>>"


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key and ``spans`` of every row of ``docs``: start, end, kind, and whether it is a base span; by start, then kind."""
    field = docs.sparkSession.sparkContext.broadcast(trained_field())
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column("text"):
            base, every = find_spans(text.as_py(), field.value)
            known = set(base)
            found.append([{"start": s, "end": e, "kind": k, "base": (s, e, k) in known} for s, e, k in every])
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, struct)], ["id", "spans"])

    out = arrow_map(id_and_text(docs, id_col, text_col), run, f"id {kind}, spans {SPAN_TYPE}")
    return out.select(F.col("id").alias(id_col), "spans")


def mask_spans(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the kind of its first one, in angle brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in ``text_col``; all other columns as they were."""
    field = docs.sparkSession.sparkContext.broadcast(trained_field())
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if (t := x.as_py()) is None else mask_spans(t, find_spans(t, field.value)[1]) for x in batch.column(at)]
        columns = batch.columns
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow_map(docs, run, docs.schema)


