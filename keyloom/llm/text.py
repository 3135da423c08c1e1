"""Text normalisation shared by the text operators."""

from __future__ import annotations

import html
import re
import unicodedata

# fixed values: tags that sit inside a word or sentence and leave no gap when removed
INLINE_TAGS = ("a", "abbr", "b", "big", "code", "del", "em", "font", "i", "ins", "kbd", "mark", "s", "small", "span", "strike", "strong", "sub", "sup", "tt", "u", "wbr")
_INLINE = re.compile(r"</?(?:" + "|".join(INLINE_TAGS) + r")(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def unescape(text: str) -> str:
    """Entities resolved; twice, as escaped text is often escaped again."""
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    return text


# fixed values: fillers and joiners outside the format category
_FILLERS = frozenset("\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0")


def invisible(ch: str) -> bool:
    """Format characters, variation selectors, joiners and fillers."""
    return unicodedata.category(ch) == "Cf" or "\ufe00" <= ch <= "\ufe0f" or ch in _FILLERS


def plain(text: str) -> str:
    """Entities, tags, compatibility and invisible characters resolved; letter case kept."""
    text = unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = "".join(c for c in text if c.isascii() or not invisible(c))
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if c.isascii() or not invisible(c))
    return text


def words(text: str) -> list[str]:
    """Runs of letters and digits, case-folded."""
    text = plain(text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFC", text.casefold()))


_PIECE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?|</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)


def words_with_spans(text: str) -> list[tuple[str, int, int]]:
    """The words of :func:`words` with start and end in the original text."""
    chars: list[tuple[str, int, int]] = []
    at = 0
    for m in _PIECE.finditer(text):
        chars.extend((c, at + i, at + i + 1) for i, c in enumerate(text[at : m.start()]))
        piece = m.group()
        if piece[0] == "&":
            chars.extend((c, m.start(), m.end()) for c in unescape(piece))
        elif not _INLINE.fullmatch(piece):
            chars.append((" ", m.start(), m.end()))
        at = m.end()
    chars.extend((c, at + i, at + i + 1) for i, c in enumerate(text[at:]))
    out: list[tuple[str, int, int]] = []
    word, start, end = "", 0, 0
    for c, s, e in chars:
        if not c.isascii() and invisible(c):
            continue
        for x in c if c.isascii() else unicodedata.normalize("NFKC", c):
            if x.isalnum() or (word and unicodedata.category(x)[0] == "M"):
                if not word:
                    start = s
                word += x
                end = e
            elif word:
                out.append((word, start, end))
                word = ""
    if word:
        out.append((word, start, end))
    return [(unicodedata.normalize("NFKC", w).casefold(), s, e) for w, s, e in out]
