"""Text rules that several corpus operators share."""

from __future__ import annotations

import re
import unicodedata

import regex

#: Fixed characters of the cleaned-text rule: soft hyphen and zero-width space are removed.
INVISIBLE = "\u00ad\u200b"
#: Fixed letter ranges of a term: Latin with accents and Cyrillic.
TERM = re.compile("[A-Za-zÀ-ÖØ-öø-ſЀ-ӿ]+")
WORD = regex.compile(r"[\p{L}\p{N}]+")
NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")


def cleaned(text: str | None) -> str:
    """Invisible characters removed, then NFC, then lower case. Null counts as empty."""
    if not text:
        return ""
    if not text.isascii():
        for c in INVISIBLE:
            text = text.replace(c, "")
        text = unicodedata.normalize("NFC", text)
    return text.lower()


def terms(text: str | None) -> list[str]:
    """The terms of a text, in order."""
    return TERM.findall(cleaned(text))


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the cleaned text, in order."""
    return WORD.findall(cleaned(text))
