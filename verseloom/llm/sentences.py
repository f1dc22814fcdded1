"""Sentence boundaries across languages and scripts.

The rules are the character-property sentence breaks of Unicode annex 29 (the classes come from the property tables of
the ``regex`` module, so every script's terminators are covered), with these tailorings: abbreviation suppression by the
text's language, quotations kept whole, blank lines as hard breaks, Thai spaces, and full stops whose space was lost.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.runtime import map_batches

#: Function words by which the language of a text in Latin script is told.
FUNCTION_WORDS = {
    "en": "the and of to in was is that for with on by as it at from his are",
    "de": "der die und das den nicht mit von ist ein im zu des dem auf sich eine in an am er sie wie",
    "fr": "le la les de et des une un est dans pour que du qui au en ce il sur sauf pas dit",
    "es": "el la los las de y del que un una por con en se lo su para dice",
    "it": "il la le di che della per gli non con sono nel un una è si del",
    "pt": "o a os as de e do da que um uma não com em ao se por",
    "nl": "de het een en van niet met voor zijn op dat te is in",
}
#: Abbreviations that stand before what they belong to, by language, as they are written.
BEFORE = {
    "en": "Mr Mrs Ms Dr Prof Sgt Capt Lt Col Gen Rev Hon Gov Sen Rep Messrs St Mt vs approx ca cf al ed eds viz e.g i.e eg ie",
    "de": "Dr Prof Hr Fr Frl St bzw vgl ca z z.B d.h u.a i.d.R sog evtl inkl bd",
    "fr": "M MM Mme Mmes Mlle Mlles Dr Pr Me St Ste cf av ca env ex p.ex c.-à-d",
    "es": "Sr Sra Sres Srta Dr Dra D D.ª Dña Ud Uds Av Avda Gral aprox ca p.ej",
    "it": "Sig Sig.ra Sigg Dott Dott.ssa Prof Ing Avv S cfr ca es p.es",
    "pt": "Sr Sra Srs Dr Dra Prof Profa Eng Av aprox ca p.ex",
    "nl": "Dhr Mevr Mw Dr Prof Mr St ca bijv bv vgl d.w.z o.a",
    "": "г гг ул д т т.е т.д т.п им см пр тов проф د أ م डॉ श्री",
}
#: Abbreviations that stand before a number; elsewhere their full stop ends a sentence.
NUMBERED = {
    "en": "no nos fig figs vol vols p pp art ch chap sec eq",
    "de": "nr abb bd bde str kap art abs tab",
    "fr": "no nos n fig vol p pp art chap",
    "es": "núm núms pág págs n.º fig vol art cap",
    "it": "n nn pag pagg fig vol art cap",
    "pt": "n núm pág págs fig vol art cap",
    "nl": "nr blz fig art hfst",
    "": "стр рис табл гл ст",
}
#: Abbreviations that end a sentence only where a capital or another script's sentence follows.
MAY_END = frozenset("a.m p.m inc ltd co corp etc usw u.s jr bros dept univ".split())
_MARKS = {lang: {form: kind for kind, table in (("before", BEFORE), ("number", NUMBERED)) for w in table[lang].split() for form in (w, w[:1].upper() + w[1:], w.upper() if len(w) > 1 else w)} for lang in BEFORE}
_KNOWN = frozenset(w for table in _MARKS.values() for w in table)
_LANGUAGES: dict[str, list[str]] = {}
for _lang, _ws in FUNCTION_WORDS.items():
    for _w in _ws.split():
        _LANGUAGES.setdefault(_w, []).append(_lang)
_FUNCTION = re.compile(r"\b(?:" + "|".join(sorted(_LANGUAGES)) + r")\b", re.IGNORECASE)
#: Month names after a German ordinal.
GERMAN_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
#: Opening quotation marks and the marks that close them.
QUOTES = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "‘": "’", "‹": "›", "《": "》", '"': '"', "（": "）", "(": ")"}

#: Characters that a token is first read back for; more are read only to see whether it is an address.
TOKEN = 200
_MARK = regex.compile(r"(?:[\p{SB=STerm}\p{SB=ATerm}…])+")
_BLANK = re.compile(r"(?:\r\n|\n|\r|\u2028|\u2029)[^\S\r\n\u2028\u2029]*(?:(?:\r\n|\n|\r|\u2028|\u2029)[^\S\r\n\u2028\u2029]*)+")
_CLOSE = regex.compile(r"[\p{SB=Close}\p{SB=Extend}\p{SB=Format}]*")
_SPACE = regex.compile(r"\s*")
_PART = regex.compile(r"[\s\p{SB=Close}¿¡,;:]")
_TOKEN = regex.compile(r"(?r)[^\s\p{SB=Close}¿¡,;:]*")
_WORD_BEFORE = regex.compile(r"(?r)([\p{L}\p{N}]+)\s+")
_THAI = regex.compile(r"(?<=\p{Thai})[ \u00a0]+(?=\p{Thai}|\p{Lu}|[0-9])|(?<=[0-9])[ \u00a0]+(?=\p{Thai})")
_LETTER = regex.compile(r"[\p{L}\p{N}]")
_LETTERS, _LAST_LETTERS, _CAPITAL, _UNCASED, _HIRAGANA = (regex.compile(x) for x in (r"\p{L}*", r"(?r)\p{L}*\Z", r"\p{Lu}", r"\p{Lo}", r"\p{Hiragana}"))
_CONTINUES, _NUMBER, _INITIALS, _SHORT_NUMBER = (regex.compile(x) for x in (r"[\p{SB=SContinue}/]", r"[\p{N}IVXLC#(]", r"(?:\p{L}\.)+\p{L}", r"\d{1,2}"))
_SKIP = regex.compile(r"[^\p{L}\p{N}\s\p{STerm}]*")
_UNSPACED = regex.compile(r"\p{Han}|\p{Hiragana}|\p{Katakana}|\p{Thai}")
_ORDINAL_BEFORE = frozenset("am vom der den dem zum des die das im bis".split())
_QUOTE_START = regex.compile("[" + "".join(map(regex.escape, QUOTES)) + "]")


def _quotations(text: str) -> list[tuple[int, int]]:
    """Spans of closed quotations and brackets, outermost only. An unclosed mark opens nothing."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := _QUOTE_START.search(text, at):
        i, mark = m.start(), m.group()
        at = i + 1
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if mark in "‘\"»" and before and (before.isalnum() or (mark == "»" and not before.isspace())):
            continue  # an apostrophe, or the closing mark of something unopened
        if mark in "‘\"" and (not after or after.isspace()):
            continue
        ends = [e for c in QUOTES[mark] if (e := text.find(c, i + 1)) > i]
        if mark == "„" and ends:
            end = min(ends)
        else:
            end = ends[0] if ends else -1
        if mark == "‘":  # apostrophes inside: the mark must not stand between letters
            while end > 0 and text[end + 1 : end + 2].isalpha():
                end = text.find("’", end + 1)
        if mark in "(（" and end > 0 and not _MARK.search(text, i, end):
            continue
        if end > i:
            out.append((i, end))
            at = end + 1
    return out


def language(*texts: str) -> str:
    """The language of a text in Latin script, by its function words: that of the first of the texts given, from near to
    far, in which one language has two words or more, and more than any other; English where there is none."""
    for text in texts:
        votes = Counter(lang for w in _FUNCTION.findall(text) for lang in _LANGUAGES[w.lower()]).most_common(2)
        if votes and votes[0][1] > 1 and (len(votes) < 2 or votes[0][1] > votes[1][1]):
            return votes[0][0]
    return "en"


def _is_name_or_unit(text: str, start: int, at: int, token: str) -> bool:
    """Whether a token that is mostly a title belongs to the word before it: a street's name, or a measure."""
    before = _WORD_BEFORE.match(text, max(start, at - TOKEN), at)
    if not before:
        return False
    word = before.group(1)
    if token == "St":
        return word[:1].isupper() and before.start(1) > start and text[start : before.start(1)].strip() != ""
    return token in ("см", "м") and word[-1:].isdigit()


class _Text:
    """A text and its tokens before full stops."""

    def __init__(self, text: str):
        self.text, self.long = text, (0, 0, False)

    def abbreviation(self, token: str, part: str, start: int, at: int) -> str | None:
        """``before`` or ``number`` if the token is an abbreviation of the language of the sentence at hand, else of its
        paragraph, else of the text."""
        if token not in _KNOWN:
            return None
        return _MARKS[""].get(token) or _MARKS[language(part[start : at + TOKEN // 2], part, self.text)].get(token)

    def token(self, part: str, at: int) -> tuple[str, bool]:
        """What stands before ``at`` without a space or bracket, and whether it looks like an address. Of a token of more
        than ``TOKEN`` characters, which is no abbreviation, only the end is given; marks are sought in all of it, but
        never twice in the same characters."""
        found = part[max(0, at - TOKEN) : at]
        if not found or found[-1].isspace():
            return "", False
        found = found.rsplit(None, 1)[-1]
        if not found.isalnum():
            found = _TOKEN.match(found).group()
        if len(found) < TOKEN:
            return found, "/" in found or "@" in found or "." in found
        first, seen, marked = self.long
        if not first < at - TOKEN <= seen or seen > at or _PART.search(part, seen, at):
            first = seen = _TOKEN.match(part, 0, at).start()
            marked = False
        rest = part[seen:at]
        self.long = (first, at, marked or "/" in rest or "@" in rest or "." in rest)
        return found, self.long[2]


def _ends(text: str, whole: _Text) -> list[int]:
    """End offsets of the sentences of one paragraph of the text ``whole``, which holds no blank line."""
    whole.long = (0, 0, False)
    out: list[int] = []
    spans = _quotations(text)
    k = 0  # the first quotation that isn't behind
    start = 0  # where the sentence at hand began
    thai = {m.start() for m in _THAI.finditer(text)} if _UNSPACED.search(text) else ()
    inside = lambda i: any(a < i <= b for a, b in spans[k : k + 2])
    stops = sorted([(m.start(), m.end()) for m in _MARK.finditer(text)] + [(i, i) for i in thai])
    for a, b in stops:
        if a < start:
            continue
        while k < len(spans) and spans[k][1] < a:
            k += 1
        if a == b:  # a Thai space
            if not inside(a):
                out.append(a)
                start = a
            continue
        quoted = k < len(spans) and spans[k][0] < a <= spans[k][1]
        end = _CLOSE.match(text, b).end()
        if quoted:
            close = spans[k][1] + 1
            if end < close:
                continue  # the quotation goes on
            opened, end = spans[k][0], _CLOSE.match(text, close).end()
        elif end > b and k < len(spans) and (first := max(b, spans[k][0])) < end:
            end = first  # the marks after it open something
        gap = _SPACE.match(text, end).end()
        rest = text[gap : gap + 1]
        if not rest:
            break
        mark = text[a:b]
        soft = all(c in ".…․﹒．" for c in mark) or mark == "…"
        if _CONTINUES.match(rest) and rest not in "-–—":
            continue
        letter = text[gap + len(_SKIP.match(text, gap).group()) :][:2] if not rest.isalnum() else text[gap : gap + 2]
        lower = letter[:1].islower() and not letter[1:2].isupper()
        if quoted:
            introduced = _LETTER.search(text, start, opened)
            if lower or (gap == end and (_HIRAGANA.match(rest) or (not introduced and not text[opened] in "(（"))):
                continue
            out.append(end)
            start = end
            continue
        if soft:
            if lower:
                continue
            token, url = whole.token(text, a)
            token = token.lstrip("(¿¡-–—'’")
            bare = token.rstrip(".")
            plain = bare.lower()
            if gap == end:  # no white space after it
                head = text[gap : gap + 2]
                word = _LAST_LETTERS.search(token).group()
                if _UNSPACED.match(rest):
                    pass
                elif url or len(word) < 3 or not (head[:1].isupper() and head[1:2].islower()) or len(mark) > 1:
                    if len(mark) == 1 or not head[:1].isupper():
                        continue
            elif len(mark) == 1 and mark in ".．":
                kind = whole.abbreviation(bare, text, start, gap)
                if kind == "number" and _NUMBER.match(text, gap):
                    continue
                if kind == "before" and not _is_name_or_unit(text, start, a - len(token), bare):
                    continue
                if plain in MAY_END and not letter[:1].isupper() and not _UNCASED.match(letter[:1] or " "):
                    continue
                if _CAPITAL.fullmatch(text[a - 1 : a]) and (len(plain) == 1 or _INITIALS.fullmatch(plain)) and not (len(plain) > 1 and plain in MAY_END):
                    continue  # initials
                if _SHORT_NUMBER.fullmatch(plain):
                    following = _LETTERS.match(text, gap).group().lower()
                    before = regex.search(r"(\p{L}+)\s+\Z", text[max(0, a - len(token) - 16) : a - len(token)])
                    if following in GERMAN_MONTHS or (before and before.group(1).lower() in _ORDINAL_BEFORE):
                        continue
        out.append(end)
        start = end
    tail = len(text.rstrip())
    if tail and (not out or out[-1] < tail) and text[out[-1] if out else 0 : tail].strip():
        out.append(tail)
    return out


def sentence_ends(text: str | None) -> list[int]:
    """For each sentence, the number of code points from the start of the text to just after its last character."""
    if not text or not text.strip():
        return []
    back = None
    if "\u00ad" in text or "\u200b" in text:  # read as if they weren't there; the offsets are of the text as stored
        back = [i for i, c in enumerate(text) if c not in "\u00ad\u200b"]
        text = "".join([text[i] for i in back])
    out: list[int] = []
    at, whole = 0, _Text(text)
    for m in _BLANK.finditer(text):
        out += [at + e for e in _ends(text[at : m.start()], whole)]
        at = m.end()
    out += [at + e for e in _ends(text[at:], whole)]
    return [back[e - 1] + 1 for e in out] if back is not None else out


def sentences(df: DataFrame, id_col: str, text_col: str, with_text: bool = True) -> DataFrame:
    """Every sentence of every text, in order: the id, ``sentence_no`` from 0, ``start_char`` and ``end_char`` (code
    points of the text as stored), and ``sentence`` if ``with_text``.

    Null, empty and blank texts have no sentences; rows with equal ids each give theirs; other columns are ignored. A
    null id stays null. A text is handled whole, in one pass, however long it is.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(ids: pa.Array, texts: pa.Array):
        out: dict[str, list] = {"id": [], "sentence_no": [], "start_char": [], "end_char": []} | ({"sentence": []} if with_text else {})
        for i, text in zip(ids.to_pylist(), texts.to_pylist()):
            at = 0
            for n, end in enumerate(sentence_ends(text)):
                first = at + len(text[at:end]) - len(text[at:end].lstrip())
                out["id"].append(i)
                out["sentence_no"].append(n)
                out["start_char"].append(first)
                out["end_char"].append(end)
                if with_text:
                    out["sentence"].append(text[first:end])
                at = end
        yield out

    made = map_batches(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")), run, f"id {kind}, sentence_no int, start_char bigint, end_char bigint" + (", sentence string" if with_text else ""))
    return made.withColumnRenamed("id", id_col)
