"""Undoing disguises of words: look-alike letters, invisible characters, ligatures, markup, hyphens at line breaks; times as numbers."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic, Greek and Latin letters that look like a Latin letter, in pairs (letter, look).
LOOK_ALIKES = dict(
    zip(
        "аеорсухівԁѕјһԛԝкмнтгпАВЕКМНОРСТУХІЅЈԌαεορικυχντΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡſ",
        "aeopcyxibdsjhqwkmhtrnABEKMHOPCTYXISJGaeopikuxvtABEZHIKMNOPTYXiags",
        strict=True,
    )
)
_TABLE = str.maketrans(LOOK_ALIKES)
#: Zero-width and direction marks, soft hyphen, variation selectors.
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]")
#: A tag of any length: a name, then attributes with or without values; "a <b c> d" is one, "a<b, c>d" is none.
_TAG = re.compile(r"""</?[A-Za-z][\w:.-]*(?:\s+[A-Za-z_:@][\w:.-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))?)*\s*/?>""")
_ESCAPE = re.compile(r"\\(?:([nrt])|u([0-9a-fA-F]{4})|([\"/\\]))")
#: A hyphen (also with look-alikes) at a line break, with the quote marks a mail program puts before the next line.
_HYPHEN_BREAK = re.compile("[-\u2010\u2011\u00ac][ \t]*[\r\n\u2028\u2029\x85]+[ \t>|]*")


def _unescape(m: re.Match) -> str:
    if m[1]:
        return {"n": "\n", "r": "\n", "t": "\t"}[m[1]]
    return chr(int(m[2], 16)) if m[2] and not 0xD800 <= int(m[2], 16) <= 0xDFFF else m[3] or " "


def plain(text: str, folded: bool = True) -> str:
    """The text without markup, entities, escapes and invisible characters, hyphenated line breaks joined, in NFKC, folded in case."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "\n" in text or "\r" in text or not text.isascii():
        text = _HYPHEN_BREAK.sub("", text)
    return text.lower() if folded else text


def bare_word(word: str) -> str:
    """Letters and digits of a word only: NFKC, case folded, look-alikes as Latin letters where the word holds Latin letters too."""
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word)
        word = word.translate(_TABLE)
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return "".join(c for c in word.casefold() if c.isalnum())


def clock_micros(at: Column) -> Column:
    """Microseconds of a date or time as its clock shows it, so that no time zone reorders them; null stays before all times."""
    day = F.unix_date(F.to_date(at)).cast("long") * 86_400_000_000
    second = (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return F.coalesce(day + (F.hour(at) * 3600 + F.minute(at) * 60).cast("long") * 1_000_000 + second, F.lit(-(1 << 60)))
