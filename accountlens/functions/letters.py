"""How letters fold: tables from the Unicode data of Python, and fixed ones for what it does not say."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts as they are written in Latin ones, and Latin letters that are no letter with a mark.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"', "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ї": "yi", "ґ": "g", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "tsh", "џ": "dzh",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "ı": "i", "ħ": "h", "ŋ": "ng", "ŧ": "t", "ĸ": "k", "ſ": "s",
}
_LATIN = str.maketrans(LATIN)
_ASIDE = re.compile("[–—’‘“”]")


def plain_letters(text: str) -> str:
    """Lower case in Latin letters without marks; what has no Latin letter goes."""
    known = _ASIDE.sub(" ", text).lower().translate(_LATIN)
    return unicodedata.normalize("NFKD", known).lower().translate(_LATIN).casefold().encode("ascii", "ignore").decode()


@lru_cache(maxsize=1)
def marked_letters() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(letters, what each becomes, (letter, letters) pairs): plain_letters() of the lower-case letters of the Latin, Greek and Cyrillic blocks that do not stay."""
    one, many = {}, []
    for cp in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB07)):
        c = chr(cp)
        if c.isalpha() and c == c.lower() and (plain := plain_letters(c)):
            if len(plain) == 1:
                one[c] = plain
            else:
                many.append((c, plain))
    return "".join(one), "".join(one.values()), tuple(many)


@lru_cache(maxsize=1)
def casefolds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(letters, what each becomes, (letter, letters) pairs): of lower-case letters those that case folding changes further."""
    one, many = {}, {}
    for cp in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        low = chr(cp).lower()
        if len(low) == 1 and (fold := chr(cp).casefold()) != low:
            (one if len(fold) == 1 else many)[low] = fold
    return "".join(one), "".join(one.values()), tuple(sorted(many.items()))


@lru_cache(maxsize=8)
def gate(letters: str) -> str:
    """A class of characters as a pattern: at least all whose lower case, at the end of a word too, holds one of these letters. Exact below U+0100, few ranges above, so that a test of a character takes few steps."""
    wanted = set(letters)
    points = [cp for cp in (*range(0x80, 0xD800), *range(0xE000, 0x20000)) if not wanted.isdisjoint(f"{chr(cp)} a{chr(cp)}".lower())]
    spans: list[list[int]] = []
    for cp in points:
        if spans and (cp == spans[-1][1] + 1 or spans[-1][0] >= 0x100 and cp - spans[-1][1] <= 16):
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"
