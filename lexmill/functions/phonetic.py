"""Primary double-metaphone codes (L. Philips, 2000), written as rules by letter."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

VOWELS = "AEIOUY"


class _Word:
    def __init__(self, text: str):
        self.t = text
        self.last = len(text) - 1
        self.slavic = any(x in text for x in ("W", "K", "CZ", "WITZ"))

    def at(self, i: int, *options: str) -> bool:
        """Whether one of the options stands at place i."""
        return i >= 0 and any(self.t.startswith(o, i) for o in options)

    def vowel(self, i: int) -> bool:
        return 0 <= i <= self.last and self.t[i] in VOWELS

    @property
    def germanic(self) -> bool:
        return self.at(0, "VAN ", "VON ", "SCH")


def _c(w: _Word, i: int) -> tuple[str, int]:
    if i > 1 and not w.vowel(i - 2) and w.at(i - 1, "ACH") and not w.at(i + 2, "I", "E") or w.at(i - 2, "BACHER", "MACHER"):
        return "K", 2
    if i == 0 and w.at(0, "CAESAR"):
        return "S", 2
    if w.at(i, "CHIA"):
        return "K", 2
    if w.at(i, "CH"):
        if i > 0 and w.at(i, "CHAE"):
            return "K", 2
        greek_start = i == 0 and (w.at(1, "HARAC", "HARIS") or w.at(1, "HOR", "HYM", "HIA", "HEM")) and not w.at(0, "CHORE")
        hard = w.germanic or w.at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or w.at(i + 2, "T", "S")
        hard = hard or ((i == 0 or w.at(i - 1, "A", "O", "U", "E")) and (w.at(i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W", " ") or i + 1 == w.last))
        if greek_start or hard:
            return "K", 2
        if i > 0:
            return ("K" if w.at(0, "MC") else "X"), 2
        return "X", 2
    if w.at(i, "CZ") and not w.at(i - 2, "WICZ"):
        return "S", 2
    if w.at(i + 1, "CIA"):
        return "X", 3
    if w.at(i, "CC") and not (i == 1 and w.at(0, "M")):
        if w.at(i + 2, "I", "E", "H") and not w.at(i + 2, "HU"):
            return ("KS" if i == 1 and w.at(0, "A") or w.at(i - 1, "UCCEE", "UCCES") else "X"), 3
        return "K", 2
    if w.at(i, "CK", "CG", "CQ"):
        return "K", 2
    if w.at(i, "CI", "CE", "CY"):
        return "S", 2
    if w.at(i + 1, " C", " Q", " G"):
        return "K", 3
    if w.at(i + 1, "C", "K", "Q") and not w.at(i + 1, "CE", "CI"):
        return "K", 2
    return "K", 1


def _g(w: _Word, i: int) -> tuple[str, int]:
    if w.at(i + 1, "H"):
        if i > 0 and not w.vowel(i - 1):
            return "K", 2
        if i == 0:
            return ("J" if w.at(2, "I") else "K"), 2
        if i > 1 and w.at(i - 2, "B", "H", "D") or i > 2 and w.at(i - 3, "B", "H", "D") or i > 3 and w.at(i - 4, "B", "H"):
            return "", 2
        if i > 2 and w.at(i - 1, "U") and w.at(i - 3, "C", "G", "L", "R", "T"):
            return "F", 2
        return ("K" if not w.at(i - 1, "I") else ""), 2
    if w.at(i + 1, "N"):
        if i == 1 and w.vowel(0) and not w.slavic:
            return "KN", 2
        if not w.at(i + 2, "EY") and not w.at(i + 1, "Y") and not w.slavic:
            return "N", 2
        return "KN", 2
    if w.at(i + 1, "LI") and not w.slavic:
        return "KL", 2
    soft = ("ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")
    if i == 0 and (w.at(1, "Y") or w.at(1, *soft)):
        return "K", 2
    if w.at(i + 1, "ER", "Y") and not w.at(0, "DANGER", "RANGER", "MANGER") and not w.at(i - 1, "E", "I") and not w.at(i - 1, "RGY", "OGY"):
        return "K", 2
    if w.at(i + 1, "E", "I", "Y") or w.at(i - 1, "AGGI", "OGGI"):
        hard = w.germanic or w.at(i + 1, "ET")
        return ("K" if hard else "J"), 2
    return "K", 2 if w.at(i + 1, "G") else 1


def _j(w: _Word, i: int) -> tuple[str, int]:
    step = 2 if w.at(i + 1, "J") else 1
    if w.at(i, "JOSE") or w.at(0, "SAN "):
        return ("H" if i == 0 and (w.at(4, " ") or w.last == 3) or w.at(0, "SAN ") else "J"), step
    if i == 0:
        return "J", step
    if w.vowel(i - 1) and not w.slavic and w.at(i + 1, "A", "O"):
        return "J", step
    if i == w.last:
        return "J", step
    if not w.at(i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not w.at(i - 1, "S", "K", "L"):
        return "J", step
    return "", step


def _s(w: _Word, i: int) -> tuple[str, int]:
    if w.at(i - 1, "ISL", "YSL"):
        return "", 1
    if i == 0 and w.at(0, "SUGAR"):
        return "X", 1
    if w.at(i, "SH"):
        return ("S" if w.at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X"), 2
    if w.at(i, "SIO", "SIA", "SIAN"):
        return ("X" if not w.slavic else "S"), 3
    if i == 0 and w.at(1, "M", "N", "L", "W") or w.at(i + 1, "Z"):
        return "S", 2 if w.at(i + 1, "Z") else 1
    if w.at(i, "SC"):
        if w.at(i + 2, "H"):
            if w.at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                return ("X" if w.at(i + 3, "ER", "EN") else "SK"), 3
            return "X", 3
        return ("S" if w.at(i + 2, "I", "E", "Y") else "SK"), 3
    silent = i == w.last and w.at(i - 2, "AI", "OI")
    return ("" if silent else "S"), 2 if w.at(i + 1, "S", "Z") else 1


def _t(w: _Word, i: int) -> tuple[str, int]:
    if w.at(i, "TION", "TIA", "TCH"):
        return "X", 3
    if w.at(i, "TH", "TTH"):
        return ("T" if w.at(i + 2, "OM", "AM") or w.germanic else "0"), 2
    return "T", 2 if w.at(i + 1, "T", "D") else 1


def _w(w: _Word, i: int) -> tuple[str, int]:
    if w.at(i, "WR"):
        return "R", 2
    if i == 0 and (w.vowel(1) or w.at(0, "WH")):
        return "A", 1
    if i == w.last and w.vowel(i - 1) or w.at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or w.at(0, "SCH"):
        return "", 1
    if w.at(i, "WICZ", "WITZ"):
        return "TS", 4
    return "", 1


def _other(w: _Word, i: int) -> tuple[str, int]:
    c = w.t[i]
    double = 2 if w.at(i + 1, c) else 1
    match c:
        case "B":
            return "P", double
        case "Ç":
            return "S", 1
        case "D":
            if w.at(i, "DG"):
                return ("J", 3) if w.at(i + 2, "I", "E", "Y") else ("TK", 2)
            return "T", 2 if w.at(i, "DT", "DD") else 1
        case "F" | "K" | "N":
            return c, double
        case "Ñ":
            return "N", 1
        case "H":
            return ("H", 2) if (i == 0 or w.vowel(i - 1)) and w.vowel(i + 1) else ("", 1)
        case "L":
            return "L", double
        case "M":
            silent_b = w.at(i - 1, "UMB") and (i + 1 == w.last or w.at(i + 2, "ER"))
            return "M", 2 if silent_b or double == 2 else 1
        case "P":
            if w.at(i + 1, "H"):
                return "F", 2
            return "P", 2 if w.at(i + 1, "P", "B") else 1
        case "Q":
            return "K", double
        case "R":
            french = i == w.last and not w.slavic and w.at(i - 2, "IE") and not w.at(i - 4, "ME", "MA")
            return ("" if french else "R"), double
        case "V":
            return "F", double
        case "X":
            silent = i == w.last and (w.at(i - 3, "IAU", "EAU") or w.at(i - 2, "AU", "OU"))
            return ("" if silent else "KS"), 2 if w.at(i + 1, "C", "X") else 1
        case "Z":
            return ("J", 2) if w.at(i + 1, "H") else ("S", double)
    return "", 1


_RULES = {"C": _c, "G": _g, "J": _j, "S": _s, "T": _t, "W": _w}


@lru_cache(maxsize=200_000)
def metaphone(word: str) -> str:
    """The primary code of one word; empty where nothing in it is sounded."""
    text = unicodedata.normalize("NFC", word).upper()
    plain = "".join(c if c in "ÇÑ" else unicodedata.normalize("NFKD", c)[0] for c in text)
    w = _Word(plain)
    code: list[str] = []
    i = 1 if w.at(0, "GN", "KN", "PN", "WR", "PS") else 0
    if w.at(0, "X"):
        code.append("S")
        i = 1
    while i <= w.last:
        if w.t[i] in VOWELS:
            if i == 0:
                code.append("A")
            i += 1
            continue
        sound, step = _RULES.get(w.t[i], _other)(w, i)
        code.append(sound)
        i += step
    return "".join(code)


def codes(words: set[str]) -> set[str]:
    """The codes of a set of words; words without a sound have none."""
    return {metaphone(w) for w in words} - {""}


def phrase(text: str) -> str:
    """Codes of the text's words, joined by spaces."""
    return " ".join(metaphone(word) for word in text.split())
