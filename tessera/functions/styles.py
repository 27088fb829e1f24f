"""Case styles for column and key names, and date patterns."""

from __future__ import annotations

import re

_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")


def words(name: str) -> list[str]:
    return _WORD.findall(name)


def _lower(s: str) -> str:
    return s.lower()


STYLES = {
    "ada": lambda w: "_".join(x.capitalize() for x in w),
    "camel": lambda w: "".join(x.capitalize() if i else x.lower() for i, x in enumerate(w)),
    "cobol": lambda w: "-".join(x.upper() for x in w),
    "dot": lambda w: ".".join(map(_lower, w)),
    "kebab": lambda w: "-".join(map(_lower, w)),
    "lower": lambda w: " ".join(map(_lower, w)),
    "macro": lambda w: "_".join(x.upper() for x in w),
    "pascal": lambda w: "".join(x.capitalize() for x in w),
    "sentence": lambda w: " ".join(x.lower() if i else x.capitalize() for i, x in enumerate(w)),
    "snake": lambda w: "_".join(map(_lower, w)),
    "title": lambda w: " ".join(x.capitalize() for x in w),
    "train": lambda w: "-".join(x.capitalize() for x in w),
    "upper": lambda w: " ".join(x.upper() for x in w),
}


def restyle(name: str, style: str) -> str:
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}; one of {', '.join(STYLES)}")
    return STYLES[style](words(name))


#: Date letters and their Java patterns (fixed values).
DATE_LETTERS = {
    "d": "dd", "j": "d", "D": "EEE", "l": "EEEE", "z": "D", "m": "MM", "n": "M", "M": "MMM", "F": "MMMM",
    "Y": "yyyy", "y": "yy", "H": "HH", "G": "H", "h": "hh", "g": "h", "i": "mm", "s": "ss", "v": "SSS", "u": "SSSSSS",
    "A": "a", "a": "a", "P": "xxx", "O": "xx", "p": "XXX", "T": "zzz", "e": "VV",
}
#: Named formats.
ATOM = "Y-m-d\\TH:i:sP"


def java_pattern(pattern: str) -> str:
    """A Java date pattern for a pattern of single letters; a backslash makes the next character literal."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(f"'{pattern[i]}'" if pattern[i] != "'" else "''")
        elif c in DATE_LETTERS:
            out.append(DATE_LETTERS[c])
        elif c.isalpha():
            raise ValueError(f"date letter {c!r} has no counterpart")
        else:
            out.append("''" if c == "'" else c)
        i += 1
    return "".join(out)
