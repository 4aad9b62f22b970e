"""Trimming extracted names: ordered cuts that keep the place of what is left.

Every step looks at the text that is left and tells which slice of it stays, so
that after each step ``original[start:stop]`` is what is left: nothing is ever
rewritten.  A step that does not apply keeps everything.  Titles in the middle
of a name make it an exception, which stays whole for the time being.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from . import court_words as W

Slice = tuple[int, int]
Rule = Callable[[str], Slice | None]

_I = re.IGNORECASE


def _behind(pattern: str, flags=_I, when=None) -> Rule:
    """What follows the first match."""
    p = re.compile(pattern, flags)
    return lambda t: (m.end(), len(t)) if (m := p.search(t)) and (when is None or when(t, m)) else None


def _before(pattern: str, flags=_I, when=None) -> Rule:
    """What stands before the first match."""
    p = re.compile(pattern, flags)
    return lambda t: (0, m.start()) if (m := p.search(t)) and (when is None or when(t, m)) else None


def _through(pattern: str, flags=_I, when=None) -> Rule:
    """Everything up to the first match's end."""
    p = re.compile(pattern, flags)
    return lambda t: (0, m.end()) if (m := p.search(t)) and (when is None or when(t, m)) else None


def _any(words: list[str]) -> str:
    return "|".join(words)


def _by_length(words: list[str]) -> list[str]:
    return sorted(words, key=lambda w: (len(w.split()), len(w)), reverse=True)


def _mark(text: str) -> Slice | None:
    """Up to the earliest of the docket's marks."""
    low = text.lower()
    at = [i for mark in W.PUNCTUATION if (i := low.find(mark)) >= 0]
    return (0, min(at)) if at else None


_POSSESSIVE = re.compile(r"('s|s')\s+(?!(jr|sr)\.*)", _I)
_LAST = re.compile("(court|time|rule|note|oral|pris)$", _I)
_AFFIXED = re.compile(r"(\s|\b|^)(Sr\.* |s\.*)?(U\.*S\.*(D|M)\.*J\.*|(M|D)\.*J\.*D\.*C\.*)\s*|^vj\-", _I)
_COMMA = re.compile(rf"(?<!(\b)[a-zA-Z])\.*,(?!\s*({_any([*W.SUFFIXES, 'j r'])})(\.|\b|\s))", _I)
_CHAMBERS = re.compile("(in |to )?chambers", _I)


def _possessive(text: str) -> Slice | None:
    return (0, m.end(1)) if (m := _POSSESSIVE.search(text)) else None


def _last_word(text: str) -> Slice | None:
    """The place counts from the first character that is not a space."""
    return (0, m.start()) if (m := _LAST.search(text.strip())) else None


def _short_title(text: str) -> Slice | None:
    """A short title goes with the nearer end."""
    if not (m := _AFFIXED.search(text)):
        return None
    return (m.end(), len(text)) if m.start() < len(text) // 2 else (0, m.start())


def _long_tail(text: str) -> Slice | None:
    """Words behind a late comma.  Its place counts from the twenty-first character on."""
    m = _COMMA.search(text[21:])
    return (0, m.start()) if m and len(text[m.start() :].split()) > 3 else None


def _chambers(text: str) -> Slice | None:
    """Whose chambers they are goes; the judge of that name stays."""
    m = _CHAMBERS.search(text)
    if not m:
        return None
    words = text[: m.start()].lower().split()
    return None if words and words[-1] in ("robert", "c", "c.") else (0, m.start())


def _sentence(text: str, m: re.Match) -> bool:
    words = text.split()
    return len(words) > 3 and words[-1] not in W.SUFFIXES and "lee" not in text.lower()


def _no_suffix(text: str, m: re.Match) -> bool:
    """A full stop that belongs to a suffix stays."""
    words = text.split()
    return bool(words) and not any(s in words[-1].lower() for s in W.SUFFIXES if s not in ("i", "v"))


_EDGES = rf"({W.EDGE_MARKS}|\s)+"
_ODD = _any([r"\.?".join(s) + r"\.?" for s in W.ODD_SUFFIXES])

#: Steps before the titles, the titles, and the steps behind them.
FIRST: dict[str, Rule] = {
    "by judge": _behind(r"(by|to)(\b|\s)(\w+\s)*(judge)(\s|\b)(?=(\w+\s)+)"),
    "leading stops": _behind(r"^\.+"),
    "words after names": _before(rf"(\b|\s)({_any(_by_length(W.AFTER_NAMES))})(\b|\s)", when=lambda t, m: m.start() > 4),
    "leading marks": _behind(f"^{_EDGES}"),
    "leading stop or bracket": _behind(r"^(\.|\[)"),
    "docket marks": _mark,
    "leading judge": _behind(r"^judge(s?\b|)\s*|^'ble justice"),
    "leading by": _behind(r"^(by|to)(?=[A-Z]|\s+)", 0),
    "final re": _before(" re$"),
    "dates": _before(r"\s*(o\.* n|oon|on|by|for|entered:|scheduled|dated|:|--)*\s*[\d]+[-/\.][\d]+[-/\.][\d]+"),
    "merged The": _before("(?<=[a-z])The", 0),
    "possessive": _possessive,
    "case numbers": _before(r"(\b|\s)[a-zA-Z]{1,2}(\b|\s)[a-zA-Z]{1,2}-[\d]{1,2}|(\b|\s)[a-zA-Z]{1,2}-[\d]{1,2}"),
    "calendar": _before(rf"((\b|\s)|dated\s|(\b|\s)on\s|(\b|\s)o n\s)({_any(W.MONTHS_AND_DAYS)})(\b|\s|$)"),
    "capitals": _through(r"[A-Z]+ [A-Z]\.? [A-Z]+\.", 0),
    "reports": _before(r"\s*(per r&r|r&r|[rf] & r|[mf]&r|r and r|recommend)"),
    "words around names": _before(f"({_any(_by_length(W.AROUND_NAMES))})"),
    "last word": _last_word,
    "trailing words": _before(r"(?<=[A-Z]{2})(in|as|re|[jJ]ury)", 0),
    "short titles": _short_title,
}
TITLES = [re.compile(rf"(\b|^|[\s\.,;:\(\)])({_any(t)})(\b|^|[\s\.,;:\(\)])", _I) for t in (W.MAGISTRATE_TITLES, W.DISTRICT_TITLES, W.APPELLATE_TITLES, W.BANKRUPTCY_TITLES, W.PLAIN_TITLES)]
LAST: dict[str, Rule] = {
    "long tail": _long_tail,
    "misspelt judge": _behind(r"(j udge|ju dge|jud ge|judg e)\s"),
    "merged Scott": _through("Scott(?=[A-Z])|SCOTT(?=[A-Za-z][a-z])", 0),
    "chambers": _chambers,
    "behind a suffix": _through(rf"(\s|\b)({_any([s for s in W.SUFFIXES if len(s) > 1 and s != 'sr'])})\.* (?=\w+)"),
    "leading rank": _behind(r"^(sr|ch(ief)?|mr)\.*(\s|$)"),
    "sentence": _through(r"(?<!^)[a-zA-Z]{3,}\.(?!=[a-zA-Z]\.*\s|\w\.)", when=_sentence),
    "odd suffixes": _before(rf",?(\s|\b)({_ODD})$"),
    "leading marks again": _behind(f"^{_EDGES}"),
    "trailing marks": _before(rf"(\s|{W.EDGE_MARKS})+$", when=_no_suffix),
    "trailing space": _before(r"\s+$", 0),
}
#: What is left is no name if one of these is found in it.
NO_NAME = [
    re.compile(p, f)
    for p, f in (
        (r"^[\d]+$|^([\d]*[\.,:;\-=/]*)*$", _I), (r"(\b|\s)([do][/\.]*b[/\.]*[ao][/\.]*|o/b/?)(\b|\s)", _I), (r"#\s*[\d]+", 0),
        (r"c\.f\.|p\.\s*\d+|\d+\s*\w+\s*(st|str|street)|\d+ [nesw]\.? [a-z]+(-\d+)?", _I), (r"^[a-zA-Z]\s[a-zA-Z]$", _I), (r"^re [A-Z]|^[rR]e$|^ge [A-Z]|^Mr\.*\s+", 0), (r"sacr[\d]+-[\d]+", _I),
    )
]


def _titles(text: str) -> Slice | None | bool:
    """A title at one end goes; True for one in the middle."""
    for pattern in TITLES:
        if m := pattern.search(text):
            return (m.end(), len(text)) if m.start() == 0 else (0, m.start()) if m.end() == len(text) else True
    return None


def trim(original: str, met: list[str] | None = None) -> tuple[int | None, int | None, bool]:
    """``start, stop, is_exception`` of the name in an extracted text, without a place where no name is left.
    ``met`` collects the names of the steps that cut."""
    start, stop, exception = 0, len(original), False

    def keep(name: str, part: Slice | None) -> None:
        nonlocal start, stop
        if part is not None:
            if met is not None and part != (0, stop - start):
                met.append(name)
            start, stop = start + part[0], start + part[1]

    for name, rule in FIRST.items():
        keep(name, rule(original[start:stop]))
    part = _titles(original[start:stop])
    if part is True:
        exception = True
        if met is not None:
            met.append("title inside")
    else:
        keep("title", part)
    for name, rule in LAST.items():
        keep(name, rule(original[start:stop]))
    if start == stop or any(p.search(original[start:stop]) for p in NO_NAME):
        return None, None, exception
    return start, stop, exception
