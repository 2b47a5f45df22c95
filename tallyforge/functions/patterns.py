"""Patterns of category rules as the patterns of the engine that runs them.

Rules are written in a dialect without look-around and references to groups, in which classes know all of Unicode, `.`
leaves out the line feed only, `$` is the end of the text, named groups are `(?P<name>...)` and a quantifier may follow a
quantifier. Java reads each of these another way. A rule asks only whether a text matches, so greed and groups don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Names of classes of characters in brackets, and what they stand for.
POSIX = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
# Long names of general categories.
CATEGORIES = {
    "letter": "L",
    "cased_letter": "LC",
    "uppercase_letter": "Lu",
    "lowercase_letter": "Ll",
    "titlecase_letter": "Lt",
    "modifier_letter": "Lm",
    "other_letter": "Lo",
    "mark": "M",
    "number": "N",
    "decimal_number": "Nd",
    "letter_number": "Nl",
    "other_number": "No",
    "punctuation": "P",
    "symbol": "S",
    "currency_symbol": "Sc",
    "math_symbol": "Sm",
    "separator": "Z",
    "space_separator": "Zs",
    "other": "C",
}

_GROUP = re.compile(r"\(\?P?<[A-Za-z_][\w.\[\]]*>")
_FLAGS = re.compile(r"\(\?([imsUuxR]*)(?:-([imsUuxR]+))?([:)])")
_CODE = re.compile(r"(?:x|u|U)\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})")
_PROPERTY = re.compile(r"[pP](?:\{(\^?)(?:(?:gc|general_category|sc|script|scx)\s*[=:]\s*)?([^}=:]+)\}|([A-Za-z]))")
_QUANTIFIER = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")
_PLAIN = {"a": r"\x07", "f": r"\f", "t": r"\t", "n": r"\n", "r": r"\r", "v": r"\x0B"}
_SETS = frozenset("dDwWsS")


class NoPattern(ValueError):
    """What isn't a pattern of the dialect."""


def _property(found: re.Match, negated: bool, compiles: Callable[[str], bool]) -> str:
    name = (found[2] or found[3]).strip()
    mark = "P" if negated != bool(found[1]) else "p"
    key = re.sub(r"[\s-]+", "_", name).lower()
    if key in ("any", "ascii"):
        inside = r"\s\S" if key == "any" else r"\x00-\x7F"
        return f"[^{inside}]" if mark == "P" else f"[{inside}]"
    for form in (CATEGORIES.get(key, name), f"Is{name}", f"Is{name.replace(' ', '_')}"):
        if compiles(rf"\p{{{form}}}"):
            return rf"\{mark}{{{form}}}"
    raise NoPattern(name)


def _escape(text: str, at: int, inside: bool, compiles: Callable[[str], bool]) -> tuple[str, int]:
    """What stands for the escape at the backslash, and where it ends."""
    c = text[at + 1 : at + 2]
    if not c:
        raise NoPattern("it ends in a backslash")
    found = _PROPERTY.match(text, at + 1)
    if found:
        return _property(found, c == "P", compiles), found.end()
    found = _CODE.match(text, at + 1)
    if found:
        code = int(next(g for g in found.groups() if g), 16)
        return rf"\x{{{code:X}}}", found.end()
    if c in _PLAIN:
        return _PLAIN[c], at + 2
    if c in _SETS or (not inside and c in "bBAz"):
        if c in "bB" and text[at + 2 : at + 3] == "{":
            raise NoPattern("word boundaries of other kinds")
        return "\\" + c, at + 2
    if c.isalnum() or c in "<>":
        raise NoPattern("\\" + c)
    return "\\" + c, at + 2


def _brackets(text: str, at: int, compiles: Callable[[str], bool]) -> tuple[str, int]:
    """What stands for the class in brackets, and where it ends."""
    out, k = "[", at + 1
    if text[k : k + 1] == "^":
        out, k = out + "^", k + 1
    first = True
    while True:
        c = text[k : k + 1]
        if not c:
            raise NoPattern("a bracket isn't closed")
        if c == "]" and not first:
            return out + "]", k + 1
        posix = re.compile(r"\[:(\^?)(\w+):\]").match(text, k)
        if posix:
            if posix[2] not in POSIX:
                raise NoPattern(posix[0])
            out, k = out + f"[{posix[1]}{POSIX[posix[2]]}]", posix.end()
        elif c == "[":
            inner, k = _brackets(text, k, compiles)
            out += inner
        elif c == "\\":
            one, k = _escape(text, k, True, compiles)
            out += one
        elif text.startswith(("--", "~~"), k) and not first:
            raise NoPattern("differences of classes")
        elif text.startswith("&&", k):
            out, k = out + "&&", k + 2
        else:
            out, k = out + ("\\" + c if c in "]&" else c), k + 1
        first = False


def java_pattern(text: str, compiles: Callable[[str], bool]) -> str | None:
    """The pattern for Java, or null if text isn't one. compiles: whether Java takes a pattern."""
    try:
        out = "(?dU)" + _translated(text, compiles)
    except NoPattern:
        return None
    return out if compiles(out) else None


def _translated(text: str, compiles: Callable[[str], bool]) -> str:
    out: list[str] = []  # the parts so far; a quantifier belongs to the last one
    opened: list[tuple[int, bool]] = []  # where open groups begin, and whether ^ and $ are of lines outside them
    lines = quantified = False
    k = 0
    while k < len(text):
        c = text[k]
        found = _QUANTIFIER.match(text, k)
        if found:
            if not out:
                raise NoPattern("nothing to repeat")
            if quantified and found[0] != "?":
                out[-1] = f"(?:{out[-1]})"
            out[-1] += found[0]
            k = found.end()
            quantified = not (quantified and found[0] == "?")
            continue
        quantified = False
        if c == "\\":
            one, k = _escape(text, k, False, compiles)
            out.append(one)
        elif c == "[":
            one, k = _brackets(text, k, compiles)
            out.append(one)
        elif c == "(":
            flags, name = _FLAGS.match(text, k), _GROUP.match(text, k)
            if flags:
                on, off = flags[1], flags[2] or ""
                was = lines
                lines = "m" in on or (lines and "m" not in off)
                on, off = ("".join(f for f in x if f in "isx") for x in (on, off))
                if flags[3] == ")":
                    out.append(f"(?{on}{'-' + off if off else ''})" if on or off else "")
                else:
                    opened.append((len(out), was))
                    out.append(f"(?{on}{'-' + off if off else ''}:")
                k = flags.end()
            elif name or text[k + 1 : k + 2] != "?":
                opened.append((len(out), lines))
                out.append("(")
                k = name.end() if name else k + 1
            else:
                raise NoPattern("look-around")
        elif c == ")":
            if not opened:
                raise NoPattern("a group isn't opened")
            at, lines = opened.pop()
            out[at:] = ["".join(out[at:]) + ")"]
            k += 1
        else:
            out.append({"^": r"(?:\A|(?<=\n))", "$": r"(?=\n|\z)"}.get(c, c) if lines else {"$": r"\z"}.get(c, c))
            k += 1
    if opened:
        raise NoPattern("a group isn't closed")
    return "".join(out)
