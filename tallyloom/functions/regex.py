"""User patterns in RE2 syntax, for Spark's Java regular expressions, and the literals that a match must hold."""

from __future__ import annotations

import re
from re import _constants as _op
from re import _parser

#: RE2's bracket class names and their Java counterparts (ASCII).
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"0-9", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\t-\r\x20", "upper": r"\p{Upper}", "word": r"0-9A-Za-z_", "xdigit": r"\p{XDigit}",
}
WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
NO_WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"


class PatternError(ValueError):
    """The pattern is not RE2's."""


def _escape(p: str, i: int, inside: bool) -> tuple[str, int]:
    if i + 1 >= len(p):
        raise PatternError("trailing backslash")
    c = p[i + 1]
    if c == "s":
        return (r"\t\n\f\r\x20" if inside else r"[\t\n\f\r\x20]"), i + 2
    if c == "S" and not inside:
        return r"[^\t\n\f\r\x20]", i + 2
    if c == "v":
        return r"\x0B", i + 2
    if c == "b" and not inside:
        return WORD_EDGE, i + 2
    if c == "B" and not inside:
        return NO_WORD_EDGE, i + 2
    if c == "Q":
        end = p.find(r"\E", i + 2)
        end = len(p) if end < 0 else end
        return "".join(re.escape(x) for x in p[i + 2 : end]), min(len(p), end + 2)
    if c in "pP":
        if p[i + 2 : i + 3] != "{":
            return p[i : i + 3], i + 3
        end = p.index("}", i)
        name = p[i + 3 : end]
        negate = name.startswith("^")
        name = name.lstrip("^")
        sign = "P" if (c == "P") != negate else "p"
        return (rf"\{sign}{{{name}}}" if len(name) <= 2 else rf"\{sign}{{Is{name}}}"), end + 1
    if c.isdigit() and c != "0":
        raise PatternError("RE2 has no back-references")
    if c in "ZGKRXHhNkCc":
        raise PatternError(f"RE2 has no \\{c}")
    return p[i : i + 2], i + 2


def _bracket(p: str, i: int) -> tuple[str, int]:
    out, i = ["["], i + 1
    if p[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while True:
        if i >= len(p):
            raise PatternError("missing ]")
        c = p[i]
        if c == "]" and not first:
            return "".join(out) + "]", i + 1
        first = False
        if c == "[" and p[i + 1 : i + 2] == ":":
            end = p.find(":]", i)
            name = p[i + 2 : end]
            negate = name.startswith("^")
            if end < 0 or name.lstrip("^") not in POSIX:
                raise PatternError("unknown bracket class")
            body = POSIX[name.lstrip("^")]
            out.append(f"[^{body}]" if negate else body)
            i = end + 2
        elif c == "\\":
            piece, i = _escape(p, i, True)
            out.append(piece)
        else:
            out.append("\\" + c if c in "[]&" else c)
            i += 1


def to_java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """The pattern as Java reads it: lines end at \\n only; `multiline` lets . match a line feed too."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            piece, i = _escape(pattern, i, False)
        elif c == "[":
            piece, i = _bracket(pattern, i)
        elif pattern.startswith("(?", i):
            m = re.match(r"\(\?P?<([A-Za-z_]\w*)>|\(\?([imsU]*(?:-[imsU]+)?)([:)])", pattern[i:])
            if not m:
                raise PatternError("RE2 has no look-around")
            if "U" in (m[2] or ""):
                raise PatternError("the flag U is not supported")
            piece = f"(?<{m[1].replace('_', 'U')}>" if m[1] else m[0]
            i += m.end()
        elif c in "*+?" and out and i and pattern[i - 1] in "*+?}" and not (c == "?" and (i < 2 or pattern[i - 2] not in "*+?}")):
            raise PatternError("RE2 has no possessive or double repetition")
        else:
            piece, i = c, i + 1
        out.append(piece)
    return f"(?md{'iu' if ignore_case else ''}{'s' if multiline else ''})" + "".join(out)


def _must(nodes) -> list[str] | None:
    """Literals of which any match holds at least one; None: unknown."""
    best: list[str] | None = None
    run = ""

    def offer(options: list[str] | None):
        nonlocal best
        if options and all(len(o) >= 3 for o in options) and (best is None or min(map(len, options)) > min(map(len, best))):
            best = options

    for op, value in nodes:
        if op is _op.LITERAL:
            run += chr(value)
            continue
        offer([run] if run else None)
        run = ""
        if op is _op.SUBPATTERN and not value[1] and not value[2]:
            offer(_must(value[3]))
        elif op is _op.BRANCH:
            parts = [_must(b) for b in value[1]]
            offer([x for p in parts for x in p] if all(parts) else None)
        elif op in (_op.MAX_REPEAT, _op.MIN_REPEAT) and value[0] >= 1:
            offer(_must(value[2]))
    offer([run] if run else None)
    return best


def required_literals(pattern: str, ignore_case: bool = False) -> list[str] | None:
    """Literals, at least one of which every match holds (in lower case if case is ignored); None if none are known.

    Case-insensitive literals with s, k or other than ASCII are not used: RE2 folds two more characters to s and k.
    """
    try:
        found = _must(_parser.parse(re.sub(r"\\z", r"\\Z", pattern)))
    except (re.error, OverflowError, RecursionError, IndexError):
        return None
    if found and ignore_case:
        found = [x.lower() for x in found]
        if any(not x.isascii() or "s" in x or "k" in x for x in found):
            return None
    return found or None


def smart_case(patterns: list[str]) -> bool:
    """Whether to ignore case: no pattern has an upper-case letter outside an escape."""
    return not any(c.isupper() for p in patterns for c in re.sub(r"\\.", "", p))
