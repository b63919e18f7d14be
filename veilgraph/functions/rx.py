"""One regular-expression dialect for rule tables, for Java (Spark) and RE2 (the SQL of the tests).

Rules are written for a dialect with ASCII word boundaries and Unicode white space. Java's word boundary
follows Unicode and its white space doesn't, so patterns are translated, never passed through.
"""

from __future__ import annotations

import re

_WORD = "[A-Za-z0-9_]"
_JAVA_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_JAVA_SPACE = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_RE2_SPACE = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


#: What surely begins, or ends, with a word character: there half of the edge is enough, and much faster.
_BEGINS = re.compile(r"(?:[A-Za-z0-9_]|\\[dw]|\[(?:[A-Za-z0-9_]|\\[dw])(?:[A-Za-z0-9_]|\\[dw]|-(?=[A-Za-z0-9]))*\])(?![?*]|\{0)")
_ENDS = re.compile(r"(?:[A-Za-z0-9_]|\\[dw]|\[(?:[A-Za-z0-9_]|\\[dw])(?:[A-Za-z0-9_]|\\[dw]|-(?=[A-Za-z0-9]))*\])(?:\+|\{[1-9][0-9,]*\})?$")


def _edge(before: str, after: str, whole: str) -> str:
    """The boundary between two parts of a pattern, in its cheapest true form."""
    group = re.match(r"\(\?:([^()|]*)\)(?![?*]|\{0)", after)
    if _BEGINS.match(group[1] if group else after):
        return f"(?<!{_WORD})"
    if not before.endswith("\\") and _ENDS.search(before) and not re.search(r"\\[A-Zac-vx-z0-9_]$", before):
        return f"(?!{_WORD})"
    return whole


def _translate(pattern: str, edge: str, space: str) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\" and len(two) == 2:
            i += 2
            if two == r"\b" and not inside:
                out.append(_edge(pattern[: i - 2], pattern[i:], edge) if edge == _JAVA_EDGE else edge)
            elif two == r"\s":
                out.append(space if inside else f"[{space}]")
            elif two == r"\S" and not inside:
                out.append(f"[^{space}]")
            else:
                out.append(two)
            continue
        if two[0] == "[" and inside:
            out.append(r"\[")  # a plain bracket inside a class, which Java would nest
        elif two[0] == "$" and not inside:
            out.append(r"\z")
        else:
            out.append(two[0])
        inside = two[0] == "[" or (inside and two[0] != "]")
        i += 1
    return "".join(out)


def java(pattern: str, flags: str = "") -> str:
    return (f"(?{flags})" if flags else "") + _translate(pattern, _JAVA_EDGE, _JAVA_SPACE)


def re2(pattern: str, flags: str = "") -> str:
    return (f"(?{flags})" if flags else "") + _translate(pattern, r"\b", _RE2_SPACE)


def sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
