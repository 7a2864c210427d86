"""The one place that knows regular expression dialects.

Patterns are written once, in the ECMAScript dialect, and translated for Java (Spark) and, where they hold no
look-around, for RE2 (DuckDB): word boundaries are ASCII, white space includes no-break spaces and U+FEFF, `$` is the
very end unless lines are asked for, and letters fold their case beyond ASCII.
"""

from __future__ import annotations

#: White space of the dialect, as the body of a class; \\x{..} works in both engines.
WS = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD_CHAR = "0-9A-Za-z_"
BOUNDARY = f"(?:(?<=[{WORD_CHAR}])(?![{WORD_CHAR}])|(?<![{WORD_CHAR}])(?=[{WORD_CHAR}]))"
SCRIPTS = ("Latin", "Cyrillic", "Greek")


def _translate(pattern: str, java: bool, lines: bool) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            i += 2
            if e == "s":
                out.append(WS if inside else f"[{WS}]")
            elif e == "S":
                out.append(f"[^{WS}]")
            elif e == "w":
                out.append(WORD_CHAR if inside else f"[{WORD_CHAR}]")
            elif e == "d":
                out.append("0-9" if inside else "[0-9]")
            elif e == "b" and not inside:
                out.append(BOUNDARY if java else r"\b")
            elif e == "u" and pattern[i] == "{":
                end = pattern.index("}", i)
                out.append(f"\\x{{{pattern[i + 1 : end]}}}")
                i = end + 1
            elif e == "u":
                out.append(f"\\x{{{pattern[i : i + 4]}}}")
                i += 4
            else:
                out.append("\\" + e)
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[" or c == "&" and java:
                c = "\\" + c
        elif c == "[":
            inside = True
            if pattern[i + 1] == "^":
                out.append("[^")
                i += 2
                continue
        elif c == "$" and not lines:
            c = r"\z"
        out.append(c)
        i += 1
    s = "".join(out)
    for name in SCRIPTS:
        s = s.replace(f"\\p{{Script={name}}}", f"\\p{{Is{name}}}" if java else f"\\p{{{name}}}")
    return s


def java(pattern: str, flags: str = "") -> str:
    """The pattern for Spark. flags: i and m as in the dialect."""
    return ("(?iu)" if "i" in flags else "") + ("(?dm)" if "m" in flags else "") + _translate(pattern, True, "m" in flags)


def re2(pattern: str, flags: str = "") -> str:
    """The pattern for DuckDB; it must not hold look-around."""
    return ("(?i)" if "i" in flags else "") + ("(?m)" if "m" in flags else "") + _translate(pattern, False, "m" in flags)
