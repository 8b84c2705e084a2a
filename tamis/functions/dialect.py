"""Regular expressions of the linear-time dialect on Spark's engine.

In the linear-time dialect boundaries, digits and white space are ASCII. Spark's
engine has Unicode boundaries and counts the vertical tab as white space, so
``\\b``, ``\\B``, ``\\s`` and ``\\S`` are rewritten.
"""

from __future__ import annotations

WORD = "0-9A-Za-z_"
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
INSIDE = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
SPACE = r"\t\n\f\r "
#: Patterns are run by a backtracking engine, so very long ones are refused.
LONGEST = 2000


def plain_dialect(pattern: str, engine: str = "re2j") -> str:
    """The same for texts of ASCII only, where boundaries need no rewriting."""
    return ascii_dialect(pattern, engine, boundaries=False)


def ascii_dialect(pattern: str, engine: str = "re2j", *, boundaries: bool = True) -> str:
    """``pattern`` as Spark must see it to match like the chosen engine."""
    if len(pattern) > LONGEST:
        raise ValueError(f"pattern longer than {LONGEST} characters")
    if engine == "jdk":
        return pattern
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            i += 2
            if e == "s":
                out.append(SPACE if inside else f"[{SPACE}]")
            elif e == "S":
                out.append(f"[^{SPACE}]")  # inside a class: a nested one, which the engine joins
            elif e == "b" and not inside and boundaries:
                out.append(BOUNDARY)
            elif e == "B" and not inside and boundaries:
                out.append(INSIDE)
            else:
                out.append("\\" + e)
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "[" and inside:
            c = "\\["
        out.append(c)
        i += 1
    return "".join(out)
