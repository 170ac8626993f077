"""Patterns written for PCRE, made to mean the same in Java's regular expressions."""

from __future__ import annotations

import re

#: Fixed value: the byte-level splitter's pattern.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPECIAL = r"\.+*?()|[]{}^$"


def escape(literal: str) -> str:
    """A pattern that matches the literal."""
    return "".join("\\" + c if c in _SPECIAL else c for c in literal)


def translate(pattern: str) -> str:
    """Unicode classes on; braces that quantify nothing, "[" and "&&" inside a class escaped."""
    out, i, in_class, at_start = [], 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            braces = re.match(r"\\[pPxuN]\{[^}]*\}", pattern[i:])
            n = len(braces[0]) if braces else 2
            out.append(pattern[i : i + n])
            i, at_start = i + n, False
            continue
        if in_class:
            if c == "]" and not at_start:
                in_class = False
            elif c == "[":
                named = re.match(r"\[:\^?\w+:\]", pattern[i:])
                if named:
                    name = named[0].strip("[]:")
                    out.append(("\\P{" if name.startswith("^") else "\\p{") + "Is" + {"alpha": "Alphabetic", "digit": "Digit", "space": "White_Space", "upper": "Uppercase", "lower": "Lowercase", "punct": "Punctuation"}.get(name.lstrip("^"), name.lstrip("^").title()) + "}")
                    i, at_start = i + len(named[0]), False
                    continue
                c = "\\["
            elif pattern[i : i + 2] == "&&":
                out.append("&\\&")
                i, at_start = i + 2, False
                continue
            elif c == "]" and at_start:
                c = "\\]"
            at_start = c == "^" and at_start
        elif c == "[":
            in_class = at_start = True
        elif c == "{" and not re.match(r"\{\d+(,\d*)?\}", pattern[i:]):
            c = "\\{"
        elif c == "}" and not re.search(r"(?<!\\)\{\d+(,\d*)?$", pattern[:i]):
            c = "\\}"
        out.append(c)
        i += 1
    return "(?U)" + "".join(out)


def usable(pattern: str) -> bool:
    """Whether the JVM compiles the (translated) pattern; callers treat others as matching nothing."""
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:  # what PatternSyntaxException is
        return False
    return True


def matches_empty(pattern: str) -> bool:
    from pyspark import SparkContext

    return SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").find()
