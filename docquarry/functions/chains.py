"""Text normalisers as lists of steps: one list gives the Spark column and the SQL twin."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: White space as documents have it, the no-break space and the byte order mark included.
WS = r"\s\x{A0}\x{FEFF}"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The pattern as RE2 reads it: there, (?i) folds all letters."""
    return pattern.replace("(?iu)", "(?i)")


def sql_match(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {quote(re2(pattern))})"


def sql_sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {quote(re2(pattern))}, {quote(re.sub(r'[$]([0-9])', r'\\\1', to))}, 'g')"


def sql_trim(expr: str) -> str:
    return sql_sub(expr, rf"^[{WS}]+|[{WS}]+\z", "")


#: The same characters one by one.
WS_LETTERS = " \t\n\x0b\f\r\xa0\ufeff"


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(WS_LETTERS))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column, letters: str = "") -> Column:
    """Runs of white space, and of these letters of a class, become one space each; a space that
    stands alone is passed over."""
    # what isn't a letter is one test, and most characters are passed over by it
    one = rf"\P{{L}}&&[{letters}{WS}]"
    return F.regexp_replace(text, f"(?: (?=[{one}])|[{one}&&[^ ]])[{one}]*+", " ")


# What lines() does step by step, as its twin has it.
_LINES = [(r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")]


def lines(text: Column) -> Column:
    """Runs of spaces and tabs become one space, and go beside line breaks, of which two at most
    follow each other. One pass: of each run its line breaks, or else one space, are kept."""
    return F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), r"(?=\n| [ \n])(?: *+(\n) *+(?:(\n)[ \n]*+)?|( ) ++)", "$1$2$3")


class Chain:
    """Steps: sub(pattern, to) replaces all matches; swap(a, b) plain strings; fold(a, b)
    letter by letter; spaced(letters of a class) as spaced(); lines as lines(); lower; trim;
    left(n). Null stays null."""

    def __init__(self, *steps: tuple):
        self.steps = steps

    def __call__(self, text: Column) -> Column:
        for name, *args in self.steps:
            if name == "sub":
                text = F.regexp_replace(text, args[0], args[1])
            elif name == "swap":
                text = F.replace(text, F.lit(args[0]), F.lit(args[1]))
            elif name == "fold":
                text = F.translate(text, *args)
            elif name == "spaced":
                text = spaced(text, *args)
            elif name == "lines":
                text = lines(text)
            elif name == "lower":
                text = F.lower(text)
            elif name == "trim":
                text = trim(text)
            elif name == "left":
                text = F.left(text, F.lit(args[0]))
        return text

    def sql(self, expr: str) -> str:
        for name, *args in self.steps:
            if name == "sub":
                expr = sql_sub(expr, *args)
            elif name == "swap":
                expr = f"replace({expr}, {quote(args[0])}, {quote(args[1])})"
            elif name == "fold":
                expr = f"translate({expr}, {quote(args[0])}, {quote(args[1])})"
            elif name == "spaced":
                expr = sql_sub(sql_sub(expr, f"[{args[0]}]", " ") if args else expr, rf"[{WS}]+", " ")
            elif name == "lines":
                for pattern, to in _LINES:
                    expr = sql_sub(expr, pattern, to)
            elif name == "lower":
                expr = f"lower({expr})"
            elif name == "trim":
                expr = sql_trim(expr)
            elif name == "left":
                expr = f"left({expr}, {args[0]})"
        return expr

    def __add__(self, other: Chain) -> Chain:
        return Chain(*self.steps, *other.steps)
