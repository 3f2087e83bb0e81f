"""Predicates over lines and documents. A null line gives a null."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .chains import WS, let, spaced, sql_match, sql_sub, sql_trim, trim

_EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
# Fixed values. The class of "rules only" holds the range from \ to the long dash, and so all
# letters: lines of letters and spaces are garbage by this rule, which is kept as it is.
RULES_ONLY, RULES_STRICT = rf"(?iu)^[{WS}|=\\-—><~#]*\z", rf"^[{WS}|=\\\-—–><~#]*\z"
_ALNUM = r"[^A-Za-zА-Яа-яЁё0-9]"
_UNIT = r"(м[23²³]?|бр\.?|тон|кг|л\.?\s*м|км)"
TABLE_LINE = [
    r"(?iu)^КОЛИЧЕСТВЕНА\s+СМЕТКА", r"(?iu)^Сметка\s+\d+", r"(?iu)^Всичко:\s*[\d,.]+\s*(м[23²³]?|бр\.?|тон|кг)", r"(?iu)^-\s*съгласно\s+(Ведомост|Чертеж)",
    r"(?iu)^\d{3,4}[,.]?\d?\s+\w+.*\d+\s*(м[23²³]?|бр\.?|тон|кг)", r"(?iu)^\[\s*U\d+\s*\]", r"(?iu)^Позиция\s+No\s", r"(?iu)^Наименование\s+на\s+видовете\s+работи",
]
TABLE_ROW = (r"^\d{3,4}\s+", rf"(?iu)\d+\s*{_UNIT}\s*\z")
HEADING_LINE = [r"^\d+\.\s+[А-ЯA-Z]", r"^(I{1,3}V?|V?I{0,3})\.\s+[А-ЯA-Z]", r"(?iu)^ЧАСТ\s+", r"^---"]
OUTPUT_DROPPED = [_EMAIL, r"(?i)@|e-?mail\s*:?", r"(?iu)^Всичко:", r"(?iu)^\[\s*U\d+\s*\]", r"(?iu)^Сметка\s+\d+", r"(?iu)^-\s*съгласно\s+(Ведомост|Чертеж)"]
ROLE_WORDS = [
    r"(?iu)ръководител", r"(?iu)специалист", r"(?iu)експерт", r"(?iu)длъжностно\s+лице", r"(?iu)координатор", r"(?iu)инженер", r"(?iu)геодез", r"(?iu)отговорник", r"ЗБУТ",
    r"(?iu)контрол\s+на\s+качеството",
]
BULLET = r"^(?:\d+[.)]\s*|-\s*|•\s*|–\s*)"


def any_of(line: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns is found: those for a line's beginning are tried together
    there, the others together at each place."""
    anchored, free = [], []
    for p in patterns:
        flags, body = re.fullmatch(r"(?:\(\?([a-z]+)\))?(.*)", p, re.S).groups()
        first = body.startswith("^") and "m" not in (flags or "") and "|" not in re.sub(r"\([^()]*\)", "", body)
        (anchored if first else free).append(f"(?{flags or ''}:{body[first:]})")
    tests = [line.rlike(p) for p in (f"^(?:{'|'.join(anchored)})", "|".join(free)) if p not in ("^(?:)", "")]
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def sql_any(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(sql_match(expr, p) for p in patterns) + ")"


def _share(line: Column) -> Column:
    """Letters and digits as a share of what isn't white space; null if all is."""
    return F.try_divide(F.length(F.regexp_replace(line, rf"{_ALNUM}++", "")), F.length(F.regexp_replace(line, rf"[{WS}]++", "")))


def _thin(line: Column, below: Column | float) -> Column:
    """Whether that share is below a number. Of ASCII letters and digits alone all characters
    have no larger share, and most lines are told by these."""
    some = F.try_divide(F.length(F.regexp_replace(line, r"\P{Alnum}++", "")), F.length(line))
    return (some < below) & (_share(line) < below)


def _solid(line: Column, least: int) -> Column:
    """Whether so many characters aren't white space; no more of the line is looked at."""
    return line.rlike(rf"^(?:[{WS}]*+[^{WS}]){{{least}}}")


def garbage_line(line: Column, compat: bool = True) -> Column:
    """Addresses, rules, and lines of few letters and digits; a blank line is none.

    compat keeps the wide class of RULES_ONLY."""
    # digits between are passed over; most lines have a mark that neither class holds
    rules = ~line.rlike(r"""[!"$%&'()*+,./:;?@\[]""") & line.rlike((RULES_ONLY if compat else RULES_STRICT).replace(r"]*\z", r"\d]*+\z"))
    thin = _solid(line, 3) & _thin(line, F.when(_solid(line, 16), 0.45).otherwise(0.55))
    # what holds an address holds its sign
    return _solid(line, 1) & (F.contains(line, F.lit("@")) | rules | line.rlike(r"(?i)e-?mail|www\.") | thin)


def sql_garbage_line(e: str) -> str:
    solid = sql_sub(e, rf"[{WS}]", "")
    share, total = f"(length({sql_sub(solid, _ALNUM, '')})::DOUBLE / nullif(length({solid}), 0))", f"length({solid})"
    digits = sql_sub(e, r"\d", "")
    return f"""({sql_trim(e)} <> '' AND ({sql_match(e, _EMAIL)} OR {sql_match(e, '(?i)e-?mail')} OR contains({e}, '@') OR {sql_match(e, '(?i)www[.]')} OR {sql_match(digits, RULES_ONLY)}
      OR coalesce({total} >= 3 AND (({total} > 15 AND {share} < 0.45) OR ({total} <= 15 AND {share} < 0.55)), false)))"""


def table_line(line: Column) -> Column:
    """A line of a bill of quantities."""
    return any_of(line, TABLE_LINE) | (line.rlike(TABLE_ROW[0]) & line.rlike(TABLE_ROW[1]))


def sql_table_line(e: str) -> str:
    return f"({sql_any(e, TABLE_LINE)} OR ({sql_match(e, TABLE_ROW[0])} AND {sql_match(e, TABLE_ROW[1])}))"


def heading_line(line: Column) -> Column:
    return any_of(line, HEADING_LINE)


def output_line(line: Column) -> Column:
    """What is left of an output line: collapsed, or null if it is dropped; '' if blank."""
    # what holds an address holds its sign, and all other kinds begin the line
    bad = lambda t: F.contains(t, F.lit("@")) | any_of(t, OUTPUT_DROPPED[2:] + TABLE_LINE) | (t.rlike(TABLE_ROW[0]) & t.rlike(TABLE_ROW[1])) | t.rlike("(?i)e-?mail") | (_solid(t, 10) & _thin(t, 0.5))
    return let(trim(line), lambda t: F.when(t == "", "").when((F.length(t) > 1) & ~bad(t), spaced(t)))


def sql_output_line(e: str) -> str:
    t = sql_trim(e)
    solid = sql_sub(t, rf"[{WS}]", "")
    bad = f"({sql_any(t, OUTPUT_DROPPED)} OR {sql_table_line(t)} OR coalesce(length({solid}) >= 10 AND length({sql_sub(solid, _ALNUM, '')})::DOUBLE / nullif(length({solid}), 0) < 0.5, false))"
    slim = sql_sub(t, rf"[{WS}]+", " ")
    return f"CASE WHEN {t} = '' THEN '' WHEN NOT {bad} AND length({slim}) > 1 THEN {slim} END"


def role_line(line: Column) -> Column:
    # no word begins within a bullet
    return (F.length(trim(line)) <= 200) & any_of(line, ROLE_WORDS)


def role_name(line: Column) -> Column:
    """The role's name: what stands before a dash, a colon or a comma, at most 80 letters."""
    first = lambda c, p, ok: let(F.split(c, p, 2), lambda parts: F.when((F.size(parts) > 1) & ok(F.length(parts[0])), trim(parts[0])))
    cut = lambda c: F.when(F.length(c) > 80, trim(F.regexp_replace(F.left(c, F.lit(80)), r"\s+\S*\z", ""))).otherwise(c)
    whole = trim(F.regexp_replace(trim(line), BULLET, ""))
    return let(whole, lambda c: F.coalesce(first(c, r"\s+[-–—]\s+", lambda n: n >= 5), first(c, r":\s*", lambda n: n >= 5), first(c, ",", lambda n: (n >= 5) & (n <= 80)), cut(c)))


def role_tail(line: Column) -> Column:
    """Requirements on the role's own line, after the first dash; null if there are none."""
    tail = trim(F.regexp_replace(line, r"^[^–—-]+[-–—]\s*", ""))
    return F.when(tail != trim(line), tail)


def garbage_document(text: Column, script: str = r"\x{400}-\x{4FF}", other: str = "a-zA-Z", share: float = 0.15) -> Column:
    """A text that is too short, has too few letters, or too few of the wanted script.

    script and other share no letter, and have no white space, digits or punctuation."""
    # so many are found early, or most of the text isn't of the class
    least = lambda cls, n, rest: text.rlike(rf"^(?:[{rest}]*+[{cls}]){{{n}}}+")
    count = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]++", ""))
    wanted, rest = count(script), count(other)
    solid = rf"{WS}\d\p{{P}}"
    few = (F.length(text) < 80) | ~least(f"^{solid}", 50, solid) | ~least(script + other, 30, f"^{script}{other}")
    return text.isNull() | few | (least(other, 21, f"^{other}") & (wanted < share * (wanted + rest)))


def sql_garbage_document(e: str) -> str:
    letters = sql_sub(e, rf"[{WS}\d\p{{P}}]", "")
    w, r = (f"length({sql_sub(letters, f'[^{c}]', '')})" for c in (r"\x{400}-\x{4FF}", "a-zA-Z"))
    return f"({e} IS NULL OR length({e}) < 80 OR length({letters}) < 50 OR {w} + {r} < 30 OR ({w} < 0.15 * ({w} + {r}) AND {r} > 20))"


# Document classes by name and by beginning, first match wins.
CLASSES = [
    ("contract", r"(?iu)проект\s*(на|за)\s*договор", r"(?iu)проект\s*(на|за)\s*договор"), ("documentation", r"(?iu)документация\s*(за\s*участие)?", r"(?iu)указания\s*за\s*участие"),
    ("techSpec", r"(?iu)техническ[аи]\s*спецификаци[яи]", r"(?iu)техническ[аи]\s*спецификаци[яи]"), ("parameters", r"(?iu)параметри", None), ("kss", r"(?iu)количествен[аи]\s*сметк[аи]|^кс[сc]", None),
    ("explanatoryNote", r"(?iu)doc_all|обяснителна|пътна", None), ("kss", None, r"(?iu)КОЛИЧЕСТВЕНА\s+СМЕТКА"), ("contract", None, r"(?iu)ПРОЕКТ\s+НА\s+ДОГОВОР"),
]


def document_class(filename: Column, start: Column) -> Column:
    """The class of a file by its name or the first letters of its body; else other."""
    name, body = F.lower(filename), F.lower(F.left(start, F.lit(500)))
    rules = [F.when((F.coalesce(name.rlike(n), F.lit(False)) if n else F.lit(False)) | (F.coalesce(body.rlike(b), F.lit(False)) if b else F.lit(False)), c) for c, n, b in CLASSES]
    return F.coalesce(*rules, F.lit("other"))


def sql_document_class(name: str, body: str) -> str:
    test = lambda n, b: " OR ".join(sql_match(e, p) for e, p in ((f"lower({name})", n), (f"lower(left({body}, 500))", b)) if p)
    when = " ".join(f"WHEN {test(n, b)} THEN '{c}'" for c, n, b in CLASSES)
    return f"CASE {when} ELSE 'other' END"
