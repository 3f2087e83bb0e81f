"""Normalisers and scalar functions over text columns.

Each takes a string column and gives a column; a null gives a null unless said otherwise.
None of them needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .chains import WS, Chain, spaced, trim

# Tag, entity and punctuation patterns, in the order in which they apply.
_TAGS_TO_SPACE = ("sub", r"<[^>]+>", " ")
_TAGS_GONE = ("sub", r"<[^>]+>", "")
_COLLAPSE = ("spaced",)
_FIVE = [("swap", "&nbsp;", " "), ("swap", "&amp;", "&"), ("swap", "&lt;", "<"), ("swap", "&gt;", ">"), ("swap", "&quot;", '"')]
_MOST_TWO_BREAKS = ("sub", r"\n{3,}", "\n\n")

#: Tags and no-break spaces become spaces, which collapse.
html_inline = Chain(_TAGS_TO_SPACE, ("sub", "(?iu)&nbsp;", " "), _COLLAPSE)
#: White space collapses before entities are decoded, so decoded spaces stay.
html_template = Chain(_TAGS_TO_SPACE, _COLLAPSE, *_FIVE, ("trim",))
#: Block tags become line breaks.
html_block = Chain(
    ("sub", r"(?iu)</?(p|h[1-6]|br|tr|li|div|blockquote|hr)[^>]*>", "\n"), _TAGS_GONE, *_FIVE, ("swap", "&#39;", "'"),
    ("lines",), ("trim",),
)
#: Line breaks and paragraph ends keep their weight.
html_paragraphs = Chain(("sub", r"(?iu)<br\s*/?>", "\n"), ("sub", "(?iu)</p>", "\n\n"), ("sub", "(?iu)</li>", "\n"), _TAGS_GONE, *_FIVE, _MOST_TWO_BREAKS, ("trim",))
_export = Chain(("sub", r"(?iu)</?(p|div|h[1-6]|li|tr)[^>]*>", "\n\n"), ("sub", r"(?iu)<br\s*/?>", "\n"), _TAGS_GONE, *_FIVE, _MOST_TWO_BREAKS, ("trim",))
#: Seven entities; the ampersand comes first, so an escaped entity is decoded twice.
entities = Chain(("swap", "&amp;", "&"), ("swap", "&lt;", "<"), ("swap", "&gt;", ">"), ("swap", "&quot;", '"'), ("swap", "&#x27;", "'"), ("swap", "&#39;", "'"), ("swap", "&nbsp;", " "))

_QUOTES = "\"'„“”«»"
#: Title keys: with look-alike letters folded to Cyrillic (for matching), plain (for the
#: library), and for comparing with registry titles.
title_key_folded = Chain(("lower",), ("fold", "tcoaepx", "тсоаерх"), ("sub", rf"^[{_QUOTES}]+|[{_QUOTES}]+\z", ""), ("spaced", r".,;:!?–—\-()/\\\[\]{}"), ("trim",))
title_key_plain = Chain(("lower",), ("spaced", r".,;:!?–—\-()"), ("trim",))
title_key_compare = Chain(("lower",), ("spaced", r".,;:\-–—()\[\]/\\"), ("trim",))

markdown_plain = Chain(("sub", r"\*\*([^*]+)\*\*", "$1"), ("sub", "🔹", ""))
_filename = Chain(("sub", rf"[{WS}]+", "_"), ("sub", r"[^\p{L}\p{N}_-]", ""), ("sub", "_+", "_"), ("sub", r"^_|_\z", ""))

# Words that don't count when titles are matched.
STOP_WORDS = (
    "и на в с за от до по при към се е да не ще а или но че като ли бъде със без след преди между над под включително всички свързани това разходи съгласно "
    "изискванията определено растояние разстояние включителн вкл вс дейности работи тс тех техническата техническите спецификация доставка монтаж направа изпълнение"
).split()
token_text = Chain(("lower",), ("sub", r"[.,;:!?\"'–—\-()/\\\[\]{}]", " "))

#: What a standard's designation loses before it is compared, and a regulation's forms.
standard_name = Chain(("trim",), ("sub", "ЕN|ЕН", "EN"), ("sub", r":[0-9]{4}.*", ""), ("sub", r"-(19[0-9]{2}|20[0-9]{2})\z", ""), ("sub", r"[.,;]+\z", ""), ("trim",))

# Cyrillic letters and their Latin spelling in stored names.
LATIN = dict(zip("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЬЮЯ", "A B V G D E Zh Z I Y K L M N O P R S T U F H Ts Ch Sh Sht A Y Yu Ya".split(), strict=True))
LATIN |= {k.lower(): v.lower() for k, v in LATIN.items()}


def html_export(html: Column) -> Column:
    """Block tags become blank lines; a text without tags comes back untouched."""
    return F.when(F.contains(html, F.lit("<")), _export(html)).otherwise(html)


def text_to_html(text: Column) -> Column:
    """Paragraphs at blank lines; what begins with a tag passes; null gives the empty text."""
    parts = F.transform(F.split(text, "\n\n+"), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).when(F.startswith(text, F.lit("<")), text).otherwise(F.array_join(parts, ""))


def tokens(text: Column) -> Column:
    """Words of two letters or more without stop words, in order, repeated ones repeated."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(token_text(text), rf"[{WS}]+"), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))


def sanitize_filename(text: Column, most: int, empty: str = "поръчка") -> Column:
    """Letters, digits, _ and - only, at most so many, never empty (null as well)."""
    cut = F.regexp_replace(F.left(_filename(text), F.lit(most)), r"_\z", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(empty))


def safe_path(name: Column, day: Column) -> Column:
    """Storage path: the day, then the name in Latin letters with other characters as _."""
    table = F.create_map(*[F.lit(x) for kv in LATIN.items() for x in kv])
    latin = F.array_join(F.transform(F.split(name, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_"), F.regexp_replace(latin, r"[^a-zA-Z0-9._-]", "_"))


def fix_mojibake(name: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; what isn't such stays as it is."""
    bytes_ = F.when(~name.rlike(r"[^\x{0}-\x{FF}]"), F.encode(name, "ISO-8859-1"))
    return F.coalesce(F.try_validate_utf8(bytes_.cast("string")), name)


def parse_quantity(cell: Column) -> Column:
    """The number at the start, the first comma read as a point; 0 where there is none."""
    plain = F.regexp_replace(F.regexp_replace(cell, rf"[{WS}]", ""), r"^([^,]*),", "$1.")
    number = F.regexp_extract(plain, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", 0)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def regulation_name(raw: Column) -> Column:
    """One way of writing: Наредба № 3 от 31.07.2003 г."""
    s = trim(raw)
    first = F.regexp_extract(s, r"^[А-ЯA-Z][А-Яа-яA-Za-z]+", 0)
    s = F.concat(F.left(first, F.lit(1)), F.lower(F.substr(first, F.lit(2))), F.substr(s, F.length(first) + 1))
    # each of these is done once, at the first place
    s = F.regexp_replace(s, r"(?iu)^(.*?)\s*(?:№|No\.?)\s*", "$1 № ")
    s = F.regexp_replace(s, r"^(.*?)\s+[Оо][Тт]\s+", "$1 от ")
    s = F.regexp_replace(s, r"([0-9]{4})\s*г?\.?\z", "$1 г.")
    return trim(spaced(s))


def search_term(name: Column) -> Column:
    """The number of a designation, or all of it where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"([0-9][0-9\-.:]+[0-9])", 1), F.lit("")), name)


def regulation_parts(name: Column) -> Column:
    """struct id, year, month of a regulation's name; empty where not given."""
    date = r"от\s+[0-9]{1,2}\.([0-9]{1,2})\.([0-9]{4})"
    month = F.regexp_extract(name, date, 1)
    return F.struct(F.regexp_extract(name, r"№\s*([А-Яа-яA-Za-z\-]*[0-9][0-9A-Za-z_\-]*)", 1).alias("id"), F.regexp_extract(name, date, 2).alias("year"), F.when(month == "", "").otherwise(F.lpad(month, 2, "0")).alias("month"))


# Month names, and words that say nothing in a search.
MONTHS = "януари февруари март април май юни юли август септември октомври ноември декември".split()
DULL = "като това която които при или след преди между".split()


def month_name(month: Column) -> Column:
    """The name of a month given with two digits; empty for anything else."""
    table = F.create_map(*[x for n, m in enumerate(MONTHS, 1) for x in (F.lit(f"{n:02d}"), F.lit(m))])
    return F.coalesce(F.try_element_at(table, month), F.lit(""))


def regulation_query(name: Column, description: Column) -> Column:
    """Search words: number, month, year and up to three telling words of a description."""
    p = regulation_parts(name)
    words = F.filter(F.split(F.lower(F.coalesce(description, F.lit(""))), rf"[{WS}]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*DULL))
    prefix = F.when(p["id"].rlike(r"^[0-9]+\z"), F.lit("наредба ")).otherwise("")
    whole = F.concat_ws(" ", F.concat(prefix, p["id"]), month_name(p["month"]), p["year"], F.array_join(F.slice(words, 1, 3), " "))
    return trim(F.regexp_replace(whole, rf"[{WS}]+", " "))


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 80, "high").when(confidence >= 60, "medium").otherwise("low")


def valid_uuid(text: Column) -> Column:
    return text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z")


def comparison_words(title: Column) -> Column:
    """The distinct words of four letters or more."""
    return F.array_distinct(F.filter(F.split(title_key_compare(title), " "), lambda w: F.length(w) >= 4))


def title_jaccard(a: Column, b: Column) -> Column:
    """Shared words of all words; 0 where either title has none."""
    x, y = comparison_words(a), comparison_words(b)
    shared = F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(shared)


def title_mismatch(found: Column, official: Column) -> Column:
    """Whether a cited title differs from the official one; an empty side never does.

    Up to five words must share one with the official title, longer titles 3 of 10."""
    words = F.filter(F.split(title_key_compare(found), " "), lambda w: F.length(w) >= 4)
    key = title_key_compare(official)
    short = (F.size(words) > 0) & ~F.exists(words, lambda w: F.contains(key, w))
    few = F.size(F.split(trim(found), rf"[{WS}]+")) <= 5
    blank = (F.coalesce(found, F.lit("")) == "") | (F.coalesce(official, F.lit("")) == "")
    return F.when(blank, False).when(few, short).otherwise(title_jaccard(found, official) < 0.3)
