"""Entities of tender texts: authority, subject, order number, object, place, clauses.

Each function takes a text column and gives the found value or a null (or the stated default)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .chains import trim
from .text import sanitize_filename


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _slim(value: Column) -> Column:
    return trim(F.regexp_replace(value, r"\s+", " "))


# How a tender names its authority, its subject and its number, in order.
AUTHORITY, MUNICIPALITY, NO_AUTHORITY = r"[Вв]ъзложител\s*[:\-–]\s*([^\n,]{5,80})", r"[Оо]бщина\s+([А-Яа-яA-Za-z\s\-]{3,40})", "Възложителя"
SUBJECT, STREET, NO_SUBJECT = r"[Пп]редмет\s+на\s+поръчката[:\s]+([^\n]{10,150})", r"(?:ул\.|бул\.|пл\.)\s+[„\"]?([А-Яа-яA-Za-z\s\-„\"]+)[„\"]?", "строително-монтажни работи"
NUMBERS = [  # pattern, and whether what was found is stripped of all but letters, digits and dashes
    (r"(?iu)номера?\s*на\s*поръчката\s*(?:е)?\s*[:\s]*([0-9A-Za-z\-]+)", True), (r"(?iu)поръчката\s*([0-9]{5}-[0-9]{4}-[0-9]{4})", False),
    (r"(?iu)референтен\s*номер\s*[:\s]*([0-9A-Za-z\-]+)", True), (r"([0-9]{5}-[0-9]{4}-[0-9]{4})", False),
]


def authority(text: Column) -> Column:
    return F.coalesce(_slim(found(text, AUTHORITY)), F.concat(F.lit("Община "), trim(found(text, MUNICIPALITY))), F.lit(NO_AUTHORITY))


def subject(text: Column) -> Column:
    return F.coalesce(trim(found(text, SUBJECT)), trim(found(text, STREET, 0)), F.lit(NO_SUBJECT))


def order_number(text: Column) -> Column:
    plain = lambda c: F.nullif(F.regexp_replace(trim(c), r"[^0-9A-Za-z_\-]", ""), F.lit(""))
    return F.coalesce(*[plain(found(text, p)) if stripped else found(text, p) for p, stripped in NUMBERS])


def main_object(text: Column, day: Column) -> Column:
    """The shortest fitting quoted phrase of the subject block, else an institution, else the day."""
    full = F.replace(text, F.lit("**"), F.lit(""))
    block = F.try_element_at(F.filter(F.split(full, r"\n\n+"), lambda b: trim(b).rlike(r"(?iu)^1\.\s*Предмет\s+на\s+поръчката")), F.lit(1))
    body = F.coalesce(trim(F.regexp_replace(block, r"^[\d.]+\s*[^\n]+\n?", "")), full)
    quoted = F.transform(F.regexp_extract_all(body, F.lit(r"[„\"]([^„\"]{2,40})[„\"]"), F.lit(1)), trim)
    fit = F.filter(quoted, lambda s: (F.length(s) >= 2) & (F.length(s) <= 30) & ~s.rlike(r"(?iu)^(за|на|в|от|с|до)\z"))
    # equally short phrases in their order
    best = F.try_element_at(F.array_sort(F.transform(fit, lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("s")))), F.lit(1))["s"]
    place = found(body, r"(?iu)(?:за нуждите на|възложител е|в)\s+[^,]+[„\"]([^„\"]{2,30})[„\"]")
    return F.coalesce(F.when(best.isNotNull(), sanitize_filename(best, 25)), F.when(place.isNotNull(), sanitize_filename(place, 25)), F.date_format(day, "yyyy-MM-dd"))


# Words that are no cities, and words that end no street's name.
NOT_CITY = (
    "тази този тези това тук там която който които което всяка всеки някои няма една едно един всички други друг друга нова нови нов ново стара стари стар старо голяма малка горна долна "
    "северна южна западна източна цяла цяло бъдещ бъдеща бъдещо когато обект обекта район района дейност дейности площ площта сграда сградата строеж строежа"
).split()
NOT_LAST = "е в на от за до по с се и или при като към без след между има може са ще да не".split()
_Q, _NQ = "[„\"«»“”]", "[^„\"«»“”\\n]"
_WORDS = r"([А-Яа-я]+(?:\s+[А-Яа-я]+){0,3})"


def city(text: Column) -> Column:
    """Of each pattern only the first hit is looked at."""
    hits = [found(text, p) for p in (r"гр(?:ада?)?\.?\s+([А-Я][а-я]{1,24})", r"община\s+([А-Я][а-я]{1,24})", r"с\.\s+([А-Я][а-я]{1,24})", r"общ(?:ина)?\.?\s+([А-Я][а-я]{1,24})")]
    return F.coalesce(*[F.when(~F.lower(h).isin(*NOT_CITY), h) for h in hits])


def _street(name: Column) -> Column:
    """Without stop words at the end; the first word stays."""
    tail = "|".join(NOT_LAST)
    return F.regexp_replace(_slim(name), rf"(?iu)(?<=\S)(?:\s+(?:{tail}))+\z", "")


# How a place is named, the first that is found counts: what stands before it,
# the pattern, whether words at its end that belong to no name go, and its least length.
PLACES = [
    ("ул. ", rf"(?iu)(?<!б)ул\.\s*{_Q}({_NQ}{{2,40}}){_Q}", False, 0), ("ул. ", rf"(?iu)(?<!б)ул\.\s+{_WORDS}", True, 2),
    ("ул. ", rf"(?iu)улица\s+{_Q}({_NQ}{{2,40}}){_Q}", False, 0), ("ул. ", rf"(?iu)улица\s+{_WORDS}", True, 2),
    ("АМ ", r"(?iu)(?:автомагистрала|АМ)\s+[„\"«»]?([А-Яа-яA-Za-z\s]{3,30}?)[„\"«»]?(?:\s*[,.]|\s+от\s+|\s+в\s+|\z)", False, 0),
    ("Път ", r"/([IV]+[-–][0-9]{1,3})/", False, 0), ("", r"(?iu)(?:път|пътен\s+участък)\s+([A-ZА-Яа-я0-9\s–-]{3,40}?)(?:\s*[,.]|\s+от\s+|\s+в\s+)", False, 0),
    ("бул. ", rf"(?iu)бул\.\s*{_Q}({_NQ}{{2,40}}){_Q}", False, 0), ("бул. ", rf"(?iu)бул\.\s+{_WORDS}", True, 0),
    ("бул. ", rf"(?iu)булевард\s+{_WORDS}", True, 2), ("кв. ", r"(?iu)кв(?:артал)?\.\s+([А-Яа-я]+(?:\s+[А-Яа-я]+){0,2})", True, 2),
]


def address(text: Column) -> Column:
    """A street, motorway, road, boulevard or district, in that order; else the city."""

    def place(prefix: str, pattern: str, named: bool, least: int) -> Column:
        got = found(text, pattern)
        name = _street(got) if named else _slim(got)
        return F.concat(F.lit(prefix), F.when(F.length(name) >= least, name) if least else name)

    return F.coalesce(*[place(*p) for p in PLACES], city(text))


def location(intro: Column, raw: Column) -> Column:
    """From the introduction unless that names a city only; then from the whole text."""
    a, b, ca, cb = address(intro), address(raw), city(intro), city(raw)
    got = F.coalesce(F.when(~F.coalesce(a == ca, F.lit(False)), a), b, a)
    town = F.coalesce(ca, cb)
    return F.concat(got, F.when(town.isNotNull() & ~F.contains(got, town), F.concat(F.lit(", "), town)).otherwise(""), F.lit(", България"))


# Where a guarantee clause begins and ends; the parameters of a documentation by
# name, with the most letters of some.
GUARANTEE, GUARANTEE_END, GUARANTEE_MOST = r"(?imu)(?:X\.|Х\.|ГАРАНЦИОННА\s+ОТГОВОРНОСТ)", r"(?m)\n\s*(?:Х?I{1,3}|XI{1,3})\.\s+[А-ЯA-Z]", 3000
GUARANTEE_TITLE, PARAMETERS_TITLE = "[Извлечено от Проект на договор – Гаранционна отговорност]\n", "[Извлечено от Документация за участие – ключови параметри]\n"
PARAMETERS = [
    ("Предмет", r"(?imu)(?:предмет\s+на\s+(?:настоящата\s+)?(?:обществена(?:та)?\s+)?поръчка(?:\s+е)?:?\s*)([\s\S]{20,800}?)(?=\n\s*(?:\d+\.\s+|предвижда|пълната\s+информация|има\s+изготвен))", 1000),
    ("Критерий за възлагане", r"(?imu)критери[ий]\s+за\s+възлагане[^.]*?(?:„[^\"]+\"|най[\s–-]+ниска\s+цена|оптимално\s+съотношение)[^.]{0,200}\.", None),
    ("Процедура", r"(?imu)(?:вид\s+на\s+процедурата|публично\s+състезание|открита\s+процедура)[^.]{0,200}\.", None),
    ("Финансиране", r"(?imu)финансиране[:\s][\s\S]{0,500}?(?=\n\s*\d+\.\d*\s+|$)", 500),
]


def guarantee(body: Column) -> Column:
    """The guarantee clause of a draft contract: up to the next section, else 3000 letters.

    A clause that the text begins with counts as none."""
    at = F.regexp_instr(body, F.lit(GUARANTEE))
    rest = F.substr(body, at)
    stop = F.regexp_instr(rest, F.lit(GUARANTEE_END))
    clause = trim(F.left(rest, F.when(stop > 1, stop - 1).otherwise(F.lit(GUARANTEE_MOST))))
    return F.when(at > 1, F.concat(F.lit(GUARANTEE_TITLE), clause))


def key_parameters(body: Column) -> Column:
    """Subject, criterion, procedure and financing, as far as they are given; else null."""
    part = lambda name, p, most: F.concat(F.lit(f"{name}: "), trim(found(body, p, 0)) if most is None else F.left(trim(found(body, p, 0)), F.lit(most)))
    whole = F.concat_ws("\n\n", *[part(*p) for p in PARAMETERS])
    return F.when(whole != "", F.concat(F.lit(PARAMETERS_TITLE), whole))


def llm_object(content: Column) -> Column:
    """struct matchedTitle, confidence, reasoning of the widest {...}; null if it isn't JSON.

    confidence is cut to 0 to 100, and 0 if it isn't a number."""
    raw = found(content, r"\{[\s\S]*\}", 0)
    j = F.try_parse_json(raw)
    number = F.when(F.schema_of_variant(F.try_variant_get(j, "$.confidence", "variant")).isin("BIGINT", "DOUBLE") | F.schema_of_variant(F.try_variant_get(j, "$.confidence", "variant")).startswith("DECIMAL"), F.try_variant_get(j, "$.confidence", "double"))
    return F.when(j.isNotNull(), F.struct(
        F.coalesce(F.try_variant_get(j, "$.matchedTitle", "string"), F.lit("")).alias("matchedTitle"),
        F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), number)), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.try_variant_get(j, "$.reasoning", "string"), F.lit("")).alias("reasoning"),
    ))


def llm_rows(content: Column, schema: str) -> Column:
    """The array of structs in the widest [...]; null if it isn't JSON."""
    return F.from_json(found(content, r"\[[\s\S]*\]", 0), schema)


# The kinds of sections of an offer, and the section that stands for all of it.
SECTION_KINDS = ("introduction", "smr_technology", "team_organization", "communication", "other")
WHOLE = ("other", "Цялото съдържание")


def section_list(content: Column) -> Column:
    """Array of structs type, title, offset from an answer's JSON: rows of known kinds that have
    a title, the first technology only. What isn't JSON is one section that holds everything."""
    rows = F.transform(llm_rows(content, "array<struct<type:string,title:string,offset:int>>"), lambda x: F.struct(x["type"].alias("type"), x["title"].alias("title"), F.coalesce(x["offset"], F.lit(0)).alias("offset")))
    known = F.filter(rows, lambda x: x["type"].isin(*SECTION_KINDS) & (F.coalesce(x["title"], F.lit("")) != ""))
    first = lambda v: F.array_position(F.transform(v, lambda x: x["type"]), F.lit("smr_technology"))
    kept = F.transform(F.array(known), lambda v: F.filter(v, lambda x, i: (x["type"] != "smr_technology") | (i == first(v) - 1)))[0]
    return F.coalesce(kept, F.array(F.struct(F.lit(WHOLE[0]).alias("type"), F.lit(WHOLE[1]).alias("title"), F.lit(0).alias("offset"))))
