"""Format-preserving pseudonyms for numbers and dates, with Spark's own functions only.

A found value is validated, split into digits that carry information and digits that follow
from them, and the former are permuted by a Feistel network whose round function is a keyed
SHA-256. Its halves count to a and b, whose product is the size of the format or a little more;
walking the cycle keeps the result inside. The same value gets the same pseudonym in every
document, and different values different ones:

    payment card    13 to 19 digits that pass the Luhn check, one or more whole groups of
                    digits; the first digit and all separators stay, the last digit is
                    computed anew
    IP address      four numbers of 0 to 255; the 32-bit address is permuted
    telephone       + and 8 to 15 digits, up to what is itself an address, a date or a card in
                    its usual groups; as many digits as its country's numbers have, where these
                    have one length (NATIONAL), and of others no short group behind 11 digits,
                    so that equal telephones link whatever follows; the first digit and all
                    separators stay
    date            a day of 1900-01-01 to 2099-12-31, written y-m-d, d.m.y or d/m/y, or m/d/y
                    where d/m/y is no day; days of that range are permuted (for m/d/y those
                    after the 12th, so that the result reads the same way). The order and the
                    separators stay; parts are padded with zeros unless one of them wasn't

Numbers that fail validation stay as they are. The key is a parameter; it goes to the rows as a
column, so neither plans nor logs show it. With the same key a pseudonym can be undone by
running the rounds backwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ROUNDS = 8
#: Fixed patterns, as Java and RE2 both read them; a value stands between characters that are
#: neither letters nor digits, which is tested on the match's surroundings.
ADDRESS = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
DATE = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
#: Groups of digits, of which some may make a card: no group that begins an address or a date.
GROUP = r"[0-9]++(?![A-Za-z])"
CARDS = rf"(?=[0-9](?:[ -]?[0-9]){{12}}){GROUP}(?:[ -](?!(?:{DATE}|{ADDRESS})(?![0-9A-Za-z])){GROUP})*+"
#: What a telephone stops before: a sound address or date, or a card in its usual groups.
_BYTE, _DAY, _MONTH, _YEAR = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})", "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
_FOURS = "[0-9]{4}(?:[ -][0-9]{4}){3}"
STOP = rf"(?:{_BYTE}(?:\.{_BYTE}){{3}}|{_YEAR}-{_MONTH}-{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_DAY}/{_MONTH}/{_YEAR}|{_FOURS}(?:[ -]{_FOURS})*+(?![ -][0-9]{{4}}(?![0-9]))|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})(?![0-9A-Za-z]|\.[0-9])"
#: Country codes whose numbers have one length, by the digits behind the code.
NATIONAL = {
    8: "45 47 65 216 353 370 371 372 373 374 375 501 502 503 504 505 506 507 591 852 853 965 968 973 974",
    9: "27 31 32 33 34 41 48 51 56 61 84 94 351 355 376 380 381 385 420 421 593 595 966 971 972 977 992 994 995",
    10: "1 7 20 30 40 44 52 57 58 60 63 82 90 91 92 98",
}
_GAP = rf"(?:[ ().-]{{1,2}}(?<!\.)(?!{STOP})|\.|[ ().-]\.)?"
_FIXED = "|".join(rf"(?:{codes.replace(' ', '|')})(?:{_GAP}[0-9]){{{n}}}" for n, codes in NATIONAL.items())
#: Behind 11 digits of other numbers a space and one to three digits are something else.
PHONE = rf"\+(?:(?:{_FIXED})(?![0-9])|[0-9](?:{_GAP}[0-9]){{7,10}}(?:(?! [0-9]{{1,3}}(?![0-9])){_GAP}[0-9]){{0,4}})"
VALUE = rf"(?<![0-9A-Za-z.+])(?:{PHONE}|{DATE}|{ADDRESS}|{CARDS})(?![0-9A-Za-z])"

FIRST_DAY, DAYS = "1900-01-01", 73049


#: The column that holds the key; columns of the documents have other names meanwhile.
KEY = "pii_key"
#: So many steps along a cycle don't end outside the format but with a probability below 1e-24.
MOST_STEPS = 64


def _feistel(x: str, a: str, b: str, tweak: str) -> str:
    """SQL: the permutation of the numbers below a * b at x, all of them long."""
    draw = lambda half: f"cast(conv(substring(sha2(concat_ws('|', {KEY}, '{tweak}', cast({a} as string), cast({b} as string), cast(i as string), cast({half} as string)), 256), 1, 15), 16, 10) as bigint)"
    step = f"if(i % 2 = 0, named_struct('l', pmod(acc.l + {draw('acc.r')}, {a}), 'r', acc.r), named_struct('l', acc.l, 'r', pmod(acc.r + {draw('acc.l')}, {b})))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {x} div {b}, 'r', {x} % {b}), (acc, i) -> {step}, acc -> acc.l * {b} + acc.r)"


def _sealed(digits: str, tweak: str) -> str:
    """SQL: a string of digits, permuted among those of its length."""
    a, b = "cast(pow(10, length(y) div 2) as bigint)", "cast(pow(10, length(y) - length(y) div 2) as bigint)"
    body = _let("cast(y as bigint)", "x", _let(a, "p10", _let(b, "q10", f"lpad(cast({_feistel('x', 'p10', 'q10', tweak)} as string), length(y), '0')")))
    return _let(digits, "y", body)


def _walk(x: str, a: int, b: int, ok: str, tweak: str) -> str:
    """SQL: the first value on the cycle from x for which ok (over v) holds, as it does for x."""
    step = _feistel("z.v", f"{a}L", f"{b}L", tweak)
    tried = f"if(z.go, {_let(step, 'v', f'named_struct({chr(39)}v{chr(39)}, v, {chr(39)}go{chr(39)}, not ({ok}))')}, z)"
    end = "if(z.go, cast(raise_error('no value of the format on the cycle') as bigint), z.v)"
    return f"aggregate(sequence(1, {MOST_STEPS}), named_struct('v', {x}, 'go', true), (z, n) -> {tried}, z -> {end})"


def _letters(form: str, digits: str) -> str:
    """SQL: the digits put in the places of the digits of form."""
    return (
        f"aggregate(split({form}, ''), named_struct('s', '', 'n', 1), "
        f"(a, c) -> if(c between '0' and '9', named_struct('s', concat(a.s, substring({digits}, a.n, 1)), 'n', a.n + 1), named_struct('s', concat(a.s, c), 'n', a.n)), a -> a.s)"
    )


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a string of digits."""
    twice = "if((length({d}) - i) % 2 = 0, c * 2 - if(c > 4, 9, 0), c)".format(d=digits)
    return f"aggregate(transform(split({digits}, ''), (c, i) -> aggregate(array(cast(c as int)), 0, (z, c) -> {twice})), 0, (a, x) -> a + x)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value once (an array of one, transformed)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _card(m: str) -> str:
    """SQL: the pseudonym of m, a card."""
    check = _luhn("concat(s, '0')")
    whole = _let(f"concat(substring(d, 1, 1), {_sealed('substring(d, 2, length(d) - 2)', 'card')})", "s", f"concat(s, cast(pmod(10 - ({check}) % 10, 10) as string))")
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "d", _let(whole, "p", _letters(m, "p")))


def _cards(m: str) -> str:
    """SQL: the parts of m, groups of digits: cards and, with a null kind, what is between them.

    A group that is a card by itself, or groups of the usual lengths that are one, are taken as
    they stand; else the longest card from each group on that takes in none of these. Where no
    card is found, m is one part that stays."""
    digits = lambda i, j: f"array_join(slice(g, {i} + 1, {j} - {i} + 1), '')"
    sound = lambda d: _let(d, "x", f"case when length(x) between 13 and 19 then {_luhn('x')} % 10 = 0 else false end")
    lengths = lambda i, n: f"array_join(transform(slice(g, {i} + 1, {n}), y -> length(y)), ' ')"
    # the last group of the usual card that begins at each group
    usual = "case " + f"when {sound(digits('i', 'i'))} then i "
    for form in ("4 4 4 4", "4 4 4 4 3", "4 6 5", "4 6 4"):
        n = len(form.split())
        usual += f"when {lengths('i', n)} = '{form}' and {sound(digits('i', f'(i + {n - 1})'))} then i + {n - 1} "
    usual += "end"
    other = f"array_max(filter(sequence(i, least(i + 18, size(g) - 1)), j -> forall(slice(u, i + 2, j - i), w -> w is null) and {sound(digits('i', 'j'))}))"
    ends = f"transform(g, (z, i) -> coalesce(u[i], {other}))"
    places = "aggregate(sequence(0, size(g) - 1), named_struct('next', 0, 'found', cast(array() as array<struct<a:int,b:int>>)), (acc, i) -> if(i >= acc.next and e[i] is not null, named_struct('next', e[i] + 1, 'found', concat(acc.found, array(named_struct('a', i, 'b', e[i])))), acc), acc -> acc.found)"
    rest = lambda v: f"named_struct('value', {v}, 'kind', cast(null as string), 'pseudonym', {v})"
    text = lambda i, n: f"array_join(slice(t, {i} + 1, {n}), '')"
    card = _let(text("s.a", "s.b - s.a + 1"), "v", _let("regexp_replace(v, '^[ -]', '')", "c", f"named_struct('value', c, 'kind', 'card', 'pseudonym', {_card('c')})"))
    before = _let("if(n = 0, 0, f[n - 1].b + 1)", "o", _let(f"concat({text('o', 's.a - o')}, regexp_extract(t[s.a], '^[ -]?', 0))", "v", rest("v")))
    after = _let("f[size(f) - 1].b + 1", "o", _let(text("o", "size(t) - o"), "v", rest("v")))
    parts = f"if(size(f) = 0, array(named_struct('value', {m}, 'kind', 'card', 'pseudonym', {m})), concat(flatten(transform(f, (s, n) -> array({before}, {card}))), array({after})))"
    body = _let(f"transform(g, (z, i) -> {usual})", "u", _let(ends, "e", _let(places, "f", parts)))
    return _let(f"regexp_extract_all({m}, '[ -]?[0-9]+', 0)", "t", _let(f"regexp_extract_all({m}, '[0-9]+', 0)", "g", body))


def _phone(m: str) -> str:
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "d", _let(f"concat(substring(d, 1, 1), {_sealed('substring(d, 2)', 'phone')})", "p", _letters(m, "p")))


def _address(m: str) -> str:
    number = f"aggregate(split({m}, '[.]'), 0L, (n, part) -> n * 256 + cast(part as bigint))"
    sealed = _let(number, "x", _feistel("x", "65536L", "65536L", "address"))  # just the addresses that there are
    back = "concat_ws('.', transform(array(16777216L, 65536L, 256L, 1L), p -> cast((q div p) % 256 as string)))"
    return f"if(forall(split({m}, '[.]'), part -> cast(part as int) < 256), {_let(sealed, 'q', back)}, {m})"


def _date(m: str) -> str:
    number = lambda y, mo, d: f"datediff(try_to_date(concat_ws('-', {y}, lpad({mo}, 2, '0'), lpad({d}, 2, '0')), 'yyyy-MM-dd'), date'{FIRST_DAY}')"
    day = f"case when {m} like '%-%' then {number('t[0]', 't[1]', 't[2]')} else {number('t[2]', 't[1]', 't[0]')} end"
    back = f"date_add(date'{FIRST_DAY}', cast(v as int))"
    # 270 * 271 is a little more than the days that there are
    sealed = _walk("cast(g as bigint)", 270, 271, f"v < {DAYS}", "date")
    late = _walk("cast(u as bigint)", 270, 271, f"case when v < {DAYS} then day({back}) > 12 else false end", "late date")
    padded = f"not exists(slice(t, if({m} like '%-%', 2, 1), 2), part -> length(part) = 1)"
    form = lambda wide, narrow: f"date_format({back}, if({padded}, '{wide}', '{narrow}'))"
    text = f"case when {m} like '%-%' then {form('yyyy-MM-dd', 'yyyy-M-d')} when {m} like '%.%' then {form('dd.MM.yyyy', 'd.M.yyyy')} else {form('dd/MM/yyyy', 'd/M/yyyy')} end"
    american = _let(f"if({m} like '%/%', {number('t[2]', 't[0]', 't[1]')}, null)", "u", f"if(u between 0 and {DAYS - 1}, {_let(late, 'v', form('MM/dd/yyyy', 'M/d/yyyy'))}, {m})")
    return _let(f"split({m}, '[-./]')", "t", _let(day, "g", f"if(g between 0 and {DAYS - 1}, {_let(sealed, 'v', text)}, {american})"))


def _kind(m: str) -> str:
    return f"case when startswith({m}, '+') then 'phone' when {m} rlike '^(?:{ADDRESS})$' then 'address' when {m} rlike '^(?:{DATE})$' then 'date' else 'card' end".replace("\\", "\\\\")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text's values replaced, and values: what was replaced by what, in order
    (value, kind, pseudonym).

    Null texts stay null, with no values; texts without values stay as they are. Each row is
    worked on by itself, so repeated rows stay equal: no shuffle, and no other column is
    touched. An empty table gives no rows. Where docs has a column named values, the added one
    has underscores before its name."""
    held = [f"c{i}" for i in range(len(docs.columns))]  # names that nothing here has
    whole = F.col(held[[c.lower() for c in docs.columns].index(text.lower())]).cast("string")
    secret = docs.sparkSession.createDataFrame([(key,)], f"{KEY} string")
    rows = docs.toDF(*held).crossJoin(F.broadcast(secret))  # one row, which no plan shows
    sealed = f"case k when 'phone' then {_phone('m')} when 'address' then {_address('m')} else {_date('m')} end"
    each = _let(_kind("m"), "k", f"if(k = 'card', {_cards('m')}, array(named_struct('value', m, 'kind', k, 'pseudonym', {sealed})))")
    found = rows.withColumn("found", F.regexp_extract_all(whole, F.lit(VALUE), F.lit(0)))
    found = found.withColumn("parts", F.expr(f"transform(coalesce(found, array()), m -> {each})"))
    # the text between the values, then piece and pseudonyms in turn
    pieces = F.split(whole, VALUE, -1)
    new = F.expr("transform(parts, x -> array_join(x.pseudonym, ''))")
    joined = F.concat_ws("", F.flatten(F.zip_with(pieces, F.concat(new, F.array(F.lit(""))), lambda p, v: F.array(p, v))))
    changed = F.when(F.size("found") > 0, joined).otherwise(whole)
    name = "values"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    columns = [(changed if c.lower() == text.lower() else F.col(h)).alias(c) for c, h in zip(docs.columns, held, strict=True)]
    return found.select(*columns, F.expr("filter(flatten(parts), p -> p.kind is not null)").alias(name))
