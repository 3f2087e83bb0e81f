"""Operators over HTML texts: paragraphs, tables, blocks, sections, images.

What is inside one text is found in its row: no operator shuffles texts to their tags. Positions
count letters from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..functions.chains import trim
from ..functions.places import all_matches, table_spans
from .lines import let

FOLD = ("tcoaepx", "тсоаерх")


def paragraphs(pages: DataFrame, key: str, html: str = "html", tag: str = "p") -> DataFrame:
    """key, pos, raw, text of the elements of a tag, in order."""
    found = F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}(?:\s[^>]*)?>[\s\S]*?</{tag}>"), F.lit(0))
    return pages.select(key, F.posexplode(found).alias("pos", "raw")).withColumn("text", X.html_paragraphs(F.col("raw")))


def position_heading(raw: Column, text: Column) -> Column:
    """Whether a paragraph names a role: short, Cyrillic, bold or with a role's word."""
    bold, n = raw.rlike(r"(?i)<strong>|<b>"), F.length(text)
    dull = text.rlike(r"(?iu)^[0-9]+\.\s*(Етап|Основни|Задължения|Отговорности)") | text.rlike("^[✅🔹]") | text.rlike(r"(?iu)^(Ключови експерти|Основна цел)")
    role = text.rlike(r"(?iu)ръководител|специалист|експерт|лице\s+по|координатор|инженер|геодез")
    return (n >= 3) & (n <= 80) & ~dull & text.rlike("[А-Яа-яЁё]") & ~text.rlike(r"[.;:!?]\z") & (bold | role)


def toplevel_tables(pages: DataFrame, key: str, html: str = "html", most: int = 8000) -> DataFrame:
    """key, ord, start, stop, table: tables that stand in no other, stop behind the end tag.

    A stray end tag is passed over; a table without an end reaches so many letters on, or to
    the text's end. Each page is looked at in its row; nulls and texts without tables give no
    rows, rows that share a key are pages of their own."""
    return pages.select(key, F.inline(table_spans(F.col(html), most)))


def first_cell(table: Column) -> Column:
    return F.regexp_extract(table, r"(?i)<td[^>]*>([\s\S]*?)</td\s*>", 1)


def title_table(table: Column) -> Column:
    """Whether a table is a heading: its first cell is emphasised and not all capitals."""
    cell, title = first_cell(table), X.html_template(first_cell(table))
    bare = F.regexp_replace(title, r"[\s\d.,;:()\-–—/]", "")
    return cell.rlike(r"(?i)<strong>|<em>") & (F.length(title) >= 3) & (F.length(title) <= 500) & (bare.rlike("[а-яa-z]") | (bare == ""))


def template_blocks(pages: DataFrame, key: str, html: str = "html", least: int = 20) -> DataFrame:
    """key, ord, title, body, html_body: each title table and what stands up to the next one."""
    found = pages.select(key, F.col(html).alias("_html"), F.filter(table_spans(F.col(html)), lambda t: title_table(t["table"])).alias("_t"))
    end = lambda i: F.coalesce(F.get("_t", i + 1)["start"], F.length("_html"))
    blocks = F.transform("_t", lambda t, i: F.struct(t["ord"].alias("ord"), t["table"].alias("table"), F.substr("_html", t["stop"] + 1, end(i) - t["stop"]).alias("raw")))
    out = found.select(key, F.inline(blocks)).select(key, "ord", X.html_template(first_cell(F.col("table"))).alias("title"), X.html_template(F.col("raw")).alias("body"), trim(F.col("raw")).alias("html_body"))
    return out.filter(F.length("body") >= least)


# Words of a resource table (letters folded), and first cells of inner tables.
RESOURCES = ("ангажирани", "строителни лица", "технически ресурси", "механизация")
INNER = (
    r"(?iu)роля\s+(на\s+)?отговорн|експерт\s*[/\\|,]\s*(длъжност|роля)|длъжност\s*[/\\|,]\s*експерт|^отговорен\s+експерт\z|^отговорност|^експерт\z|^длъжност\z|^специалист\z|^роля\z|^(№|No\.?|#)\s*\z"
    r"|^задача\z|^етап\z|^показател\z|^параметър\z|^материал\z|^машина\z|^механизация\z|^вид\s+контрол\z|^коефициент\z|^категория\s+персонал|^изпитване\z|^контролиран\s+елемент\z|^контролен\s+параметър\z"
    r"|^машина\s*[/\\|]\s*съоръжение|^съоръжение\s*[/\\|]\s*машина|^клас(ове)?\s+на\s+улиц|^група\s+по\s+тс|^брой\s+на\s+пътните\s+знаци|^член\s+на\s+екип"
)


def resource_table(table: Column) -> Column:
    """Whether a table lists a technology's resources: two of four words, a telling first cell."""
    folded = F.translate(F.lower(table), *FOLD)
    words = sum((F.contains(folded, F.lit(w)).cast("int") for w in RESOURCES), F.lit(0))
    name = X.html_block(F.regexp_extract(table, r"(?i)<t[dh][^>]*>([\s\S]*?)</t[dh]>", 1))
    return (words >= 2) & (F.length(name) > 3) & (F.length(name) < 300) & ~name.rlike(INNER)


def price_table(table: Column) -> Column:
    low = F.lower(table)
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return has("ед. цена", "единична цена", "ед.цена") & has("обща стойност", "стойност лв")


_STOP_WORDS = r"мерки\s+(?:за|по)\s+збут|график\s+за\s+изпълнение|количествено\s+стойностна\s+сметка"
BOUNDARY = rf"(?iu)<(?:h[1-6]|p|strong)[^>]*>[^<]*(?:{_STOP_WORDS}|кол[.]?\s*стойностна)[^<]*</(?:h[1-6]|p|strong)>"


def blocks_of_tables(html: Column, spans: Column, least: int = 20) -> Column:
    """Array of structs ord, title, html_body, plain of one text, as technology_blocks() gives
    them; spans: its tables, as table_spans()."""

    def cut(t: Column, last: Column) -> Column:
        prices = F.filter(spans, lambda x: (x["start"] > last) & price_table(x["table"]))
        head = F.regexp_instr(F.substr(html, last + 1), F.lit(BOUNDARY))
        end = let(head, lambda at: F.least(F.get(prices, F.lit(0))["start"], F.when(at > 1, last + at - 1), F.length(html)))
        raw = lambda x, i, end: trim(F.substr(html, x["start"] + 1, F.least(F.get(t, i + 1)["start"], end) - x["start"]))
        name = lambda x: X.html_block(F.regexp_extract(x["table"], r"(?i)<t[dh][^>]*>([\s\S]*?)</t[dh]>", 1))
        block = lambda x, i, raw: F.struct((i + 1).alias("ord"), name(x).alias("title"), raw.alias("html_body"), X.html_block(raw).alias("plain"))
        return let(end, lambda e: F.transform(t, lambda x, i: let(raw(x, i, e), lambda r: block(x, i, r))))

    found = let(F.filter(spans, lambda x: resource_table(x["table"])), lambda t: F.when(F.size(t) > 0, let(F.get(t, F.size(t) - 1)["start"], lambda last: cut(t, last))))
    return F.filter(found, lambda x: F.length(x["plain"]) >= least)


def technology_blocks(pages: DataFrame, key: str, html: str = "html", least: int = 20) -> DataFrame:
    """key, ord, title, html_body, plain: each resource table up to the next one; the last ends
    at a price table or the heading of another section behind it."""
    found = pages.select(key, F.col(html).alias("_html"), table_spans(F.col(html)).alias("_all"))
    return found.select(key, F.inline(blocks_of_tables(F.col("_html"), F.col("_all"), least)))


def filled_blocks(blocks: Column, short: int = 1200, enough: int = 200) -> Column:
    """An array of a document's blocks by ord, in which short ones got the description of the
    next long one; it is walked from the last to the first."""

    def step(a: Column, x: Column) -> Column:
        donor = a["donor"]
        at = F.instr(donor, "</table>")
        shared = trim(F.substr(donor, at + len("</table>")))
        gets = (F.length(x["plain"]) < short) & donor.isNotNull() & (at > 0) & (F.length(shared) >= enough)
        whole = F.when(F.coalesce(gets, F.lit(False)), F.concat(x["html_body"], shared)).otherwise(x["html_body"])
        return let(whole, lambda h: let(F.when(h == x["html_body"], x["plain"]).otherwise(X.html_block(h)), lambda p: F.struct(
            F.concat(F.array(F.struct(x["ord"].alias("ord"), x["title"].alias("title"), h.alias("html_body"), p.alias("plain"))), a["out"]).alias("out"),
            F.when(F.length(p) >= short, h).otherwise(donor).alias("donor"))))

    kind = "array<struct<ord:int,title:string,html_body:string,plain:string>>"
    return F.aggregate(F.reverse(F.array_sort(blocks)), F.struct(F.array().cast(kind).alias("out"), F.lit(None).cast("string").alias("donor")), step, lambda a: a["out"])


def donor_fill(blocks: DataFrame, key: str, short: int = 1200, enough: int = 200) -> DataFrame:
    """Blocks in which short ones got the description of the next long one.

    From the last block backwards: a block that was filled can give to those before it. A
    document's blocks are few, so they are walked through as an array."""
    rows = blocks.groupBy(key).agg(F.collect_list(F.struct("ord", "title", "html_body", "plain")).alias("b"))
    return rows.select(key, F.explode(filled_blocks(F.col("b"), short, enough)).alias("x")).select(key, "x.*")


def cut_trailing(html: Column) -> Column:
    """A block up to the heading of another section or a price table."""
    head = F.regexp_instr(html, F.lit(rf"(?iu)<(?:h[1-6]|p|strong)(?![a-z0-9])[^>]*>(?:(?!</(?:h[1-6]|p|strong)>)[\s\S])*?(?:{_STOP_WORDS})"))
    tables = F.filter(all_matches(html, [r"(?i)<table(?:\s[^>]*)?>"]), lambda t: price_table(F.substr(html, t["at"] + 1, F.lit(2000))))
    first = F.get(F.transform(tables, lambda t: t["at"]), F.lit(0))
    stop = F.least(F.when(head > 0, head - 1), first)
    return F.when(stop.isNotNull(), trim(F.left(html, stop))).otherwise(html)


def trim_at_phrase(plain: Column, phrase: str = "В изпълнение на задълженията", least: int = 200) -> Column:
    """The text up to a phrase that stands at that place or later."""
    at = F.instr(plain, phrase) - 1
    return F.when(at >= least, trim(F.left(plain, at))).otherwise(plain)


def title_place(text: Column, title: Column, start: Column) -> Column:
    """The place (from 1) of a title at or after start: as it is, else three of its first six
    words of three letters or more in a row, with up to 80 letters, such as tags, between them;
    null if neither is there."""
    words = F.slice(F.filter(F.split(title, r"\s+"), lambda w: F.length(w) > 2), 1, 6)
    gap = r"\E[\s\S]{0,80}\Q"
    three = lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat(F.lit(r"(?iu)\Q"), F.array_join(F.slice(w, i, 3), gap), F.lit(r"\E"))))
    hits = lambda rest: F.filter(F.transform(let(words, three), lambda p: F.regexp_instr(rest, p)), lambda at: at > 0)
    windows = let(F.substr(text, start), lambda rest: F.try_element_at(hits(rest), F.lit(1)))
    return let(F.call_function("locate", title, text, start), lambda at: F.when(at > 0, at).otherwise(windows + start - 1))


def title_parts(text: Column, titles: Column, least: int = 50, more: tuple[str, ...] = ()) -> Column:
    """Array of structs ord, title, body and the titles' other fields named: a text cut as
    split_by_titles() does. titles: array of structs ord, title in order."""
    walk = F.aggregate(
        titles, F.struct(F.lit(-1).alias("p"), F.array().cast("array<int>").alias("out")),
        lambda a, x: let(title_place(text, x["title"], a["p"] + 2), lambda f: let(F.coalesce(f - 1, a["p"] + 1).cast("int"), lambda p: F.struct(p.alias("p"), F.concat(a["out"], F.array(p)).alias("out")))),
        lambda a: a["out"],
    )
    body = lambda at, i: trim(F.substr(text, F.get(at, i) + 1, F.coalesce(F.get(at, i + 1), F.length(text)) - F.get(at, i)))
    parts = let(walk, lambda at: F.transform(titles, lambda x, i: F.struct(x["ord"].cast("int").alias("ord"), x["title"].alias("title"), body(at, i).alias("body"), *[x[c].alias(c) for c in more])))
    return F.filter(parts, lambda x: F.length(x["body"]) >= least)


def split_by_titles(docs: DataFrame, sections: DataFrame, key: str, text: str = "text", least: int = 50) -> DataFrame:
    """key, ord, title, body: a text cut where its titles stand, each behind the one before.

    Titles are looked for as title_place() does, so tags inside them don't matter. A title that
    isn't found there follows the one before at once; short bodies go. sections: key, ord, title."""
    lists = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("s")).withColumnRenamed(key, "_key")
    both = docs.join(lists, F.col(key) == F.col("_key"))
    return both.select(key, F.inline(title_parts(F.col(text), F.col("s"), least)))


def table_grid(tables: DataFrame, key: str, table: str = "table") -> DataFrame:
    """key, row, cells: spans are widened, short rows filled up to the widest."""
    rows = tables.select(key, F.posexplode(F.regexp_extract_all(table, F.lit(r"(?i)<tr[^>]*>[\s\S]*?</tr>"), F.lit(0))).alias("row", "tr"))
    cells = F.regexp_extract_all("tr", F.lit(r"(?i)<t[dh][^>]*>[\s\S]*?</t[dh]>"), F.lit(0))
    span = lambda c: F.greatest(F.coalesce(F.nullif(F.regexp_extract(c, r"(?i)colspan=\"?([0-9]+)", 1), F.lit("")).try_cast("int"), F.lit(1)), F.lit(1))
    wide = F.flatten(F.transform(cells, lambda c: F.concat(F.array(X.html_template(c)), F.array_repeat(F.lit(""), span(c) - 1))))
    rows = rows.withColumn("cells", wide)
    most = F.max(F.size("cells")).over(W.partitionBy(key))
    rows = rows.withColumn("_most", most)
    return rows.select(key, "row", F.concat("cells", F.array_repeat(F.lit(""), (F.col("_most") - F.size("cells")).cast("int"))).alias("cells"))


def links(pages: DataFrame, key: str, html: str = "html", prefix: str = "") -> DataFrame:
    """key, ord, url, title of links whose address begins with a prefix."""
    p = rf"href=\"({prefix}[^\"]*)\"[^>]*>\s*([^<]+)"
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(p), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(p), F.lit(2)).alias("title"))
    return pages.select(key, F.posexplode(both).alias("ord", "x")).select(key, "ord", "x.url", trim(F.col("x.title")).alias("title"))


def registry_cards(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, ord, title, status_code: cards of a registry listing, a heading and a stage code."""
    p = r"<h4[^>]*>([\s\S]*?)</h4>[\s\S]{0,2000}?<span\s+class=\"label[^\"]*\"[^>]*>([0-9]+\.[0-9]+)</span>"
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(p), F.lit(1)).alias("title"), F.regexp_extract_all(html, F.lit(p), F.lit(2)).alias("code"))
    rows = pages.select(key, F.posexplode(both).alias("ord", "x"))
    return rows.select(key, "ord", trim(F.replace(F.regexp_replace("x.title", "<[^>]+>", ""), F.lit("&nbsp;"), F.lit(""))).alias("title"), F.col("x.code").alias("status_code"))


def page_title(html: Column, before: str = "", after: str = "") -> Column:
    """The page's title without a site's prefix and suffix; null if there is none."""
    t = F.nullif(F.regexp_extract(html, r"(?i)<title>([^<]+)</title>", 1), F.lit(""))
    return trim(F.regexp_replace(F.regexp_replace(t, rf"^\Q{before}\E", ""), rf"\Q{after}\E\z", ""))


def image_key(data: Column, kind: Column) -> Column:
    """Name of an image by its bytes: 16 hex digits and the kind."""
    return F.concat(F.substring(F.sha1(data), 1, 16), F.lit("."), F.when(kind == "jpeg", "jpg").otherwise(kind))


def usable_image(data: Column, mime: Column) -> Column:
    """Whether bytes are what the type says, and no placeholder of a few pixels."""
    start = F.hex(F.substring(data, 1, 4))
    magic = F.when(mime == "image/png", start == "89504E47").when(mime == "image/jpeg", F.startswith(start, F.lit("FFD8FF"))).when(mime == "image/gif", F.startswith(start, F.lit("474946"))).otherwise(F.lit(True))
    side = lambda at: F.when(mime == "image/png", F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int"))
    w, h = side(17), side(21)
    tiny = ((w <= 20) & (h <= 20)) | ((F.octet_length(data) < 500) & (w <= 150) & (h <= 150))
    return magic & ~F.coalesce(tiny, F.lit(False))


def resolve_placeholders(pages: DataFrame, assets: DataFrame, key: str, html: str = "html", base: str = "/api/admin/offer-images/") -> DataFrame:
    """pages with OFFER_IMG:key replaced by the image's address if the image is there."""
    p = r"OFFER_IMG:([0-9a-zA-Z._-]+)"
    used = pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(p), F.lit(1)))).alias("asset"))
    known = used.join(assets.select(F.col("key").alias("asset")).distinct(), "asset").groupBy(key).agg(F.collect_set("asset").alias("_known")).withColumnRenamed(key, "_key")
    both = pages.join(known, F.col(key) == F.col("_key"), "left")
    names = F.regexp_extract_all(html, F.lit(p), F.lit(1))
    new = F.transform(names, lambda n: F.when(F.array_contains(F.coalesce("_known", F.array().cast("array<string>")), n), F.concat(F.lit(base), n)).otherwise(F.concat(F.lit("OFFER_IMG:"), n)))
    text = F.array_join(F.flatten(F.zip_with(F.split(html, p, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return both.withColumn(html, text).select(*pages.columns)


def extract_data_uris(pages: DataFrame, key: str, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """pages with markers instead of data: addresses, and key, ord, mime, data of these."""
    p = r"data:([a-z]+/[a-z0-9.+-]+);base64,([A-Za-z0-9+/=]+)"
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(p), F.lit(1)).alias("mime"), F.regexp_extract_all(html, F.lit(p), F.lit(2)).alias("data"))
    side = pages.select(key, F.posexplode(both).alias("ord", "x")).select(key, "ord", "x.mime", F.try_to_binary("x.data", F.lit("base64")).alias("data"))
    pieces = F.split(html, p, -1)
    marked = F.array_join(F.flatten(F.transform(pieces, lambda s, i: F.when(i == 0, F.array(s)).otherwise(F.array(F.concat(F.lit("DATA_URI:"), (i - 1).cast("string")), s)))), "")
    return pages.withColumn(html, marked), side


def merge_icons(parts: DataFrame, key: str) -> DataFrame:
    """key, pos, icons, text: paragraphs of images alone go to the next one with text.

    parts: key, pos, raw, text."""
    rows = parts.withColumn("_img", (F.col("text") == "") & F.col("raw").rlike("(?i)<img"))
    later = F.count(F.when(~F.col("_img"), 1)).over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_g", F.coalesce(later, F.lit(0)))
    images = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_img"), F.struct("pos", "raw")))), lambda x: x["raw"]), "")
    return rows.groupBy(key, "_g").agg(F.max("pos").alias("pos"), images.alias("icons"), F.coalesce(F.max(F.when(~F.col("_img"), F.col("text"))), F.lit("")).alias("text")).drop("_g")


def append_citations(text: Column, sources: Column) -> Column:
    """Numbered parts of a text, each with the files that it comes from; text before the first
    number is dropped. sources: map from the number (1 to 3) to an array of names."""
    parts = F.filter(F.split(trim(text), r"(?:^|\n\n)(?=[1-3]\. )"), lambda p: p.rlike(r"^\s*[1-3]\. "))

    def one(p: Column) -> Column:
        names = F.coalesce(F.try_element_at(sources, F.regexp_extract(p, r"([1-3])\. ", 1).cast("int")), F.array().cast("array<string>"))
        own = F.regexp_replace(trim(p), r"\s+\z", "")
        return F.when(F.size(names) > 0, F.concat(own, F.lit("\n[извлечено от "), F.array_join(names, ", "), F.lit("]"))).otherwise(own)

    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, one), "\n\n")).otherwise(trim(text))


def split_position_blocks(text: Column) -> Column:
    """Array of parts of a text, cut at long rules and at ---."""
    return F.filter(F.transform(F.split(text, r"─{10,}|\n---\n"), trim), lambda p: p != "")


def report_lines(tenders: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """key, ord, level, text: a report's headings and paragraphs; chapters that have nothing are
    left out and the rest numbered from 1.

    tenders: key, introduction, team, communication; results: key, ord, title, text."""
    has = lambda c: F.coalesce(trim(F.col(c)) != "", F.lit(False))
    some = results.select(key).distinct().withColumn("_some", F.lit(True)).withColumnRenamed(key, "_key")
    t = tenders.join(some, F.col(key) == F.col("_key"), "left").withColumn("_some", F.coalesce("_some", F.lit(False)))
    n, chapters = F.lit(1), []
    for place, (name, title, there) in enumerate((("introduction", "Въведение", has("introduction")), (None, "Технология на изпълнение", F.col("_some")), ("team", "Организация на екипа", has("team")), ("communication", "Комуникация", has("communication")))):
        head = F.struct(F.lit(place).alias("place"), F.lit(0).alias("ord"), F.lit(1).alias("level"), F.concat(n.cast("string"), F.lit(". "), F.lit(title)).alias("text"))
        rows = F.array(head) if name is None else F.array(head, F.struct(F.lit(place).alias("place"), F.lit(1).alias("ord"), F.lit(0).alias("level"), trim(F.col(name)).alias("text")))
        chapters.append(F.when(there, rows).otherwise(F.array().cast("array<struct<place:int,ord:int,level:int,text:string>>")))
        n = n + there.cast("int")
    fixed = t.select(key, F.inline(F.concat(*chapters)))
    found = results.select(key, F.lit(1).alias("place"), F.explode(F.array(F.struct((F.col("ord") * 2 + 1).alias("ord"), F.lit(2).alias("level"), F.col("title").alias("text")), F.struct((F.col("ord") * 2 + 2).alias("ord"), F.lit(0).alias("level"), F.col("text").alias("text")))).alias("x")).select(key, "place", F.col("x.ord").cast("int").alias("ord"), "x.level", "x.text")
    both = fixed.unionByName(found)
    return both.select(key, F.row_number().over(W.partitionBy(key).orderBy("place", "ord")).alias("ord"), "level", "text")
