"""Citations of standards and regulations: extraction, registry lookups, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..functions.chains import trim
from ..functions.places import all_matches
from ..sources.tables import settled, sorted_join
from .library import ttl_split, upsert_latest
from .lines import let
from .terms import apart, standing

# How standards and regulations are cited; the order decides which form stays.
_NUMBER = r"[0-9][0-9\-.:/A-Za-z]*"
STANDARDS = [
    rf"(?iu)БДС\s+E[NН]\s+ISO\s+{_NUMBER}", rf"(?iu)БДС\s+E[NН]\s+{_NUMBER}", rf"(?iu)БДС\s+ISO\s+{_NUMBER}", rf"(?iu)БДС\s+{_NUMBER}",
    rf"(?iu)(?<![А-Яа-яA-Za-z])EN\s+{_NUMBER}", rf"(?iu)(?<![А-Яа-яA-Za-z])ISO\s+{_NUMBER}",
]
_DAY = r"[0-9]{1,2}[.\s][0-9]{1,2}[.\s][0-9]{4}\s*г\.?"
REGULATIONS = [
    rf"[Нн][Аа][Рр][Ее][Дд][Бб][Аа]\s*(?:№|No\.?)\s*[А-Яа-яA-Za-z\-]*[0-9][0-9A-Za-z_\-]*\s+[Оо][Тт]\s+{_DAY}",
    rf"[Нн][Аа][Рр][Ее][Дд][Бб][Аа]\s+[А-Яа-яA-Za-z]+-[0-9][0-9A-Za-z_\-]*\s+[Оо][Тт]\s+{_DAY}",
]
#: Where each of them may begin; the first letter stands in all its forms, as a class of letters
#: is looked for faster than one whose case doesn't matter.
BEGINS = [r"[Бб](?i:ДС)\s"] * 4 + [r"[Ee](?i:N)\s", r"[Iiıİ](?i:SO)\s"] + [r"[Нн](?i:аредба)"] * 2
_CUT = r"\s+(?:БДС(?=[A-Za-z0-9_])|EN\s+[0-9]|ISO\s+[0-9]|Наредба\s).*"


def _capped(title: Column) -> Column:
    cut = lambda t: F.when(F.length(t) > 200, trim(F.regexp_replace(F.left(t, F.lit(200)), r"\s+\S*\z", ""))).otherwise(t)
    plain = let(title, lambda t: trim(F.regexp_replace(cut(t), r"[.,;]+\z", "")))
    return let(plain, lambda v: F.when(F.size(F.split(v, r"\s+")) >= 2, v))


def title_after(tail: Column) -> Column:
    """The title behind a citation: after a dash, from a capital, up to what isn't title."""
    rest = F.regexp_extract(tail, r"^(?::[0-9]{4}(?:/[A-Z0-9:]++)*+)?+\s*+(?:–|—|-{1,2})\s*([А-ЯA-Z][^\n]{14,249})", 1)

    def shown(line: Column) -> Column:
        t = trim(F.regexp_replace(F.regexp_replace(line, _CUT, ""), r"(?iu),\s+(?:как|а\s|но\s|или\s|при\s|тъй|поради|освен|вкл|т\.|и\s+т\.).*", ""))
        return let(t, lambda whole: let(F.split(whole, r"\.\s+(?=[А-ЯA-Z])"), lambda parts: sentences(whole, parts)))

    def sentences(whole: Column, parts: Column) -> Column:
        few = F.array_join(F.slice(parts, 1, F.when(F.length(F.get(parts, F.lit(2))) <= 40, 3).otherwise(2)), ". ")
        return F.when(F.size(parts) >= 3, few).otherwise(whole)

    return let(rest, lambda line: F.when(line != "", _capped(shown(line))))


def title_before(head: Column) -> Column:
    """The title in front of a citation: the last block before a dash, from a capital."""
    # most have no dash at their end, which is seen without a walk through them
    end = F.right(F.rtrim(head, F.lit(" \t\n\x0b\f\r")), F.lit(1))
    cand = F.when(end.isin("–", "—", "-"), trim(F.regexp_extract(head, r"^([\s\S]*?)(?:–|—|-{1,2})\s*\z", 1)))

    def from_block(block: Column) -> Column:
        return F.when((F.length(block) >= 15) & block.rlike("^[А-ЯA-Z]"), _capped(trim(F.regexp_replace(block, _CUT, ""))))

    return let(cand, lambda c: F.when(F.length(c) >= 15, let(trim(F.element_at(F.split(c, r"[\n;]", -1), -1)), from_block)))


def inline_description(tail: Column) -> Column:
    d = F.regexp_extract(F.left(tail, F.lit(120)), r"^(?::[0-9]{4}(?:/[A-Z0-9:]++)*+)?+\s*(?:за|–|-|—|:)\s+([^,.\n;(]{5,80})", 1)
    cut = lambda d: trim(F.regexp_replace(d, r"\s*(?:БДС(?=[A-Za-z0-9_])|(?:EN|ISO)(?![A-Za-z0-9_])|Наредба(?=[A-Za-z0-9_])).*", ""))
    return let(d, lambda d: F.when(d != "", F.nullif(cut(d), F.lit(""))))


def extract_references(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pattern, pos, raw, normalized, ref_type, search_term, extracted_title,
    inline_description: each citation once, in the first form by pattern and place.

    A standard with and without its national prefix is one. Texts are read as they are
    without tags; nulls have no citations. Each row is read by itself, and nothing is shuffled:
    places come first, then names, of equal names the first, and only around these up to 350
    letters before and 300 behind are looked at for titles."""
    # most texts cite nothing: one cheap look spares them the patterns
    found = docs.filter(F.col(text).rlike(r"(?iu)БДС|EN|ISO|наредба")).select(key, X.html_inline(F.col(text)).alias("_t"))
    found = found.withColumn("_m", all_matches(F.col("_t"), STANDARDS + REGULATIONS, BEGINS))
    is_standard = lambda x: x["pattern"] < len(STANDARDS)
    # a standard without its prefix, then its forms in order
    form = lambda x, v: F.struct(F.when(is_standard(x), F.regexp_replace(v, r"^БДС\s+", "")).otherwise(v).alias("k"), x["pattern"].alias("pattern"), x["at"].alias("at"), x["raw"].alias("raw"), v.alias("normalized"))
    named = F.transform("_m", lambda x: let(F.when(is_standard(x), X.standard_name(trim(x["raw"]))).otherwise(X.regulation_name(trim(x["raw"]))), lambda v: form(x, v)))
    named = F.filter(named, lambda x: ~(is_standard(x) & F.endswith(x["normalized"], F.lit("-"))))
    found = found.withColumn("_n", F.sort_array(named)).withColumn("_n", F.filter("_n", lambda x, i: (i == 0) | (F.get("_n", i - 1)["k"] != x["k"])))
    t = F.col("_t")
    around = F.transform("_n", lambda x: F.struct(x["pattern"].alias("pattern"), x["at"].alias("pos"), trim(x["raw"]).alias("raw"), x["normalized"].alias("normalized"), F.right(F.left(t, x["at"]), F.lit(350)).alias("before"), F.substr(t, x["at"] + F.length(x["raw"]) + 1, F.lit(300)).alias("after")))
    rows = found.select(key, F.inline(around))
    standard = F.col("pattern") < len(STANDARDS)
    rows = rows.withColumn("extracted_title", F.when(standard, F.coalesce(title_after(F.col("after")), title_before(F.col("before")))))
    return rows.select(key, "pattern", "pos", "raw", "normalized", F.when(standard, "standard").otherwise("regulation").alias("ref_type"), F.when(standard, X.search_term(F.col("normalized"))).otherwise(F.col("raw")).alias("search_term"), "extracted_title", F.when(F.col("extracted_title").isNull(), inline_description(F.col("after"))).alias("inline_description"))


def distinct_references(refs: DataFrame, order: list[str]) -> DataFrame:
    """Each normalized name once over all documents, in the order in which it is first seen."""
    rest = [c for c in refs.columns if c != "normalized"]
    return refs.groupBy("normalized").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("normalized", "r.*")


# Stage codes of a standards registry.
STAGES = {"10.99": "valid", "20.00": "valid", "40.60": "valid", "60.60": "valid", "90.20": "under_review", "90.60": "under_review", "90.92": "replaced", "90.93": "valid", "95.99": "withdrawn"}
PUBLISHED, DRAFTS = ("60.60", "90.93"), ("10.99", "20.00", "40.60")


def stage_status(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit("unknown"))


def _cards_of(terms: DataFrame, registry: DataFrame) -> DataFrame:
    """The cards with each term that stands alone in their title: no digit around it, nor a digit
    and a space or dash before it.

    There are no more rows than matches, whatever number many cards share. Terms without a
    digit match nothing."""
    return standing(registry, "title", terms.filter(F.col("search_term").rlike("[0-9]")), "search_term", apart)


def registry_match(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """search_term and the first card (by ord) that has it: title, status_code, status.

    registry: ord, title, status_code."""
    hits = _cards_of(refs, registry)
    best = hits.groupBy("search_term").agg(F.min_by(F.struct("title", "status_code"), F.struct("ord", "title")).alias("c"))
    return best.select("search_term", "c.title", "c.status_code", stage_status(F.col("c.status_code")).alias("status"))


def registry_successor(matched: DataFrame, registry: DataFrame) -> DataFrame:
    """matched with replaced_by and draft_version: of other cards of the same number the first
    published and the first draft, annexes left out; for replaced standards only."""
    matched = settled(matched)  # found once, as it is looked at several times
    old = matched.filter("status = 'replaced'").select("search_term", F.col("title").alias("_old"))
    rest = sorted_join(_cards_of(old, registry), old, "search_term").filter((F.col("title") != F.col("_old")) & ~F.contains("title", F.lit("/NA:")))
    published = F.col("status_code").isin(*PUBLISHED)
    draft = ~published & (F.col("status_code").isin(*DRAFTS) | F.startswith("title", F.lit("pr")))
    found = rest.groupBy("search_term").agg(F.min_by(F.when(published, F.col("title")), F.when(published, F.col("ord"))).alias("replaced_by"), F.min_by(F.when(draft, F.col("title")), F.when(draft, F.col("ord"))).alias("draft_version"))
    return sorted_join(matched, found, "search_term", "left")


def regulation_match(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """normalized and the first regulation (by ord) of its number, month and year: title, url.

    listing: ord, title, url. Amendments of other regulations don't count."""
    # found once, as it is looked at several times
    r = settled(refs.select("normalized", X.regulation_parts(F.col("normalized")).alias("p")).select("normalized", "p.id", F.col("p.year").alias("year"), F.upper(X.month_name(F.col("p.month"))).alias("month")).distinct())
    t = listing.withColumn("_u", F.upper("title"))
    t = t.filter(~(F.col("_u").rlike("ИЗМЕНЕНИЕ|ДОПЪЛНЕНИЕ") & F.col("_u").rlike(r"НА\s+НАРЕДБА")))
    t = t.withColumn("year", F.explode(F.array_distinct(F.regexp_extract_all("_u", F.lit("[0-9]{4}"), F.lit(0)))))
    months = F.array(*[F.lit(m.upper()) for m in X.MONTHS])
    t = t.withColumn("month", F.explode(F.concat(F.array(F.lit("")), F.filter(months, lambda m: F.contains(F.col("_u"), m)))))
    # only months and years that are cited
    t = t.join(F.broadcast(r.select("year", "month").distinct()), ["year", "month"], "left_semi").select("_u", "year", "month", "ord", "title", "url")
    # a number is a key of its own; names with letters are looked for by an automaton
    numeric = F.col("id").rlike(r"^[0-9]+\z")
    numbered = t.select("year", "month", "ord", "title", "url", F.explode(F.array_distinct(F.regexp_extract_all("_u", F.lit(r"№\s*([0-9]+)(?=\s|,|\z)"), F.lit(1)))).alias("id"))
    hits = sorted_join(r.filter(numeric), numbered, ["year", "month", "id"]).select("normalized", "ord", "title", "url")
    others = r.filter(~numeric).withColumn("id", F.upper("id"))
    named = sorted_join(standing(t, "_u", others, "id", keys=["year", "month"]), others, ["year", "month", "id"]).select("normalized", "ord", "title", "url")
    best = hits.unionByName(named).groupBy("normalized").agg(F.min(F.struct("ord", "url", "title")).alias("m"))
    return best.select("normalized", "m.title", "m.url")


# Statuses from the most urgent on.
URGENT = ("withdrawn", "replaced", "under_review", "unknown", "valid")


def by_urgency(results: DataFrame, status: str, reference: str, language: str = "bg") -> DataFrame:
    """results with urgency (1 for the most urgent status; unknown ones last) and place, the rank of
    the reference within it in the language's own order, sorted by both.

    Places come from the distinct references of a status alone, in ranges of their order: a
    range is ranked by itself and the sizes of those before it are added, so nothing is sorted
    in one task."""
    at = F.array_position(F.array(*map(F.lit, URGENT)), F.col(status))
    rows = results.withColumn("urgency", F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(len(URGENT) + 1).cast("long"))
    named = rows.groupBy("urgency", reference).agg(F.count("*").alias("_n")).withColumn("_c", F.collate(reference, language))
    # an order that equal keys of the collation keep together
    dealt = settled(named.repartitionByRange("urgency", "_c").sortWithinPartitions("urgency", "_c").withColumn("_part", F.spark_partition_id()).drop("_c")).withColumn("_c", F.collate(reference, language))
    before = dealt.groupBy("urgency", "_part").agg(F.sum("_n").alias("_size"))
    before = before.withColumn("_before", F.coalesce(F.sum("_size").over(W.partitionBy("urgency").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    peers = W.partitionBy("urgency", "_part").orderBy("_c")
    inner = F.coalesce(F.sum("_n").over(peers.rangeBetween(W.unboundedPreceding, W.currentRow)), F.lit(0)) - F.sum("_n").over(W.partitionBy("urgency", "_part", "_c"))
    placed = dealt.withColumn("_inner", inner).join(before, ["urgency", "_part"]).select(F.col("urgency").alias("_u"), F.col(reference).alias("_r"), (F.col("_before") + F.col("_inner") + 1).cast("long").alias("place"))
    out = rows.join(placed, (F.col("urgency") == F.col("_u")) & F.col(reference).eqNullSafe(F.col("_r"))).drop("_u", "_r")
    return out.orderBy("urgency", "place")


def publication_status(page: Column) -> Column:
    """withdrawn if the publication block says that all of it is repealed, else valid."""
    plain = F.regexp_replace(F.regexp_replace(page, "<[^>]+>", " "), "(?i)&nbsp;", " ")
    at = F.instr(plain, "Обн. ДВ.")
    block = F.when(at > 0, F.substr(plain, at, F.lit(1000)))
    return F.when(F.coalesce(block.rlike(r"(?iu)отм\.\s*ДВ\."), F.lit(False)), "withdrawn").otherwise("valid")


def validate(refs: DataFrame, cache: DataFrame, registry: DataFrame, listing: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """reference, ref_type, status, current_title, title_mismatch, replaced_by, draft_version,
    cached: the cached answer where it is fresh, else what registry and listing say."""
    split = ttl_split(refs.withColumnRenamed("normalized", "reference"), cache.withColumnRenamed("reference_key", "reference"), "reference", now, hours)
    # met with the cache once, as they are looked at several times
    split = settled(split.select("reference", "ref_type", "search_term", "extracted_title", "inline_description", "status", "state"))
    fresh, check = split.filter("state = 'fresh'"), split.filter("state = 'check'").drop("status")
    cards = registry_successor(registry_match(check.filter("ref_type = 'standard'"), registry), registry)
    cited = F.coalesce("extracted_title", "inline_description")
    standards = sorted_join(check.filter("ref_type = 'standard'"), cards, "search_term", "left")
    standards = standards.select("reference", "ref_type", F.coalesce("status", F.lit("unknown")).alias("status"), F.col("title").alias("current_title"), X.title_mismatch(cited, F.col("title")).alias("title_mismatch"), "replaced_by", "draft_version", F.lit(False).alias("cached"))
    named = regulation_match(check.filter("ref_type = 'regulation'").withColumnRenamed("reference", "normalized"), listing)
    rules = sorted_join(check.filter("ref_type = 'regulation'"), named, F.col("reference") == F.col("normalized"), "left")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rules = rules.select("reference", "ref_type", F.when(F.col("url").isNotNull(), "valid").otherwise("unknown").alias("status"), F.col("title").alias("current_title"), none("boolean", "title_mismatch"), none("string", "replaced_by"), none("string", "draft_version"), F.lit(False).alias("cached"))
    kept = fresh.select("reference", "ref_type", "status", none("string", "current_title"), none("boolean", "title_mismatch"), none("string", "replaced_by"), none("string", "draft_version"), F.lit(True).alias("cached"))
    return standards.unionByName(rules).unionByName(kept)


def save_cache(cache: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The cache after new results, which win over older ones."""
    new = results.filter("not cached").select(F.col("reference").alias("reference_key"), "status", now.cast("timestamp").alias("checked_at"))
    return upsert_latest(cache.select("reference_key", "status", F.col("checked_at").cast("timestamp").alias("checked_at")), new, ["reference_key"], ["checked_at"])
