"""The training-data operators against brute force, round trips and held-out labels, and on
nulls, empty tables, repeated rows and clashing names."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
import xxhash
from conftest import rows_of
from pyspark.sql import functions as F

from docquarry.llm import common, decontaminate, embedding_dedup, graph, minhash_dedup, mixing, pii, queries, sharding, token_counts, token_output, tokenizing, toxicity, warc

ODD = [(1, "един два три четири пет шест"), (1, "един два три четири пет шест"), (2, None), (3, ""), (None, "един два три четири пет шест седем"), (4, "word " * 60_000), (5, " \t\n")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, repeated rows, and names that operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in ODD], "doc_id long, text string, shard string, bucket int, node string").withColumn("source", F.when(F.col("doc_id") == 3, None).otherwise("s"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_twin(spark, duck, data, name):
    got, want = queries.queries()[name](spark, data).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want)


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, -5, 2**62, *range(100, 900)], np.int64)
    assert sharding.jump(keys, 8).tolist() == [jump(int(k), 8) for k in keys]
    a, b = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert ((a == b) | (b == 8)).all() and (b == 8).any()


def test_shards(spark, odd):
    got = sharding.shard_table(odd, 8).toPandas()
    assert len(got) == len(ODD)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    null = got[got.doc_id == 2].iloc[0]
    assert (null["size"], null["text_crc32"]) == (1, 0)
    assert sharding.shard_table(odd.limit(0), 8).count() == 0


def test_shards_as_brute_force(spark, data):
    texts = {r.doc_id: r.text for r in common.table(spark, data, "documents").select("doc_id", "text").collect()}
    got = queries.op4_sharding(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "key", jump(r.doc_id, 8), jump(r.doc_id, 9))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("text", ["it's I'LL. A.B, x..y <|endoftext|>. <|ENDOFTEXT|>", "é́ ́x ,", "ΣΑΣ. İ ŉ", "a b\x1cd\x85e\x0bf", "½ 12,3. ⅷ, ǅ.", "日本語。테스트,", "​. ﬁ, ß", ""])
def test_words_give_the_tokenizer_s_ids(text):
    from tokenizers import Tokenizer

    path = tokenizing.tokenizer_path()
    e = tokenizing.WordEncoder(path, most_words=3)
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert list(e.encode_batch([text, None])) == [e.encode(text), b""]


def tokenized(text):
    """The ids that the tokenizer itself gives."""
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


TOKENIZER = __import__("tokenizers").Tokenizer.from_file(tokenizing.tokenizer_path())


@pytest.mark.parametrize("most", [450_000, 400])
def test_whole_texts_give_the_tokenizer_s_ids(most):
    """Also while words leave the memory all the time."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    if most < 1000:
        texts = texts[::20]
    e = tokenizing.WordEncoder(tokenizing.tokenizer_path(), most_words=most)
    for text, ids in zip(texts, e.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, e.dtype).tolist() == tokenized(text)


def test_token_output(spark, odd, data):
    for docs in (odd, common.table(spark, data, "documents")):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: r[:2])
        got = token_output.token_output(docs, shard_ids=3000, partitions=3).orderBy("start").collect()
        assert len(got) == len(rows)
        at, want = 0, Counter()
        for g, (has, key, _) in zip(got, rows, strict=True):
            assert (g.doc_id, g.start) == (key if has else None, at)
            at += g.n_tokens
        for has, key, text in rows:
            ids = [*tokenized(text), 2]
            want[(key if has else None, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        assert want == Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    h = token_output.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    data = token_output.pack_shard(0, 0, [None, 3, 3, 7], [b"\1\0\2\0", b"\3\0", b"\4\0", b"\5\0"], 2)
    shard = token_output.Shard(data)
    assert shard.get(3).tolist() == [3] and shard.get(7).tolist() == [5] and shard.get(8) is None


def test_token_counts(spark, odd, data):
    for docs in (odd, common.table(spark, data, "documents")):
        lengths = [len(tokenized(r.text)) for r in docs.select("text").collect()]
        hist = token_counts.length_histogram(docs).cache()
        assert {r.length: r.documents for r in hist.collect()} == Counter(lengths)
        for r in hist.collect():
            assert r.truncated == sum(min(n, r.length) for n in lengths)
            assert (r.documents_from, r.tokens_from) == (sum(n >= r.length for n in lengths), sum(n for n in lengths if n >= r.length))
        for limit in (0, 5, 100, 10**6):
            assert token_counts.truncated_total(hist, limit).first().kept == sum(min(n, limit) for n in lengths)
        assert token_counts.quantile(hist, 0.5).first().length == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert token_counts.length_histogram(docs.limit(0)).count() == 0


def test_warc_segments(spark, tmp_path):
    pages = [(1, "u", "x" * 100), (2, None, "x" * 100), (3, "u\nv", "y" * 90_000), (4, "u", None), (5, "u", "x" * 99), (6, "u", "x" * 99), (None, "u", "x" * 100), (3, "u", "y" * 90_000), (7, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\n" * 9)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    warc.write_warc(df, str(tmp_path / "w"), segment=1000, file_records=7)
    assert warc.read_records(spark, str(tmp_path / "w")).filter("record_type = 'continuation'").count() > 150
    got = warc.with_payload(warc.read_warc(spark, str(tmp_path / "w"))).collect()
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in got) == Counter((p, h or "") for p, _, h in pages)
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(2, 1)}
    out = warc.page_digests(df).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in out) == Counter((p, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in pages)
    assert warc.page_digests(df.limit(0)).count() == 0


def test_warc_files_are_members_of_one_record(spark, tmp_path):
    import gzip

    rows = [(i, None if i == 4 else f"http://x/{i}", None if i == 5 else f"страница {i} " * 400) for i in range(30)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), segment=3000, file_records=9, date="2024-05-01T00:00:00Z")
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 4
    n = 0
    for f in files:
        data, at = f.read_bytes(), 0
        while at < len(data):
            d = zlib.decompressobj(31)
            member = d.decompress(data[at:])
            at = len(data) - len(d.unused_data)
            if member:  # but for the empty one at the end
                (fields, _), = warc.records(member)
                assert member.endswith(b"\r\n\r\n") and fields["warc-date"] == "2024-05-01T00:00:00Z"
                n += 1
            else:
                assert at == len(data)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert n == warc.read_records(spark, str(tmp_path / "w")).count() > 60


def test_warc_framing():
    assert warc.unchunked(b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\nT: 1\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        warc.unchunked(b"9\r\nabc\r\n0\r\n\r\n")


def test_lost_segment_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "y" * 5000)], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"), segment=1000)
    rows = warc.read_records(spark, str(tmp_path / "w")).filter("segment is null or segment <> 2")
    with pytest.raises(Exception, match="segments don't make up"):
        warc.reassemble(rows).collect()


def test_pseudonyms(spark):
    text = "card 4111111111111111 and 4111-1111-1111-1111, 10.0.0.255 / 300.1.1.1 +1 (555) 123-4567 on 2024-02-29, 1.2.2020, 31/12/1999; 4111111111111112 2024-13-45"
    docs = spark.createDataFrame([(1, text), (2, "again 4111111111111111"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    pairs = {v.value: v.pseudonym for v in got[1]["values"]}
    luhn = lambda s: sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10
    card = pairs["4111111111111111"]
    assert card != "4111111111111111" and luhn(card) == 0 and len(card) == 16
    assert pairs["4111-1111-1111-1111"].replace("-", "") == card and card in got[2].text
    for same in ("4111111111111112", "300.1.1.1", "2024-13-45"):
        assert pairs[same] == same and same in got[1].text
    assert date.fromisoformat(pairs["2024-02-29"]) != date(2024, 2, 29) and all(int(p) < 256 for p in pairs["10.0.0.255"].split("."))
    assert got[3].text is None and got[4].text == "" and "4111111111111111" not in got[1].text
    back = text
    for v in got[1]["values"]:
        back = back.replace(v.value, v.pseudonym, 1)
    assert back == got[1].text
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


def test_pseudonyms_of_adjacent_numbers(spark):
    card, spaced, phone, ip = "4111111111111111", "4111 1111 1111 1111", "+1 (826) 555-4081", "190.137.223.204"
    texts = {
        f"card {card} 123": [card], f"{card} 10.0.0.1": [card, "10.0.0.1"], f"no 7 {card}": [card], f"12 {spaced} 123-4": [spaced],
        f"{phone} {ip}": [phone, ip], f"{phone} 2024-02-29": [phone, "2024-02-29"], f"{phone} 31/12/1999 5": [phone, "31/12/1999"], f"{phone} {spaced}": [phone, spaced], f"{phone} {card}": [phone, card],
        f"{card} {card}-{spaced}": [card, card, spaced], "5 4222222222222 9 378282246310005 77": ["4222222222222", "378282246310005"], "3782 822463 10005 1": ["3782 822463 10005"],
        "+33 1.23.45.67.89": ["+33 1.23.45.67.89"], "+33 1 23 45 67 89 12": ["+33 1 23 45 67 89"], "+359 88 123 4567 2": ["+359 88 123 4567"],
        f"{phone} 12": [phone], f"{phone} 7 items": [phone], f"{phone} 555 6": [phone], f"{phone}-12": [phone], f"{phone}": [phone], "+49 30 1234567 12": ["+49 30 1234567"], "+49 30 1234567": ["+49 30 1234567"],
    }
    docs = spark.createDataFrame(list(texts), "string").toDF("text").withColumn("old", F.col("text"))
    seen = {}
    for r in pii.pseudonymise(docs, "k").collect():
        changed = [v for v in r["values"] if v.value != v.pseudonym]
        assert [v.value for v in changed] == texts[r.old]
        back = r.old
        for v in changed:
            assert seen.setdefault(v.value, v.pseudonym) == v.pseudonym
            back = back.replace(v.value, "#", 1)
        new = r.text
        for v in changed:
            new = new.replace(v.pseudonym, "#", 1)
        assert back == new


def feistel(x, a, b, tweak, key="k"):
    left, right = divmod(x, b)
    for i in range(pii.ROUNDS):
        draw = int(hashlib.sha256(f"{key}|{tweak}|{a}|{b}|{i}|{right if i % 2 == 0 else left}".encode()).hexdigest()[:15], 16)
        left, right = ((left + draw) % a, right) if i % 2 == 0 else (left, (right + draw) % b)
    return left * b + right


def sealed_digits(d, tweak):
    return str(feistel(int(d), 10 ** (len(d) // 2), 10 ** (len(d) - len(d) // 2), tweak)).zfill(len(d))


def sealed_day(day, tweak="date", ok=lambda d: True):
    first, n = date(1900, 1, 1), (day - date(1900, 1, 1)).days
    while True:
        n = feistel(n, 270, 271, tweak)
        if n < 73049 and ok(first + timedelta(days=n)):
            return first + timedelta(days=n)


def pseudonym(value):
    """The pseudonym of a sound value, in plain Python."""
    if value.startswith("+") or value.replace(" ", "").replace("-", "").isdigit() and value.count("-") != 2:
        d = "".join(c for c in value if c.isdigit())
        if value.startswith("+"):
            new = d[0] + sealed_digits(d[1:], "phone")
        else:
            new = d[0] + sealed_digits(d[1:-1], "card")
            new += str(-sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(new))) % 10)
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in value)
    if value.count(".") == 3:
        n = feistel(int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 16, 1 << 16, "address")
        return ".".join(map(str, n.to_bytes(4, "big")))
    mark = next(c for c in value if c in "-./")
    parts = value.split(mark)
    y, m, d = parts if mark == "-" else parts[::-1]
    american = mark == "/" and int(m) > 12
    if american:
        m, d = d, m
    new = sealed_day(date(int(y), int(m), int(d)), *(("late date", lambda x: x.day > 12) if american else ()))
    wide = 2 if min(len(m), len(d)) == 2 else 1
    m, d = str(new.month).zfill(wide), str(new.day).zfill(wide)
    return mark.join((str(new.year), m, d) if mark == "-" else (m, d, str(new.year)) if american else (d, m, str(new.year)))


def test_pseudonyms_as_brute_force(spark):
    values = ["4111111111111111", "4111-1111-1111-1111", "4222222222222", "3782 822463 10005", "6304000000000000000", "10.0.0.255", "0.0.0.0", "255.255.255.255", "+1 (555) 123-4567", "+359 88 123 4567", "+12345678"]
    values += ["2024-02-29", "2024-2-9", "1.2.2020", "01.02.2020", "31.12.2099", "31/12/1999", "1/2/1999", "12/31/1999", "2/13/2000", "02/13/2000"]
    rng = np.random.default_rng(8)
    values += [(date(1900, 1, 1) + timedelta(days=int(n))).strftime(f) for n, f in zip(rng.integers(0, 73049, 60), ["%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y"] * 20)]
    values += [".".join(map(str, rng.integers(0, 256, 4))) for _ in range(40)]
    docs = spark.createDataFrame([(f"x {v} y",) for v in values], "text string")
    got = [(r.text, [tuple(v) for v in r["values"]]) for r in pii.pseudonymise(docs, "k").collect()]
    for v, (text, found) in zip(values, got, strict=True):
        assert text == f"x {pseudonym(v)} y" and [x[0] for x in found] == [v] and found[0][2] == pseudonym(v)


def test_pseudonyms_of_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([("a", 1, "on 2024-02-29", "k", 5)] * 2, "values string, found int, text string, pii_key string, _values int")
    out = pii.pseudonymise(docs, "secret-of-the-run")
    assert out.columns == ["values", "found", "text", "pii_key", "_values", "__values"] and len(set(map(str, out.collect()))) == 1
    assert "secret-of-the-run" not in out._jdf.queryExecution().toString()


def test_pseudonyms_are_permutations(spark):
    days = [(date(1900, 1, 1) + timedelta(days=i)).isoformat() for i in range(0, pii.DAYS, 29)]
    docs = spark.createDataFrame([(d,) for d in days], "text string")
    got = [r.text for r in pii.pseudonymise(docs, "k").collect()]
    assert len(set(got)) == len(days) and all("1900" <= g < "2100" for g in got)
    body = spark.range(3000).select(F.concat(F.lit("+1"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("text"))
    assert pii.pseudonymise(body, "k").select("text").distinct().count() == 3000


def mixed(rows, t, budget=None, seed=0, block_rows=256):
    """What the mix takes of rows (doc_id, source, text), one row after the other."""
    by = defaultdict(list)
    for k, s, x in rows:
        by["" if s is None else f"={s}"].append((spark_hash32(seed, k, x), k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))))
    total = {s: sum(r[3] for r in v) for s, v in by.items()}
    every = sum(total.values())
    w = {s: (n / every) ** t for s, n in total.items() if n}
    whole = max((total[s] / w[s] for s in w), default=0) * sum(w.values()) if budget is None else budget
    out = []
    for s, v in by.items():
        spend = round(w[s] / sum(w.values()) * whole) if s in w else 0
        passes, rest = divmod(spend, total[s]) if s in w else (1, 0)
        blocks = defaultdict(list)
        for r in v:
            blocks[r[0] % max(1, -(-len(v) // block_rows))].append(r)
        for p in range(1, passes + 1 + (rest > 0)):
            spent = 0
            for at, b in enumerate(sorted(blocks, key=lambda b: (spark_hash32(seed, s, p, b), b))):
                for place, r in enumerate(sorted(blocks[b], key=lambda r: (spark_hash32(seed, p, r[0]), r[0]))):
                    if p <= passes or spent < rest:
                        out.append((r[1], p, at, place, r[3]))
                    spent += r[3]
    return Counter(out)


def spark_hash32(seed, *values):
    """As spark_hash(), with an int before the values."""
    first = xxhash.xxh64_intdigest(int(seed).to_bytes(4, "little", signed=True), 42)
    for v in values:
        if v is not None:
            first = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), first)
    return first - (1 << 64) if first >> 63 else first


def test_mixture_as_brute_force(spark, odd, data):
    docs = common.table(spark, data, "documents").select("doc_id", "source", "text")
    docs = docs.union(spark.createDataFrame([(None, "web", "no key"), (None, None, None), (7, None, "a b"), (8, "none", "")], docs.schema))
    rows = [tuple(r) for r in docs.collect()]
    total = Counter()
    for _, s, x in rows:
        total[s] += len((x or "").encode().split())
    shares = [n / sum(total.values()) for n in total.values() if n]
    for most, budget in ((2.0, None), (1.3, 20_000), (3.0, 500_000)):
        lo, hi = 0.0, 1.0  # the smallest exponent at which no source is passed more often than that
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if max(max(shares) / s for s in shares) ** (1 - mid) > most else (lo, mid)
        t = mixing.exponent(mixing.source_shares(mixing.source_totals(docs.select("source", mixing.word_tokens(F.col("text")).alias("n_tokens")))), most_passes=most)
        assert abs(t - hi) < 2e-6
        got = mixing.mixture(docs, most_passes=most, budget=budget, block_rows=16).collect()
        assert Counter((r.doc_id, r.mix_pass, r.mix_block, r.mix_place, r.mix_tokens) for r in got) == mixed(rows, t, budget, block_rows=16)


def test_mixture_keeps_columns_of_any_name(spark):
    names = ["doc_id", "source", "text", "tokens", "blocks", "budget", "rest", "passes", "block", "_block", "mix_pass", "_mix_pass", "own", "c0", "rank", "place"]
    docs = spark.createDataFrame([(1, "a", "x y", *[f"v{i}" for i in range(len(names) - 3)])], names)
    got = mixing.mixture(docs, most_passes=2.0)
    assert got.columns == [*names, "__mix_pass", "mix_block", "mix_place", "mix_tokens", "mix_weight"]
    assert tuple(got.first())[: len(names)] == tuple(docs.first())


def test_exponent_meets_targets(spark):
    shares = spark.createDataFrame([(s, v) for s, v in (("a", 0.6), ("b", 0.3), ("c", 0.1))], "source string, share double")
    t = mixing.exponent(shares, most_passes=2.0)
    assert abs(mixing.repetition(shares, [t])[0] - 2.0) < 1e-4
    t = mixing.exponent(shares, target_entropy=1.5)
    assert abs(mixing.entropy(shares, [t])[0] - 1.5) < 1e-4
    assert mixing.exponent(shares, target_entropy=9.0) == 0.0 and mixing.exponent(shares, most_passes=100.0) == 0.0


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1300)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links[:-2]:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert all(got[x] == find(x) for a, b in links[:-2] if a != b for x in (a, b))


def test_near_duplicates_on_odd_rows(spark, odd):
    got = sorted(minhash_dedup.near_duplicates(odd).collect(), key=str)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(ODD) and len(by[1]) == 2 and by[1][0] == by[1][1]
    assert (by[2][0].n_shingles, by[3][0].n_shingles, by[5][0].n_shingles) == (0, 0, 0) and by[4][0].n_shingles == 1
    assert by[None][0].component_id is None and by[None][0].kept
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_buckets_are_joined_beyond_their_first(spark):
    """Chains of texts: each is near the next one only, and all share bands here and there."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[: 60 + 4 * i][4 * i :] + [f"x{j}" for j in range(0)]) for i in range(16)] + [" ".join(base)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, block=3).collect()}
    sets = [minhash_dedup.shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = root[a], root[b]
                root = [min(p, q) if r in (p, q) else r for r in root]
    assert got == dict(enumerate(root))


def test_superminhash_estimates():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 150).astype(np.uint64)
        sets = [np.unique(x[:120]), np.unique(x[30:])]
        sig = minhash_dedup.superminhash(np.concatenate(sets), np.repeat([0, 1], [len(s) for s in sets]), 2)
        errors.append((sig[0] == sig[1]).mean() - 90 / 150)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 16))
    x = centre[rng.integers(0, 30, 900)] + rng.normal(size=(900, 16)) * 0.12
    x = x[rng.integers(0, 900, 1000)]  # repeats
    rows = [(i, [float(v) for v in e], int(i % 2), 7) for i, e in enumerate(x)] + [(2000, None, 1, 7), (2001, [0.0] * 16, 1, 7), (2002, [float("nan")] * 16, 1, 7), (2003, [1.0] * 16, None, 7), (None, [1.0] * 16, 1, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell int")
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df, cell=60, block=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.arange(1000)[:, None] % 2 == np.arange(1000) % 2)
    np.fill_diagonal(near, False)
    comp = np.arange(1000)
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], 10**6).min(1))
        if (new == comp).all():
            break
        comp = new
    assert [got[i].n_links for i in range(1000)] == near.sum(1).tolist() and near.sum() > 100
    assert [got[i].component_id for i in range(1000)] == comp.tolist()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (2000, 2001, 2002, 2003)) and got[None].n_links == 0
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_vectors_that_share_a_key(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embedding_dedup.embedding_dedup(df).collect())
    assert got == [(1, 1, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 1, 1, False), (4, 3, 1, False), (4, 3, 1, False), (9, 0, 9, True)]


def test_given_vectors_meet_in_several_cells(spark, data):
    classes = spark.read.parquet(data.replace("0.001", "0.1") + "/embeddings.parquet").selectExpr("vec_id as rep", "label", "cast(embedding as array<double>) as v")
    assert [len(c) for c in embedding_dedup._centres(classes, embedding_dedup.CELL, 20_000).values()] == [2]


def test_vectors_of_many_lengths(spark):
    rows = [(2 * n + i, [1.0, *[0.01 * i] * n], 1) for n in range(1, 71) for i in (0, 1)] + [(900, [], 1)]
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all((got[2 * n + i].n_links, got[2 * n + i].component_id) == (1, 2 * n) for n in range(1, 71) for i in (0, 1)) and got[900].n_links == 0


def test_vectors_of_all_sizes(spark):
    sizes = [1.0, 1e200, 3e200, 1e-200, 5e-300]
    rows = [(i, [s, s * (1 + i / 100)], 1) for i, s in enumerate(sizes)] + [(9, [1e-200, -1e-200], 1)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 9: 0}


def test_one_dense_cell(spark):
    """All vectors are links of one another, some of them equal."""
    rows = [(i, [1.0, (i % 700) * 1e-4], "a") for i in range(900)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), block=200).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(899, 0)}


def test_contamination(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards watch from a distant tower at dawn".split()
    swapped = [w if i % 6 else f"z{i}" for i, w in enumerate(item)]
    texts = {1: "lead " + " ".join(item) + " tail", 2: " ".join(swapped), 3: "the lazy dog over the fox", 4: None, 5: "", 6: " ".join(item[2:15]) + " and more", 7: " ".join(w if i % 3 else f"q{i}" for i, w in enumerate(item)), 8: "of the " * 5000 + " ".join(item).upper()}
    docs = spark.createDataFrame([(*r, "x") for r in texts.items()], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs, tests).collect()}
    assert set(found) == {1, 2, 6, 8} and found[1].start == 1 and found[8].start == 10_000
    split = {r.doc_id for r in decontaminate.contamination(docs, tests, most=5).collect()}
    assert split == set(found)
    assert {r.doc_id for r in decontaminate.decontaminated(docs, tests).collect()} == {3, 4, 5, 7}
    assert decontaminate.contamination(docs.limit(0), tests).count() == 0 and decontaminate.contamination(docs, tests.limit(0)).count() == 0


def test_masks_miss_no_allowed_pattern():
    def places(masks, n):
        return [sum(1 << (i + at) for i, c in enumerate(m) if c == "x") for m in masks for at in range(n - len(m) + 1)]

    for n in range(decontaminate.LEAST_TOKENS, 21):
        wrong = n - math.ceil(decontaminate.SHARE * n)
        sets = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), wrong)])
        masks = decontaminate.MASKS if n >= decontaminate.WINDOW else decontaminate.SHORT_MASKS
        found = np.zeros(len(sets), bool)
        for p in places(masks, n):
            found |= sets & p == 0
        assert found.all(), n


def test_masks_are_enough_for_long_items():
    """The fewest substitutions that hit all masks, by the last tokens, for items of any length to 200."""
    span = max(map(len, decontaminate.MASKS)) - 1
    full = (1 << span) - 1
    last = np.arange(1 << span)
    fewest = np.where(last == full, 0, 10**6)  # before the item all tokens differ, at no cost
    for n in range(1, 201):
        new = np.full(1 << span, 10**6)
        for bit in (0, 1):
            to = last << 1 | bit
            ok = np.all([to & int(m[::-1].replace("x", "1").replace(".", "0")[::-1], 2) for m in decontaminate.MASKS], axis=0)
            np.minimum.at(new, to[ok] & full, fewest[ok] + bit)
        fewest = new
        if n >= decontaminate.WINDOW:
            assert fewest.min() > n - math.ceil(decontaminate.SHARE * n), n


def test_contamination_of_short_items_and_all_patterns():
    rng = np.random.default_rng(6)
    token = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for n in (1, 2, 7, 8, 9, 10, 12, 13, 14):
        item = token(n)
        held = decontaminate.TestSet([(5, item), (6, token(30))])
        wrong = n - math.ceil(0.75 * n) if n >= 8 else 0
        for places in itertools.combinations(range(n), wrong):
            text = np.concatenate((token(4), item, token(3)))
            text[4 + np.array(places, int)] = token(wrong)
            assert held.overlaps(text) == [(5, 4, n, n - wrong, (n - wrong) / n)]
        text = np.concatenate((token(4), item, token(3)))
        middle = 4 + (n - wrong - 1) // 2  # so that no 13 tokens hold fewer
        text[middle : middle + wrong + 1] = token(wrong + 1)
        assert held.overlaps(text) == []
    item = token(13)
    held = decontaminate.TestSet([(1, np.concatenate((token(20), item, token(20))))])
    for places in itertools.combinations(range(13), 3):
        text = np.concatenate((token(4), item, token(4)))
        text[4 + np.array(places)] = token(3)
        assert [x[0] for x in held.overlaps(text)] == [1]


def overlaps(text, items):
    """The keys of the items that the text overlaps with, place by place."""
    x, out = decontaminate.tokens(text), set()
    for k, t in items:
        for shift in range(-len(t) + 1, len(x)) if set(x.tolist()) & set(t.tolist()) else ():
            a, b = max(0, -shift), min(len(t), len(x) - shift)
            same = t[a:b] == x[shift + a : shift + b]
            whole = same.sum() >= 0.75 * len(t) if len(t) >= 8 else same.sum() == len(t)
            if whole or (b - a >= 13 and np.convolve(same, np.ones(13), "valid").max() >= 0.75 * 13):
                out.add(k)
                break
    return out


def test_contamination_as_brute_force(spark, data):
    docs, tests = (common.table(spark, data, t).collect() for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, data).collect()}
    items = [(t.item_id, decontaminate.tokens(t.text)) for t in tests]
    assert got == {(d.doc_id, k) for d in docs for k in overlaps(d.text, items)}


def one_of_each_group(rows):
    """The rows whose key is the least of its near duplicates', by all pairs of word shingles."""
    sets = {}
    for k, _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
            p, q = sorted((root[a], root[b]))
            root = {k: p if r == q else r for k, r in root.items()}
    return [r for r in rows if root[r[0]] == r[0]]


def test_pipeline_as_brute_force(spark, data):
    import corpus_pipeline as p

    docs, labels, tests = (common.table(spark, data, t) for t in ("documents", "labels", "benchmark"))
    scorer = toxicity.Scorer(toxicity.learn(docs, labels))
    rows = [r for r in map(tuple, docs.select("doc_id", "source", "text").collect()) if scorer.score(r[2]) < 0.5]
    rows = one_of_each_group(rows)
    items = [(t.item_id, decontaminate.tokens(t.text)) for t in tests.collect()]
    rows = [r for r in rows if not overlaps(r[2], items)]
    left = spark.createDataFrame(rows, "doc_id long, source string, text string")
    t = mixing.exponent(mixing.source_shares(mixing.source_totals(left.select("source", mixing.word_tokens(F.col("text")).alias("n_tokens")))), most_passes=queries.MOST_PASSES)
    times = Counter()
    for (k, *_), n in mixed(rows, t).items():
        times[k] += n
    want = Counter()
    for k, _, text in rows:
        ids = [*tokenized(text), 2]
        want[k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += times[k]
    out = sorted(p.run(spark, data).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r, after in zip(out, [*out[1:], None]):
        assert r.start == at and (after is None or r.doc_id <= after.doc_id)
        at += r.n_tokens


def test_toxicity(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    hit = got[got.predicted == 1]
    # 350 labelled toxic texts of four languages are few
    assert (hit.toxic == 1).mean() > 0.7 and (got[got.toxic == 1].predicted == 1).mean() > 0.65
    order = got.score.rank()
    n = (got.toxic == 1).sum()
    assert (order[got.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(got) - n)) > 0.9  # area under the curve


def test_toxicity_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, "x"), (5, 0, "x"), (2, 1, "x"), (None, 1, "x"), (4, None, "x")], "doc_id long, toxic int, text string")
    none = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert len(none) == len(ODD) and all(r.predicted == 0 and 0 <= r.score <= 1 for r in none)
    few = toxicity.toxicity(odd.withColumn("score", F.lit(1)), labels).collect()
    assert len(few) == len(ODD) and all(0 <= r.score <= 1 for r in few)
    assert len({r.score for r in few if r.doc_id == 1}) == 1
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_contexts_as_brute_force(spark):
    rows = [(1, "a B c. a b c"), (1, "a b c"), (0, "b a\tb"), (0, ""), (1, ". .")]
    seen = defaultdict(set)
    for label, text in rows:
        w = [x.strip(".").encode() for x in text.lower().split()]
        for x in zip([b"", *w[:-1]], w, [*w[1:], b""]):
            if x[1]:
                seen[x[1], label].add((x[0], x[2]))
    got = {bytes(r.window): (r.toxic, r.ordinary) for r in toxicity.contexts(spark.createDataFrame(rows, "label int, text string")).collect()}
    assert got == {w: (len(seen[w, 1]), len(seen[w, 0])) for w in {w for w, _ in seen}}


def test_pipeline_on_odd_rows(spark, odd, data):
    import corpus_pipeline as p

    names = ["tokens", "blocks", "_toxic", "_kept", "mix_pass", "n", "row", "hash", "score"]
    docs = odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]).union(odd.select(F.col("doc_id"), F.lit("another text of this key is here too").alias("text"), *odd.columns[2:], *[F.lit(9).alias(n) for n in names]).filter("doc_id = 1"))
    for rows in (docs, docs.limit(0)):
        kept = rows
        for _, stage in p.STAGES[:-1]:
            kept = common.settle(stage(spark, kept, data))
            assert kept.columns == rows.columns
        out = p.STAGES[-1][1](spark, kept, data)
        assert out.count() == kept.count()
    near = p.drop_near_duplicates(spark, docs, data)
    assert sorted(r.doc_id or 0 for r in near.collect()) == [0, 1, 2, 3, 4, 5]
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in p.drop_near_duplicates(spark, docs.repartition(5), data).collect()}


def test_one_kept_and_one_dropped_text_of_a_key(spark, data):
    import corpus_pipeline as p

    a, b, c = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen", "some other words that nobody else has here"
    rows = [(2, a), (5, a), (5, b), (6, b), (7, c), (7, c), (8, c + " too"), (9, a), (9, a), (9, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for d in (docs, docs.repartition(7), docs.orderBy("text")):
        got = sorted((r.doc_id or 0, r.text) for r in p.drop_near_duplicates(spark, d, data).collect() if r.text)
        assert got == [(0, a), (2, a), (5, b), (7, c)]
        assert p.drop_near_duplicates(spark, d, data).count() == 5  # (9, null) too


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = common.table(spark, data, "documents")
    kept = docs
    for _, stage in p.STAGES[:-1]:
        last, kept = kept, common.settle(stage(spark, kept, data))
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids <= {r.doc_id for r in last.select("doc_id").collect()}
    assert not ids & {r.doc_id for r in queries.op1_decontamination(spark, data).collect()}
    out = p.run(spark, data).collect()
    assert {r.doc_id for r in out} == ids and len(out) == kept.count()
