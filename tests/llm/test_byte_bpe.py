"""The written sentencepiece model against tiktoken over the same ranks, and round trips."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken

from docquarry.llm import byte_bpe, queries

PATH = byte_bpe.ranks_path()


@pytest.fixture(scope="module")
def known():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(data):
    return array("I", data).tolist()


def test_each_token_is_its_own_id():
    tokens = byte_bpe.read_ranks(PATH)
    codec = byte_bpe.Codec(PATH, public_tokenizers.PATTERN)
    assert codec.tokens == tokens
    letters = byte_bpe.byte_characters()
    assert len(set(letters)) == 256
    assert codec.model.encode(["".join(letters[b] for b in t) for t in tokens]) == [[i] for i in range(len(tokens))]


def test_ids_as_tiktoken(known):
    codec, rnd = byte_bpe.Codec(PATH, public_tokenizers.PATTERN), random.Random(1)
    letters = "ab 'tsSREd 　é1½⅓!?—日本語🎉‍\n\t\x00\x85▁<unk><s>�\U0010ffff"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["", "<unk> <s></s>", "▁▁ a", "a" * 100_000, "x" * 65 + " " + "y" * 70, "word été " * 200_000 + " \n " * 1000]
    got = codec.encode([*texts, None])
    assert [ids_of(x) for x in got] == [known.encode_ordinary(t) for t in texts] + [[]]
    assert codec.decode(got) == [t.encode() for t in texts] + [b""]


def test_memory_is_bounded(monkeypatch, known):
    monkeypatch.setattr(byte_bpe, "MEMORY", 20_000)
    codec, rnd = byte_bpe.Codec(PATH, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(50):
        text = " ".join("".join(rnd.choices("etaoinéß", k=rnd.randint(1, 90))) for _ in range(60))
        assert ids_of(codec.encode([text])[0]) == known.encode_ordinary(text)
        assert codec.held <= 40_000 and all(len(w) <= byte_bpe.LONGEST for w in codec.known)


def test_ranks_without_gaps(tmp_path):
    (tmp_path / "ranks").write_text("IQ== 0\nIg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(tmp_path / "ranks"))


def test_query_as_tiktoken(spark, data, known):
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        ids = known.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = queries.queries()["op11_byte_bpe"](spark, data)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want


def test_odd_rows(spark, known):
    nothing = hashlib.sha256(b"").hexdigest()
    rows = [(1, "one two", "x", 5), (1, "one two", "x", 5), (None, "one two", None, 1), (2, None, "y", 2), (3, "", "y", 2), (4, "long " * 400_000, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, n_tokens int")
    got = byte_bpe.byte_bpe_digests(docs).collect()
    count = {(r.doc_id, r.n_tokens) for r in got}
    assert len(got) == 6 and count == {(1, 2), (None, 2), (2, 0), (3, 0), (4, len(known.encode_ordinary("long " * 400_000)))}
    assert {(r.ids_sha256, r.decoded_sha256) for r in got if r.n_tokens == 0} == {(nothing, nothing)}
    assert byte_bpe.byte_bpe_digests(docs.limit(0)).count() == 0
    kept = byte_bpe.decoded(byte_bpe.encoded(docs))
    assert kept.columns == [*docs.columns, "ids", "decoded"]
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in kept.collect())
    with pytest.raises(ValueError):
        byte_bpe.encoded(docs, ids="n_tokens")
