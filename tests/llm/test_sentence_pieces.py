import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from weirflow.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, ids string, begins int, n_tokens string"
SEEDS = ["a", "b", " ", "  ", "hello", "▁", "\n", "\0", "é", "é", "한국", "🙂", "the ", "ing", "123", "<s>", "<0x0A>", "\t", "ﬁ", "Ａ", "①", "½", "ｶﾞ", "​", "\x01", "　", "٠"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return sp.codec(PATH)


def texts(n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(SEEDS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def plain(library, text):
    found = library.encode(text, return_type="proto").pieces
    return [p.id for p in found], [(p.begin, p.end) for p in found]


def decoded(codec, lists):
    raw, sizes = codec.decode(np.array([i for x in lists for i in x], dtype=np.int64), np.array([len(x) for x in lists]))
    ends = np.cumsum(sizes)
    return [raw[b - n : b].tobytes().decode() for b, n in zip(ends, sizes, strict=True)]


def test_ids_spans_and_decoded_texts_equal_the_library(library, codec):
    given = [*texts(1500, 40), "a" * 3000 + "the " * 50 + "▁" * 77, "", " ", "▁", "한" * 400]
    got = sp.encode_many(codec, given)
    for text, found in zip(given, got, strict=True):
        assert found == plain(library, text), text
    assert decoded(codec, [ids for ids, _ in got]) == [library.decode(ids) for ids, _ in got]
    assert sp.encode_many(codec, ["é x", None], True, True) == [([1, *plain(library, "é x")[0], 2], [(0, 0), *plain(library, "é x")[1], (4, 4)]), ([1, 2], [(0, 0), (0, 0)])]


def test_any_list_of_ids_decodes_as_the_library_does(library, codec):
    rng = random.Random(5)
    lists = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3, 259), 1, 2, 0, 259]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    assert decoded(codec, lists) == [library.decode(ids) for ids in lists]


def number(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def with_rules(spec):
    """The model's file with other rules of normalisation."""
    raw = open(PATH, "rb").read()
    at, kept = 0, b""
    while at < len(raw):
        begin, key = at, raw[at]
        at, size, shift = at + 1, 0, 0
        while True:
            size, shift, at = size | (raw[at] & 127) << shift, shift + 7, at + 1
            if raw[at - 1] < 128:
                break
        at += size
        kept += raw[begin:at] if key >> 3 != 3 else b""
    return kept + b"\x1a" + number(len(spec)) + spec


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_maps_and_their_alignment_equal_the_library(rule, prefix, squeeze):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    raw = with_rules(normalizer.serialized_normalizer_spec())
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), sp.Codec(sp.Model(raw))
    given = texts(600, 12, seed=7)
    got = sp.encode_many(own, given)
    for text, found in zip(given, got, strict=True):
        assert found == plain(library, text), text
    assert decoded(own, [ids for ids, _ in got]) == [library.decode(ids) for ids, _ in got]


def test_chunks_of_every_length_merge_alike(codec, library):
    rng = random.Random(9)
    for n in (2, 3, 31, 32, 33, 64, 200):
        for _ in range(20):
            text = "".join(rng.choice("aeinrst▁") for _ in range(n))
            assert sp.encode_many(codec, [text])[0] == plain(library, text)


def test_what_a_worker_keeps_is_bounded(library, monkeypatch):
    monkeypatch.setattr(sp, "KEPT_IDS", 50)
    own = sp.Codec(sp.Model.load(PATH))
    for text in texts(30, 30, seed=4):
        assert sp.encode_many(own, [text])[0] == plain(library, text)
    assert own.ids.used < 500


def test_frames(spark, library, monkeypatch):
    monkeypatch.setattr(sp, "GROUP", 64)
    long = "one two three, four\n" * 40
    rows = [(1, "héllo wörld", "x", 1, "y"), (2, None, None, None, None), (3, "", "", 0, ""), (None, "no id", "x", 1, "y"), (5, long, "x", 1, "y"), (5, "another text", "x", 1, "y"), (1, "héllo wörld", "x", 1, "y")]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = sp.round_trip_digests(docs, PATH)
    assert [tuple(r)[:4] for r in got.collect()] == want
    spans = {r.doc_id: r.spans_sha256 for r in got.collect()}
    pieces = library.encode(long, return_type="proto").pieces
    assert spans[5] != spans[3] and hashlib.sha256(np.array([(p.begin, p.end) for p in pieces], "<i8").tobytes()).hexdigest() in [r.spans_sha256 for r in got.collect()]
    encoded = sp.encode(docs, PATH, begin=True, end=True)
    assert [tuple(r) for r in sp.decode(encoded, PATH).collect()] == [(r[0], r[1] or "") for r in rows]
    assert encoded.where("size(ids) <> size(begins) or size(ids) <> size(ends)").count() == 0
    assert sp.round_trip_digests(docs.limit(0), PATH).count() == 0 and encoded.where(F.lit(False)).count() == 0


def test_parts_of_long_texts_are_the_whole_text(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sp, "GROUP", 48)
    own = sp.Codec(sp.Model.load(PATH))
    given = [" lead and  two\nblanks é " * 9, "x" * 300, "a b " * 60, ""]
    for text, found in zip(given, sp._digests(own, pa.array(given)), strict=True):
        ids = library.encode(text, add_bos=True, add_eos=True)
        spans = np.array([(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces], "<i8").tobytes()
        assert found == (len(ids), *(hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode(), spans)))
