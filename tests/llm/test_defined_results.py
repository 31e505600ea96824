"""Null and repeated ids, repeated rows, very long texts and clashing names, operator by operator."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from weirflow.llm import byte_bpe, line_dedup, packing, pii, secrets, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rank int, _salt string, row string, sequence_id string"
LONG = "A line of words and numbers 4111 1111 1111 1111 that goes on.\n" * 4000 + "last@example.org password=abcdefgh12"
ROWS = [(1, "mail a@b.cd now", "s"), (1, "another text under the same id", "s"), (None, "no id, but x@y.zz", "t"), (None, None, None), (7, LONG, "s"), (8, "", "s"), (1, "mail a@b.cd now", "s"), (9, "token = 12345678", "u")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, 0, 5, "salt", "row", "mine") for i, t, s in ROWS], DOCS).coalesce(2)


def test_pii_takes_rows_as_they_are(docs):
    got = sorted(((r.doc_id, r.n_email, r.n_card) for r in pii.detect(docs).collect()), key=str)
    assert got == sorted([(1, 1, 0), (1, 0, 0), (None, 1, 0), (None, 0, 0), (7, 1, 4000), (8, 0, 0), (1, 1, 0), (9, 0, 0)], key=str)


def test_byte_bpe_takes_rows_as_they_are(docs):
    got = byte_bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    want = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ROWS)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == want


def test_packing_takes_rows_as_they_are(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    cut = packing.pieces(docs, path).withColumns({"_salt": F.lit("mine"), "_rank": F.lit("mine"), "row": F.lit(1), "offset": F.lit("old")})
    got = packing.pack(cut)
    assert got.where("_salt = 'mine' AND _rank = 'mine' AND row = 1").count() == got.count() and got.columns.count("offset") == 1
    sizes = {}
    for r in got.collect():
        sizes.setdefault((r.doc_id, r.sequence_id), 0)
        sizes[r.doc_id, r.sequence_id] += r.length
    total = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ROWS)
    assert sum(sizes.values()) == total
    ends = [sorted((r.offset, r.length) for r in rows) for rows in (got.where(F.col("sequence_id") == s).collect() for s in {r.sequence_id for r in got.collect()})]
    assert all(a + n == b for own in ends for (a, n), (b, _) in zip(own, own[1:])) and all(own[0][0] == 0 for own in ends)


def test_toxicity_scores_repeated_rows_alike_and_other_texts_by_themselves(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, toxic int")
    texts = [(i, ("you foul dreadful thing " if i % 2 else "a calm and pleasant day ") * 6) for i in range(40)]
    model = toxicity.train(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r._score <= 1 for r in got)
    assert len({r._score for r in got if r.doc_id == 1}) == 2 and max(r._windows for r in got) > 1000


def test_fitting_takes_whole_texts_until_it_has_its_words(spark, monkeypatch):
    seen = []
    real = toxicity.Texts
    monkeypatch.setattr(toxicity, "Texts", lambda rows: seen.extend(rows) or real(seen))
    monkeypatch.setattr(toxicity, "MOST_WORDS", 300)
    ids = range(400)
    texts = [(i, f"word{i} " * (100 + i % 7)) for i in ids]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 2)) for i in ids], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    whole = {" ".join(t.split()) for _, t in texts}
    assert {t for t, _ in seen} <= whole
    for label in (0, 1):
        words = [len(t.split()) for t, y in seen if y == label]
        assert 300 <= sum(words) < 300 + 107


def test_line_dedup_and_secrets_of_a_long_text(spark, docs):
    done = {r.doc.doc_id: r for r in line_dedup.deduped(docs.where("doc_id = 7")).collect()}
    assert done[7].n_removed > 3000
    found = {(r.doc_id, len(r.base)) for r in secrets.scan(docs).where("doc_id > 1").select("doc_id", "base").collect()}
    assert found == {(7, 1), (8, 0), (9, 1)}


def test_warc_keeps_a_long_page_whole(spark, tmp_path):
    html = "<p>" + "é long page " * 400_000 + "</p>"
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(1, "http://a", html), (2, "http://b", html), (3, "http://c", "x")], "page_id long, url string, html string")
    warc.write_archives(warc.pages_to_records(pages), path)
    rows = {r.record_type: r for r in warc.read_archives(spark, path).where("payload_bytes > 10").collect()}
    assert bytes(rows["response"].payload).decode() == html and rows["revisit"].payload_bytes == len(html.encode()) and rows["revisit"].payload is None
    assert np.isfinite(rows["response"].payload_bytes)
