"""Byte-level BPE against the tokenizer's own calls."""

import hashlib
import unicodedata

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartolith.llm import bytepairs

DATA = "/root/testdata/sf0.001"
VOCABULARY = "byte_bpe_50k.json"


def library():
    found = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    found.no_truncation()
    found.no_padding()
    return found


def test_splitting_agrees_on_all_characters():
    splitter, pre = bytepairs.splitter_of(VOCABULARY), library().pre_tokenizer
    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    for at in range(0, len(known), 50):
        text = "".join(f"a{c}a1{c}1!{c}! {c}{c}" for c in known[at : at + 50])
        assert splitter._split(text) == [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]


def test_ascii_pattern_agrees(spark):
    splitter, rng = bytepairs.splitter_of(VOCABULARY), np.random.default_rng(2)
    for _ in range(3000):
        text = "".join(map(chr, rng.choice([*range(128), *map(ord, " 's'll'  \n\n\t1a")], 60)))
        assert splitter._split(text) == splitter.word.findall(text)


def test_portions_of_long_texts_keep_words(monkeypatch):
    splitter = bytepairs.splitter_of(VOCABULARY)
    text = "It's  a\n\n text , with   spaces\t and'll   1234 numbers  !! \n" * 40
    want = splitter.word.findall(text)
    for size in (1, 7, 50):
        monkeypatch.setattr(bytepairs, "PORTION", size)
        assert [w for part in splitter.words(text) for w in part] == want


def test_edges(spark, monkeypatch):
    end = "<|endoftext|>"
    texts = ["", None, " ", "\n\n  a", f"one{end}two {end} ", end, "It's we'll '' ''s 'S", "naïve 日本語 ٣٤ ½  x　y ​", "a" * 30_000, "word " * 30_000, "\x00\x01 \x7f", "same words", "same words", "é \U0001f600 \U0002ebf0 \U00016100 new", "�"]
    rows = [(k if k != 3 else None, t, 1.0, "x") for k, t in enumerate(texts)] + [(11, "same words", 2.0, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids double, batch string").repartition(3)
    tokenizer = library()
    want = sorted((str(d), tokenizer.encode(t or "", add_special_tokens=False).ids, t or "") for d, t, *_ in rows)
    for size in (1 << 25, 8):
        monkeypatch.setattr(bytepairs, "BATCH_CHARS", size)
        monkeypatch.setattr(bytepairs, "PLACES", 4 if size == 8 else 4096)
        found = bytepairs.encoded(frame).collect()
        assert sorted((str(r.doc_id), np.frombuffer(r.ids, dtype="<u4").tolist(), r.decoded) for r in found) == want
        assert all(r.n_tokens * 4 == len(r.ids) for r in found)
    assert bytepairs.encoded(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert bytepairs.encoded(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].n_tokens == 0


def test_decoding_any_ids(spark):
    tokenizer, rng = library(), np.random.default_rng(1)
    sequences = [(k, rng.integers(0, 50257, n).tolist()) for k, n in enumerate((0, 1, 5, 300, 25_000))] + [(None, [50256, 1, 1])]
    found = {r.doc_id: r.decoded for r in bytepairs.decoded(spark.createDataFrame(sequences, "doc_id long, ids array<int>")).collect()}
    byte = {r.id: bytes(r.piece) for r in bytepairs.pieces(spark, VOCABULARY).collect()}
    assert len(byte) == 50257 and byte[50256] == b"<|endoftext|>"
    for doc, ids in sequences:
        whole = b"".join(byte[i] for i in ids)
        if "�" not in tokenizer.decode(ids, skip_special_tokens=False):
            assert found[doc] == tokenizer.decode(ids, skip_special_tokens=False)
        assert found[doc].replace("�", "") == whole.decode("utf-8", "replace").replace("�", "")


def test_every_distinct_word_is_encoded_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    batches = bytepairs.dictionaries(docs, VOCABULARY).select("batch", "words")
    table = bytepairs.distinct_words(batches, VOCABULARY)
    assert table.count() == batches.select(F.explode("words")).distinct().count()


def test_query_equals_library(spark):
    tokenizer = library()
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in bytepairs.op12_bpe(spark, DATA).collect()}
    assert len(found) == len(rows)
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (found[doc].n_tokens, found[doc].ids_sha256, found[doc].decoded_sha256) == want
        assert decoded == (text or "")
