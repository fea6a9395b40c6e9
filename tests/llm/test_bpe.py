import random

import numpy as np
import pytest

from quillspark.llm import bpe
from quillspark.llm.common import flat
from quillspark.llm.queries import tokenizer_path

ODD = ["", "aaaaaaaa", " a\x1cb\x85c　 d  ", "x<|endoftext|>y <|endoftext|><|endoftext|>", "z" * 5000, "é😀\n\n  \t x'll've 123 ½²Ⅷ", "\r\n  a​b\x1f \x1e", "àb", " " * 1000 + "x", "'s", "'", "'l", " 's", "''s", "'lx"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_library(reference):
    import pyarrow as pa

    rng = random.Random(1)
    letters = [*" \n\t  's'tlremvd1a!é", "<|endoftext|>", "  ", "'ll"]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    enc = bpe.Encoder(tokenizer_path())
    data, offsets = flat(pa.array(texts))
    ids, at = enc.encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == reference.encode(t, add_special_tokens=False).ids


def test_memory_of_words_may_be_emptied(reference, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    enc = bpe.Encoder(tokenizer_path())
    for t in ("one two three four", "five six one", "one two"):
        data, offsets = flat(pa.array([t]))
        assert enc.encode(data, offsets)[0].tolist() == reference.encode(t, add_special_tokens=False).ids


def test_columns_nulls_and_round_trip(spark):
    rows = [(i, t, "kept", [1]) for i, t in enumerate([*ODD, None, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    out = bpe.decode(bpe.encode(df, tokenizer_path(), keep_text=True), tokenizer_path())
    assert sorted(out.columns) == ["decoded", "doc_id", "ids", "text"]
    for r in out.collect():
        assert r.decoded == (r.text or "") and (r.ids == []) == (not r.text)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path()).count() == 0


def test_cut_characters_decode_to_replacements(spark):
    enc = bpe.Encoder(tokenizer_path())
    ids, _ = enc.bpe.encode_words(["😀".encode()])
    df = spark.createDataFrame([(ids[:1].tolist(),), (None,)], "ids array<int>")
    got = [r.decoded for r in bpe.decode(df, tokenizer_path()).collect()]
    assert "�" in got[0] and got[1] == ""
    assert np.array_equal(enc.bpe.decode_flat(ids)[0], np.frombuffer("😀".encode(), np.uint8))


def test_strings_that_a_hash_by_powers_of_two_confuses(reference):
    import pyarrow as pa

    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word + "." + other, other + " " + word, "ab" * 600 + "-" + "ba" * 600]
    enc = bpe.Encoder(tokenizer_path())
    data, offsets = flat(pa.array(texts))
    ids, at = enc.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_one_hash_stay_apart(reference, monkeypatch, sf):
    import pyarrow.parquet as pq

    class Poor(bpe.Roll):
        def of(self, start, end):
            return super().of(start, end) & np.uint64(255)

    monkeypatch.setattr(bpe, "Roll", Poor)
    enc = bpe.Encoder(tokenizer_path())
    column = pq.read_table(f"{sf}/documents.parquet")["text"]
    for part in (column, column.take(list(range(len(column)))[::-1])):
        data, offsets = flat(part)
        ids, at = enc.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [reference.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]


def test_query_equals_the_library_on_the_whole_table(spark, reference, sf):
    import hashlib

    from quillspark.llm.queries import op3_bpe

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = reference.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
