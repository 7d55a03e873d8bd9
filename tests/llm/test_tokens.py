import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard

from parlance.llm import token_counts as tc
from parlance.llm import token_files
from parlance.llm import tokenizing as tk
from parlance.llm.queries import op5_token_files, op8_token_counts
from parlance.llm.text import buffers
from parlance.llm.token_files import Encoder, read_documents, read_token_digests, write_token_files
from parlance.llm.tokenizing import Pieces, cuts, load
from tests.llm import brute

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x\n\ny", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c", "x,<|endoftext|>.", "don't I'll  ", "it's.' we'll,", "a_,b_, c_d_,",
       "1234 56,78", "é. n̈,", "\n", "x\n", "\nx", "a\nb.\nC, d\n", "tab\tx \t y", "x \x1c y\x1c z", "ΣΑΣ ", "ΣΑΣ.", "½, ²; ①.", "a≮ b", "日本語 テスト。", "A" * 3000, "x\x85y z", "　x"]


def test_pieces_are_exact():
    whole = load(BYTES)
    for text, got in zip(ODD, Encoder(BYTES, 0).encode(ODD), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0], repr(text)
    tok = load(WORDS)
    pieces = Pieces(tok, len)
    for text in ODD:
        assert counted(pieces, [text]) == [len(tok.encode(text, add_special_tokens=False).ids)], repr(text)


def sliced(texts):
    ((_, raw, off),) = buffers(pa.array([t.encode() for t in texts], pa.binary()), 1 << 30)
    return raw, off


def counted(pieces, texts):
    found, place, bounds = pieces.of_slice(*sliced(texts))
    return [sum(found[i] for i in place[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_cuts_are_splits_whatever_stands_beside(monkeypatch):
    """Random texts of characters that meet in odd ways: the pieces' ids together are those of the whole text, also where pieces are forgotten."""
    rng = random.Random(3)
    some = ["a", "Z", "é", "×", "ß", "7", "½", "漢", "かな", "Σ", "\u0301", "\u0338", "'", "'s", "'LL", ",", ".", "_", "—", "<", "|", ">", "<|", "|>", "<|endoftext|>", "<|STARTOFTEXT|>", " ", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\u180e", "\x00", "Â", "😀"]
    texts = ["".join(rng.choices(some, k=rng.randrange(14))) for _ in range(6000)]
    ends = np.unique(np.concatenate([cuts(*sliced(texts))]))
    assert len(ends) > len(texts)
    for kept in (tk.KEPT, 40):
        monkeypatch.setattr(tk, "KEPT", kept)
        encoder, counts = Encoder(BYTES, 0), Pieces(load(WORDS), len)
        assert encoder.pieces.cut and counts.cut
        for i in range(0, len(texts), 500):
            part = texts[i : i + 500]
            want = [[*e.ids, 0] for e in load(BYTES).encode_batch(part, add_special_tokens=False)]
            assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(part)] == want
            assert counted(counts, part) == [len(e.ids) for e in load(WORDS).encode_batch(part, add_special_tokens=False)]


def test_round_trip(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in op5_token_files(spark, sf).collect()}
    start = 0
    for (i, _), e in zip(docs, load(BYTES).encode_batch([t for _, t in docs], add_special_tokens=False), strict=True):
        ids = [*e.ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_short_access_and_awkward(spark):
    df = brute.awkward(spark)
    path = write_token_files(df, BYTES)
    rows = sorted(read_token_digests(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == df.count() and [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    found = {r["doc_id"]: r["token_ids"] for r in read_documents(spark, path, 5, 8).collect()}
    assert found[5] == [0] and found[6] == [0] and set(found) == {5, 6, 7, 8}
    assert found[8] == [*load(BYTES).encode("one two", add_special_tokens=False).ids, 0]
    assert read_token_digests(spark, write_token_files(df.limit(0), BYTES)).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(300, 20), (60, 5), (1000, 64)])
def test_resynchronisation(spark, sf, chunk, overlap):
    tok = load(WORDS)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(25).collect()] + ["A" * 2000, "ab " * 900, "á" * 700, "x  \n  y " * 200, "é, " * 500]
    for text in texts:
        assert tc.count_huge(tok, text, chunk, overlap) == len(tok.encode(text, add_special_tokens=False).ids)


def test_counts(spark, sf):
    tok = load(WORDS)
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_token_counts(spark, sf).collect():
        n = len(tok.encode(want[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(want[r["doc_id"]].encode()), n > 2048)
    df = brute.awkward(spark)
    rows = tc.token_counts(df, WORDS, chunk_chars=5000).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert len(rows) == df.count()
    for r in rows:
        if r["doc_id"] is not None:
            assert r["n_tokens"] == len(tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)


def test_long_documents_have_a_dictionary(spark, sf):
    """Of texts that are all longer than a stretch, the dictionary is not empty, and frames are smaller with it."""
    rng = random.Random(3)
    words = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]
    texts = []
    while len(texts) < 40:
        text = ""
        while len(text) < 150_000:
            text += rng.choice(words) + "\n"
        texts.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    path = write_token_files(df, BYTES)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["data"])
    assert len(dictionary) > 10_000
    parts = [np.frombuffer(x, "<u2") for x in Encoder(BYTES, 0).encode([t[:2000] for t in texts])]
    plain, helped = zstandard.ZstdCompressor(level=3), zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
    size = lambda packer: sum(len(packer.compress(p.tobytes())) for p in parts)
    assert size(helped) < 0.9 * size(plain)
    assert [len(r["token_ids"]) for r in read_documents(spark, path, 3, 4).orderBy("doc_id").collect()] == [len(x) // 2 for x in Encoder(BYTES, 0).encode(texts[3:5])]


@pytest.mark.parametrize("n", [0, 3, 20_000, 100_000])
def test_stretches_begin_at_ids(n):
    data = np.arange(n, dtype="<u4").tobytes()
    for seed in range(20):
        got = np.frombuffer(token_files._stretch(data, 4, seed), "<u4")
        assert len(got) == min(n, token_files.SAMPLE_BYTES // 4) and (np.diff(got.astype(int)) == 1).all()
