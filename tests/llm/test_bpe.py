"""Chunked encoding against whole-text encoding by the library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P

from seriesloom.llm.bpe import codec, decode_documents, digests, encode_documents

PATH, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def expected(text):
    ids = codec(PATH, PATTERN).encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_chunks_stitch_to_the_whole_text(spark):
    rng = random.Random(5)
    parts = ["the", " cat", "  ", "\n\n", "'re", "'", "!", "é", "漢字", " 12", "\t", "don't", "😀", " " * 9]
    texts = [None, "", "a", "x" * 700, " " * 500, "end  ", "'" * 300, "a" * 90 + "\n\n" * 40 + "b"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(20, 400))) for _ in range(60)]
    texts += ["漢" * 400, "same text " * 30, "same text " * 30]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 2), (70, texts[69], 3), (None, "null id " * 40, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    back = decode_documents(encode_documents(docs, PATH, PATTERN, chunk=64, overlap=24), PATH, PATTERN)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(back).collect())
    once = encode_documents(docs, PATH, PATTERN, chunk=64, overlap=24, back=True)
    assert got == sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(once).collect())
    assert {bytes(r.decoded).decode() for r in back.collect()} == {t or "" for _, t, _ in rows}
    assert got == sorted((str(i), *expected(t)) for i, t, _ in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(docs, PATH, PATTERN).count() == 0
