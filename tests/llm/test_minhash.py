"""SuperMinHash signatures, buckets and groups against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import jaccard, minhash
from seriesloom.llm.common import mix64

from test_jaccard import brute, corpus


def one_by_one(s, slots):
    """The signature by the definition: whole permutations, no early stop."""
    out = [2**64 - 1] * slots
    for h in s.tolist():
        place = list(range(slots))
        for j in range(slots):
            draw = int(mix64(np.array([h], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))[0])
            k = j + int(mix64(np.array([draw ^ 0xD6E8FEB86659FD93], np.uint64))[0]) % (slots - j)
            place[j], place[k] = place[k], place[j]
            out[place[j]] = min(out[place[j]], j << 56 | draw >> 8)
    return out


def test_signatures_equal_the_definition():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 0, 2, 7, 40, 300)]
    got = minhash.signatures(sets, 32)
    assert [r.tolist() for r in got] == [one_by_one(s, 32) for s in sets]


def test_estimates_are_unbiased_and_tighter_than_independent_hashes():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(300):
        core = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = np.unique(core[:50]), np.unique(core[10:])
        x, y = minhash.signatures([a, b])
        errors.append((x == y).mean() - 40 / 60)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.8 * (40 / 60) * (20 / 60) / minhash.SLOTS


def test_sketches_and_bands():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 2**63, (40, 128)).astype(np.uint64)
    sig[1, 5:] = sig[0, 5:]
    sketch = minhash.sketch_of(sig)
    for i, j in ((0, 1), (2, 3), (4, 4)):
        assert minhash.agreement(sketch[i], sketch[j]) == ((sig[i] & np.uint64(3)) == (sig[j] & np.uint64(3))).sum()
    bands = minhash.bands_of(sig, 4)
    assert bands.shape == (40, 32) and len(np.unique(bands)) == 39 * 32 + 2
    assert (bands[0, 2:] == bands[1, 2:]).all()
    assert minhash.band_rows(85) == 4 and minhash.band_rows(80) == 3
    assert 0.5 * 128 < minhash.least_agreement(85) < 0.8 * 128


def test_buckets_cut_anywhere():
    """A bucket over the bound becomes a star; others leave the groups of their near sets."""
    same, far = [7, 7, 7, 7], [~7, ~7, ~7, ~7]
    rows = [(1, 5, 10, same), (1, 5, 11, same), (2, 5, 12, same), (2, 5, 13, far), *((3, 5, 100 + i, far) for i in range(9)), (4, 5, 20, same), (4, 5, 21, far), (4, 5, 22, same), (4, 9, 23, same), (5, 5, 30, same)]
    for step in range(1, len(rows) + 1):
        batches = []
        for a in range(0, len(rows), step):
            k, n, r, w = zip(*rows[a : a + step], strict=True)
            batches.append(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, n, r, *zip(*w, strict=True))], ["key", "n", "rep", "w0", "w1", "w2", "w3"]))
        got = sorted((x["u"], x["v"]) for out in minhash._buckets(85, 4, iter(batches)) for x in out.to_pylist())
        assert got == sorted([(10, 11), *((100, 100 + i) for i in range(1, 9)), (20, 22)])


@pytest.mark.parametrize(("k", "percent", "block"), [(5, 85, 1 << 20), (5, 80, 600), (3, 85, 200)])
def test_groups(spark, monkeypatch, k, percent, block):
    texts = corpus(k + percent + block, 60)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", max(4, block // 100))
    monkeypatch.setattr(minhash, "BUCKET_MOST", 512 if block > 600 else 8)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    rows = minhash.near_copies(docs, k, percent).collect()
    want = brute(texts, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id][1]) for r in rows)


def test_null_ids_repeated_rows_long_texts_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    long_ = " ".join(f"v{i % 70_000}" for i in range(90_000))
    rows = [(None, text), (4, text), (4, text), (2, text + " x"), (None, None), (5, ""), (8, long_), (9, long_ + " end"), (6, "same word " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in minhash.near_copies(docs).collect())))
    assert got == sorted(map(str, [(None, None, True), (4, 2, False), (4, 2, False), (2, 2, True), (None, None, True), (5, 5, True), (8, 8, True), (9, 8, False), (6, 6, True)]))
    assert minhash.near_copies(docs.limit(0)).count() == 0
