"""Groups against brute force over all pairs."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import jaccard
from seriesloom.llm.jaccard import Block, Links, _lists, keep_one_each, list_pairs, needed, similar_groups


def sets_of(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(texts, k, percent):
    s, up = sets_of(texts, k), list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s[i]), root(i)) for i in range(len(s))}


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 60))
    passage = " ".join(word() for _ in range(14))
    base = [[word() for _ in range(rng.randint(1, 160))] for _ in range(n)]
    hot = [word() for _ in range(90)]
    texts = [None, "", " ", "One", "one", "a b", "B a"]
    for b in base:
        t = list(b)
        texts.append(" ".join(t))
        for _ in range(rng.choice([0, 0, 1, 4])):
            t = list(t)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = word()
            texts.append((" \n" if rng.random() < 0.5 else " ").join(t) + (" " + passage if rng.random() < 0.3 else ""))
    for _ in range(2 * n):  # a large group of near copies
        t = list(hot)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = word() + "x"
        texts.append(" ".join(t).title())
    return texts


@pytest.mark.parametrize(("k", "percent", "common"), [(4, 85, 64), (5, 80, 4), (4, 85, -3)])
def test_groups(spark, monkeypatch, k, percent, common):
    texts = corpus(k + percent + common, 60)
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "BLOCK", 2000)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "LIST_MOST", 64 if common != 4 else 3)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(3)
    rows = similar_groups(docs, k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, k, percent)
    s = sets_of(texts, k)
    classes = {frozenset(x) for x in s if x}
    for r in rows[::7]:
        own = s[r.doc_id]
        assert r.n_links == sum(own != x and 100 * len(own & x) >= percent * len(own | x) for x in classes if own)


def test_null_ids_repeated_rows_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text + " x"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.component_id) for r in similar_groups(docs).collect())))
    assert got == sorted(map(str, [(None, None), (4, 2), (4, 2), (2, 2), (None, None)]))
    assert sorted(map(str, (r.doc_id for r in keep_one_each(docs).collect()))) == ["2", "None", "None"]
    assert similar_groups(docs.limit(0)).count() == 0


def test_long_lists_meet_through_one_class():
    """A list over the bound, cut by batches at every place, leaves a star; lists around it leave their pairs."""
    rows = [(1, 10, 5), (1, 11, 5), *((2, 100 + i, 5) for i in range(9)), (3, 12, 5), (3, 10, 5)]
    for step in range(1, len(rows) + 1):
        batches = []
        for a in range(0, len(rows), step):
            t, r, n = zip(*rows[a : a + step], strict=True)
            batches.append(pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(r, pa.int64()), pa.array([x << 31 for x in n], pa.int64()), pa.array([99] * len(t), pa.int64())], ["token", "rep", "place", "ends"]))
        got = sorted((x["a"], x["b"]) for out in _lists(85, 4, iter(batches)) for x in out.to_pylist())
        assert got == sorted([(10, 11), (10, 12), *((100, 100 + i) for i in range(1, 9))])


def test_skipping_loses_no_pair():
    rng = np.random.default_rng(3)
    n = np.sort(rng.integers(5, 40, 120))
    pos = rng.integers(0, 6, 120)
    order = np.lexsort((pos, n))
    n, pos = n[order], pos[order]
    i, j, opens = list_pairs(n, pos, 85)
    got = {(a, b): o for a, b, o in zip(i.tolist(), j.tolist(), opens.tolist(), strict=True)}
    assert got == {(a, b): min(n[a] - pos[a], n[b] - pos[b]) >= needed(int(n[a]), int(n[b]), 85) for a in range(120) for b in range(a + 1, 120) if 100 * n[a] >= 85 * n[b]}


def test_incremental_overlaps():
    rng = np.random.default_rng(4)
    core = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(core, 57, False), rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(40)]
    direct = {frozenset((i, j)) for i in range(40) for j in range(i) if 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - b)}
    block, links, names = Block(sets), Links(), np.arange(40)
    for i, s in enumerate(sets):
        hit = block.linked(s, 85)
        hit[i] = False
        assert set(names[hit].tolist()) == {j for e in direct if i in e for j in e - {i}}
        links.add(i, names[hit])
    joined = {frozenset(x) for x in links.pairs}
    assert joined <= direct
    assert [links.count.get(i, 0) for i in range(40)] == [sum(i in e for e in direct) for i in range(40)]

    def groups(edges):
        up = list(range(40))
        for e in edges:
            a, b = sorted(e)
            ra, rb = up[a], up[b]
            up = [min(ra, rb) if x in (ra, rb) else x for x in up]
        return up

    assert groups(joined) == groups(direct)



def test_slices_bound_what_is_shuffled_at_once(spark, monkeypatch):
    """Lists and blocks in several slices, texts told apart by the sieve: the same groups; and no prefix or whole set is kept once it is used."""
    texts = corpus(9, 20)
    for name, value in (("BROADCAST_IDS", 0), ("SLICE_ENTRIES", 600), ("SLICE_GRAMS", 2000), ("SLICES", 2)):
        monkeypatch.setattr(jaccard, name, value)
    roots, kept, keep = set(), [], jaccard.Scratch.keep
    monkeypatch.setattr(jaccard.Scratch, "keep", lambda self, df, name: roots.add(self.root) or kept.append((name, df.columns)) or keep(self, df, name))
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "no id"), (rows[5][0], rows[5][1])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, 5, 80).collect()}
    want = brute(texts, 5, 80)
    assert got.pop(None) == (1, None) and got == want
    names = {name for name, _ in kept}
    assert {"met/0", "met/1", "links/0", "links/1"} <= names and not any("tokens" in columns for _, columns in kept)
    for root in roots:
        left = [p for p in Path(root.removeprefix("file://")).rglob("*.parquet") if "prefix" in pq.read_schema(p).names]
        assert not left
    got = sorted(map(str, (r.doc_id for r in keep_one_each(docs, 5, 80).collect())))
    assert got == sorted(map(str, [i for i, (_, c) in want.items() if i == c] + [None]))


def test_texts_that_stay_are_not_shuffled(spark, monkeypatch, tmp_path):
    """With more marks than are broadcast, only the rows that a sieve marks meet them: before, every text was shuffled, twice where rows repeat."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(50_000)) for _ in range(64)]
    rows = [*((i, i, t) for i, t in enumerate(texts)), (100, 7, "near"), (None, None, "no id"), (200, 200, "twice"), (200, 200, "twice")]
    spark.createDataFrame(rows, "doc_id int, component_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(jaccard, "similar_groups", lambda *a: docs.select(F.col("doc_id").cast("long"), "component_id"))
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        got = [(r.doc_id, r.text) for r in keep_one_each(docs).select("doc_id", "text").collect()]
        assert sorted(map(str, got)) == sorted(str((i, t)) for i, t in [*enumerate(texts), (None, "no id"), (200, "twice")])
        assert shuffled() - before < 500_000 < sum(map(len, texts)) / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
