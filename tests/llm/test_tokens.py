"""Ledger totals against a recount of the documents that are left."""

from collections import Counter

import public_tokenizers as P
import pytest

from seriesloom.llm.bpe import codec
from seriesloom.llm.tokens import CHANGE, TokenLedger, replay

BPE = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def totals(ledger):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}


def test_batches_add_up_and_commit_once(spark, tmp_path):
    ledger = TokenLedger(spark, f"file://{tmp_path}")
    rows = lambda *x: spark.createDataFrame(x, CHANGE)
    first = rows((1, "a", "en", "t1", "insert", 0, 10), (2, "a", None, "t1", "insert", 0, 5), (None, "b", "en", "t1", "insert", 0, 7), (1, "a", "en", "t2", "insert", 0, 8))
    assert ledger.commit("b1", first) and not ledger.commit("b1", first)
    assert totals(ledger) == {("a", "en", "t1"): (1, 10), ("a", None, "t1"): (1, 5), ("b", "en", "t1"): (1, 7), ("a", "en", "t2"): (1, 8)}
    second = rows((1, "c", "en", "t1", "revise", 1, 12), (2, None, None, "t1", "delete", 1, None), (3, "b", "en", "t1", "revise", 1, 9), (3, "b", "en", "t1", "revise", 2, 3), (9, "x", "x", "t1", "delete", 0, 4), (None, "b", "en", "t1", "insert", 0, 7), (None, None, None, "t1", "delete", 0, 1))
    ledger.commit("b2", second)
    ledger.commit("b2", second)
    assert totals(ledger) == {("c", "en", "t1"): (1, 12), ("b", "en", "t1"): (3, 17), ("a", "en", "t2"): (1, 8)}
    assert ledger.batches() == ["b1", "b2"]


def test_folded_batches_and_a_second_writer(spark, tmp_path):
    ledger = TokenLedger(spark, f"file://{tmp_path}", fold=2)
    for i in range(4):
        ledger.commit(f"b{i}", spark.createDataFrame([(1, "a", "en", "t", "revise", i, 10 + i), (i + 10, "a", "en", "t", "insert", i, 1), (None, "n", None, "t", "insert", i, 2)], CHANGE))
    want = {("a", "en", "t"): (5, 17), ("n", None, "t"): (4, 8)}
    assert totals(ledger) == want and len(ledger._sources()) <= 2
    assert not ledger.commit("b0", spark.createDataFrame([], CHANGE))
    (tmp_path / "writer").touch()
    with pytest.raises(Exception, match="exists"):
        ledger.commit("b9", spark.createDataFrame([], CHANGE))
    ledger.unlock()
    assert totals(ledger) == want


def test_a_writer_between_test_and_lock(spark, tmp_path, monkeypatch):
    """Another writer commits the batch after this one has looked for its marker and before it holds the lock."""
    rows = spark.createDataFrame([(1, "a", "en", "t", "insert", 0, 10), (2, "a", "en", "t", "insert", 0, 5), (3, "a", "en", "t", "insert", 0, 1)], CHANGE)
    ledger, other = (TokenLedger(spark, f"file://{tmp_path}") for _ in range(2))
    mark = ledger._mark

    def late(file):
        if file == "writer":
            monkeypatch.setattr(ledger, "_mark", mark)
            assert other.commit("b1", rows)
        mark(file)

    monkeypatch.setattr(ledger, "_mark", late)
    assert not ledger.commit("b1", rows)
    assert totals(ledger) == {("a", "en", "t"): (3, 16)} and ledger.batches() == ["b1"]
    assert ledger.commit("b2", rows.withColumn("n_tokens", rows["n_tokens"] + 1))  # the lock is free again
    assert totals(ledger) == {("a", "en", "t"): (3, 19)}


def test_a_large_batch_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("seriesloom.llm.tokens.TASK_ROWS", 1)
    ledger, merge = TokenLedger(spark, f"file://{tmp_path}"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")  # else the few small parts of a test are merged again
    try:
        ledger.commit("b1", spark.createDataFrame([(i, "a", "en", "t", "insert", 0, 1) for i in range(640)] + [(None, f"s{i}", "en", "t", "insert", 0, 1) for i in range(40)], CHANGE))
    finally:
        spark.conf.unset(merge)
    assert max(len(list(d.glob("*.parquet"))) for d in (tmp_path / "batches" / "b1" / "rows").iterdir() if d.is_dir()) > 1
    assert sum(n for _, n in totals(ledger).values()) == 680


def test_unfinished_batch_does_not_count(spark, tmp_path):
    ledger = TokenLedger(spark, f"file://{tmp_path}")
    ledger.commit("b1", spark.createDataFrame([(1, "a", "en", "t", "insert", 0, 1)], CHANGE))
    (tmp_path / "commits" / "b1").unlink()
    assert totals(ledger) == {}
    ledger.commit("b1", spark.createDataFrame([(1, "a", "en", "t", "insert", 0, 2)], CHANGE))
    assert totals(ledger) == {("a", "en", "t"): (1, 2)}


def test_replay_equals_a_recount(spark, tmp_path):
    texts = ["one two\nthree\none two", None, "", "same words", "same words", "a\n\na\n", "same words", "last"]
    rows = [(i, t, ["s", None][i % 2], "en", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    want, seen, enc = Counter(), set(), codec(*BPE).encoding
    for _, t, s, lang, _ in rows:
        if t is not None and t in seen:
            continue
        seen.add(t)
        want[s, lang, "bpe", "docs"] += 1
        want[s, lang, "bpe", "tokens"] += len(enc.encode_ordinary("\n".join(dict.fromkeys((t or "").split("\n")))))
    got = totals(replay(docs, f"file://{tmp_path}/l", {"bpe": BPE}))
    assert got == {k[:3]: (want[*k[:3], "docs"], want[*k[:3], "tokens"]) for k in want}
    assert totals(replay(docs.limit(0), f"file://{tmp_path}/e", {"bpe": BPE})) == {}
