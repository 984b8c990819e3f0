"""Base spans against Python's regular expressions; the models against held-out samples."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from seriesloom.llm.secrets import THRESHOLD, find_secrets, labelled_samples, mean_ratio, redact, train

RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain(text):
    spans = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, ok)) in enumerate(RULES.items()) for m in p.finditer(text or "") if ok(m)]
    return [x[2] for x in sorted(spans)]


def test_base_spans(spark):
    rng = random.Random(4)
    bits = ["secret=token", "secret=token=abcdef", "Password : '", "api_key=", "APIKEY:\"", "abcdef1", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, " ", "é😀", "\n", "=", "token==x.y/z", "zz", "ſecret=abcdefgh", "toKen=abcdefgh"]
    texts = [None, "", "AKIA" * 6, "f" * 23, "f" * 24] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    rows = find_secrets(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in RULES)


def test_models_on_held_out_samples(spark):
    model = train(labelled_samples(spark))
    held = labelled_samples(spark, 9000).where(F.pmod(F.xxhash64("text"), F.lit(2)) == 0)
    right = held.select(((mean_ratio(F.col("text"), model) > THRESHOLD) == (F.col("random") == 1)).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.99
    words = ["01234567890123456789012345", "4111111111111111222233334444", "2024-01-05-12-30-00-backup", "eringthheatheainsthernation", "Donaudampfschifffahrtsgesellschaft", "internationalisation-of-things", "getUserNameFromRequestContext"]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert find_secrets(docs, model).agg(F.sum("n_random")).first()[0] == 0


def test_random_token_is_added_and_redacted(spark):
    token = "qX7zLp0vR2tKw9NbYc4MfH8sD1"
    docs = spark.createDataFrame([(1, f"é {token} and password=hunter22 end", 5), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r.spans for r in find_secrets(docs).collect()}
    assert found[1] == "random:2:28,assign:33:50"
    assert {(r.doc_id, r.text, r.n_chars) for r in redact(docs).collect()} == {(1, "é [SECRET] and [SECRET] end", 27), (2, "clean", 5), (3, None, None)}


def marked(text, spans):
    """Overlapping spans become one mark."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at or at == 0:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_redaction_by_spans_and_a_text_of_many_secrets(spark):
    rng = random.Random(6)
    bits = ["secret=abcdefgh", "token: 'a1b2c3d4e5f6a7b8c9d0e1f2'", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "deadbeef" * 3 + "api_key=zzzzzz", " ", "é😀 ", "plain words here ", "\n", "qX7zLp0vR2tKw9NbYc4MfH8sD1 ", "ab" * 700]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    texts.append(" and ".join(f"password=x{i}yz{i}w" for i in range(6000)))  # its spans outgrow a step, its text a piece
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    found = {r.doc_id: r for r in find_secrets(docs).collect()}
    assert found[120].n_assign == 6000
    for r in redact(docs).collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in found[r.doc_id].spans.split(",") if x]
        assert [x for x in found[r.doc_id].spans.split(",") if x and not x.startswith("random")] == plain(texts[r.doc_id])
        assert r.text == marked(texts[r.doc_id], spans) and (r.n_chars == len(r.text) or not spans)
    assert find_secrets(docs.limit(0)).count() == 0 and redact(docs.limit(0)).count() == 0
