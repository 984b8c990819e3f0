"""The stages against brute force on a small table."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest

from seriesloom.llm.bpe import codec
from seriesloom.llm.mixing import mixing_rates
from test_jaccard import brute
from test_quality import plain

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstnl") for _ in range(rng.randint(2, 8)))
    rows = []
    for _ in range(60):
        t = [word() for _ in range(rng.randint(30, 200))]
        rows.append(" ".join(t))
        if rng.random() < 0.4:
            t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t))
        if rng.random() < 0.3:
            rows.append(" ".join([*t[:70], "password=0a1b2c3d4e5f", "é", *t[:5]] + [word() for _ in range(60)]))
    rows += [None, "", "junk junk junk " * 40, "$$$ &&& " * 80]
    return [(i, t, rng.choice(["en", "de", None]), "hot" if rng.random() < 0.4 else f"s{i % 5}", len(t or "")) for i, t in enumerate(rows)]


def test_stages(spark, tmp_path):
    rows = make(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], str(tmp_path)).write.parquet(f"{tmp_path}/s{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/s{k}"))
    for df in steps[:-1]:
        assert df.columns == docs.columns
    ids = [{r.doc_id: r for r in df.collect()} for df in steps]
    good = {i for i, t, *_ in rows if not plain(t)[-1]}
    assert ids[1].keys() <= good and len(ids[1]) >= 0.95 * len(good) - 1
    assert not {i for i, t, *_ in rows if t and t.startswith(("$$$", "junk"))} & ids[1].keys()
    kept = sorted(ids[1])
    groups = brute([ids[1][i].text for i in kept], 5, 80)
    assert set(ids[2]) == {kept[i] for i, (_, c) in groups.items() if i == c}
    assert ids[3].keys() == ids[2].keys()
    for i, r in ids[3].items():
        before = ids[2][i].text
        assert r.text == re.sub(r"password=[0-9a-f]+", "[SECRET]", before) and r.n_chars == (len(r.text) if r.text != before else ids[2][i].n_chars)
    drawn = {r.doc_id for r in mixing_rates(steps[3], corpus_pipeline.MIX, corpus_pipeline.KEEP).where("sampled").collect()}
    assert ids[4].keys() == drawn
    enc = codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encoding
    for i, r in ids[5].items():
        want = enc.encode_ordinary(ids[4][i].text)
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
    assert ids[5].keys() == ids[4].keys()
    final = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == {i: r.ids_sha256 for i, r in ids[5].items()}
