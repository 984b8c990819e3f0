"""Extra columns with the names that the operators use inside come through untouched."""

from seriesloom.llm.jaccard import keep_one_each
from seriesloom.llm.mixing import sample_mix
from seriesloom.llm.quality import keep_good
from seriesloom.llm.secrets import redact

NAMES = ["_text", "_row", "_id", "_doc", "_tokens", "_p", "tokens", "kept", "topic", "spans", "start"]


def test_columns_survive(spark):
    long_ = " ".join(f"word{i}" for i in range(80))
    rows = [(i, t, "s", None, len(t or ""), *[f"{n}{i}" for n in NAMES]) for i, t in enumerate([long_ + " password=abcdef12", long_, None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int, " + ", ".join(f"{n} string" for n in NAMES))
    for step, ids in ((keep_good, {0, 1}), (keep_one_each, {0, 2, 3}), (redact, {0, 1, 2, 3}), (lambda d: sample_mix(d, {"source": 1.0, "lang": 1.0, "topic": 1.0}, 1.0), {0, 1, 2, 3})):
        got = step(docs)
        assert got.columns == docs.columns
        found = {r.doc_id: r for r in got.collect()}
        assert found.keys() == ids
        assert all(r[n] == f"{n}{i}" for i, r in found.items() for n in NAMES)
