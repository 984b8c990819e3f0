"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import digests, encode_documents
from .common import Scratch, table
from .html import extract_text
from .jaccard import similar_groups
from .licenses import find_licenses
from .minhash import near_copies
from .mixing import mixing_rates, mixing_sql
from .neighbours import nearest_to_every
from .phrases import top_phrases
from .quality import QualityRules, quality_figures
from .repeats import cut_repeats
from .secrets import find_secrets
from .tokens import replay
from .whitening import whitening_table

Query = Callable[[SparkSession, str], DataFrame]
BPE = "byte_bpe_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = {f"{name}/1": (public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN) for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    return replay(table(spark, sf_dir, "documents"), Scratch(spark, "ledger").root, versions).totals()


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_to_every(table(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), public_tokenizers.PATTERN, back=True))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_figures(table(spark, sf_dir, "documents"))



#: Given shares of languages; exponents that temper the observed shares of sources and topics.
MIX = {"source": 0.7, "lang": {"en": 0.5, "de": 0.2, "*": 0.3}, "topic": 0.9}


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), MIX)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.length("kept")).alias("n_removed")
    return cut.select("doc_id", "n_bytes", removed, F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_table(table(spark, sf_dir, "embeddings"))


def op12_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(table(spark, sf_dir, "documents"))


WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def quality_sql(rules: QualityRules) -> str:
    """The figures and verdict of `quality_figures` over documents, in DuckDB's SQL."""
    steps = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents)",
        "b AS (SELECT doc_id, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols FROM d)",
        "p AS MATERIALIZED (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)",
        "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM d)",
        f"m AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS later, list_sum(list_transform({WORDS.format(text='line')}, lambda x: length(x))) AS chars FROM l WHERE len({WORDS.format(text='line')}) > 0)",
        "r AS (SELECT doc_id, count(*) FILTER (later) AS n_dup_lines, coalesce(sum(chars) FILTER (later), 0) AS chars FROM m GROUP BY doc_id)",
    ]
    for k in (3, *rules.coverage):
        steps.append(f"g{k} AS (SELECT doc_id, i, length(w[i]) AS chars, CASE WHEN i + {k - 1} <= len(w) AND count(*) OVER (PARTITION BY doc_id, CASE WHEN i + {k - 1} <= len(w) THEN w[i:i + {k - 1}] ELSE [CAST(i AS VARCHAR)] END) > 1 THEN 1 ELSE 0 END AS again FROM p)")
        steps.append(f"h{k} AS (SELECT doc_id, chars, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS inside FROM g{k})")
        steps.append(f"c{k} AS (SELECT doc_id, sum(inside)::BIGINT AS words, sum(chars * inside) AS chars FROM h{k} GROUP BY doc_id)")
    most = "greatest(word_chars, 1)"
    cover = {k: f"coalesce(c{k}.chars, 0) / {most}" for k in rules.coverage}
    line = f"coalesce(r.chars, 0) / {most}"
    failed = f"(n_words < {rules.min_words} OR 100 * coalesce(c3.words, 0) > {rules.repeat_words_percent} * n_words)"
    bad = " OR ".join([f"{c} > {rules.coverage[k]}" for k, c in cover.items()] + [f"{line} > {rules.line_coverage}", f"n_symbols > {rules.symbols_per_word} * n_words"])
    joins = " ".join(f"LEFT JOIN c{k} USING (doc_id)" for k in (3, *rules.coverage))
    return (
        f"WITH {', '.join(steps)} SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words, {failed} AS base_failed, NOT {failed} AND NOT ({bad}) AS kept, "
        f"CAST({line} AS DOUBLE) AS line_coverage, {', '.join(f'CAST({c} AS DOUBLE) AS coverage_{k}' for k, c in cover.items())} FROM b LEFT JOIN r USING (doc_id) {joins}"
    )


OP9_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, len(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
least AS (SELECT w, min(doc_id) AS first FROM win GROUP BY w HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN least USING (w) WHERE doc_id > first),
cut AS (SELECT *, sum(CASE WHEN i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit)),
run AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM cut GROUP BY doc_id, run),
gap AS (SELECT doc_id, a AS stop, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM run UNION ALL SELECT d.doc_id, n, coalesce(max(b), 0) FROM d LEFT JOIN run USING (doc_id) GROUP BY d.doc_id, n),
kept AS (SELECT doc_id, coalesce(string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start, stop), '') AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
count AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM run GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN count USING (doc_id)
"""

def groups_sql(k: int, percent: int, last: str) -> str:
    """Sizes and groups of sets of k-word n-grams over documents, in DuckDB's SQL; last: a further column."""
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
k AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS key, s FROM g),
c AS MATERIALIZED (SELECT key, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY key),
x AS MATERIALIZED (SELECT rep, n, unnest(s) AS s FROM c),
l AS MATERIALIZED (SELECT a, b FROM (SELECT p.rep AS a, q.rep AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS c FROM x p JOIN x q ON p.s = q.s AND p.rep < q.rep AND 100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n) GROUP BY 1, 2) WHERE 100 * c >= {percent} * (na + nb - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a),
m AS (SELECT node AS rep, min(seen) AS label FROM r GROUP BY node), n AS (SELECT a AS rep, count(*) AS n_links FROM u GROUP BY a)
SELECT k.doc_id, k.n AS n_shingles, coalesce(label, c.rep, k.doc_id) AS component_id, {last} FROM k LEFT JOIN c ON k.n > 0 AND k.key = c.key LEFT JOIN m ON c.rep = m.rep LEFT JOIN n ON c.rep = n.rep
"""


OP10_SQL = groups_sql(4, 85, "coalesce(n_links, 0) AS n_links")
OP12_SQL = groups_sql(5, 85, "coalesce(label, c.rep, k.doc_id) = k.doc_id AS kept")

OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
scored AS (SELECT cuts.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_counts, op2_nn_descent, op3_byte_bpe, op4_source_mixing, op5_secret_scan, op6_quality_rules, op7_license_scan, op8_html_extraction, op9_suffix_dedup, op10_ngram_jaccard, op11_embedding_whitening, op12_super_minhash, op13_phrase_mining)}
SQL: dict[str, str] = {"op4_source_mixing": mixing_sql(MIX), "op6_quality_rules": quality_sql(QualityRules()), "op9_suffix_dedup": OP9_SQL, "op10_ngram_jaccard": OP10_SQL, "op12_super_minhash": OP12_SQL, "op13_phrase_mining": OP13_SQL}
