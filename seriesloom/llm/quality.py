"""Quality rules from repetition coverage.

All texts of a slice of a batch are hashed at once in numpy: words by prefix
sums over their bytes, windows of several lengths by rolling hashes over the
words.  A window that occurs again in its own text covers its words; the rule
looks at the share of characters so covered, for each window length, and at
the share inside repeated lines.

Hashes are 64 bits wide and compared only within one text: for a text of 10**5
windows a false repetition has odds below one in 10**9.

Defined results: a null text has no words and fails; each row is judged on its
own, so repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import RangeHash, SPACE, joined, mix64, repeated, small_batches, text_slices, word_bounds

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes measured at once.
SLICE = 1 << 18


@dataclass(frozen=True)
class QualityRules:
    """Most that a text may have of each; a text above any of them is not kept."""

    min_words: int = 50
    repeat_words_percent: int = 50
    #: Window length in words: largest share of characters inside repeated windows.
    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.60, 7: 0.55, 10: 0.50})
    line_coverage: float = 0.50
    symbols_per_word: float = 0.25


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double"


def measure(docs: list[bytes], rules: QualityRules) -> dict[str, np.ndarray]:
    """All figures of texts that fit into memory together."""
    buf, begin, end = joined(docs)
    n = len(docs)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[end] - sums[begin]

    letters = ~SPACE[buf] & ((buf & 0xC0) != 0x80)
    letter_sums = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
    start, stop = word_bounds(buf)
    doc = np.searchsorted(begin, start, "right") - 1
    size = letter_sums[stop] - letter_sums[start]
    hashed = RangeHash(buf)
    word = hashed(start, stop)
    salt = mix64(np.arange(1, n + 1, dtype=np.uint64))
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": letter_sums[end] - letter_sums[begin], "n_symbols": per_doc(SYMBOL[buf])}

    def covered(k: int, window: np.ndarray) -> np.ndarray:
        """Words inside windows of k words that occur again in the same text."""
        here = np.flatnonzero(doc[: len(window)] == doc[k - 1 :]) if len(window) else np.zeros(0, np.int64)
        again = here[repeated(mix64(window[here]) ^ salt[doc[here]])[0]] if len(here) else here
        edge = np.zeros(len(word) + 1, np.int32)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + k, -1)
        return np.cumsum(edge[:-1]) > 0

    chars = np.maximum(out["word_chars"], 1)
    window, failed = word, np.zeros(n, bool)
    for k in range(2, max([3, *rules.coverage]) + 1):
        window = window[:-1] * np.uint64(0xA24BAED4963EE407) + word[k - 1 :] if len(window) > 1 else word[:0]
        if k == 3:
            out["n_repeat_words"] = np.bincount(doc[covered(k, window)], minlength=n)
        if k in rules.coverage:
            inside = covered(k, window)
            share = np.bincount(doc[inside], weights=size[inside], minlength=n) / chars
            out[f"coverage_{k}"] = share
            failed |= share > rules.coverage[k]

    feeds = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], feeds[:-1] + 1])
    line_chars = letter_sums[feeds] - letter_sums[line_start]
    full = line_chars > 0
    line_start, line_end, line_chars = line_start[full], feeds[full], line_chars[full]
    line_doc = np.searchsorted(begin, line_start, "right") - 1
    later = repeated(hashed(line_start, line_end) ^ salt[line_doc])[1] if len(line_doc) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    out["line_coverage"] = np.bincount(line_doc[later], weights=line_chars[later], minlength=n) / chars
    failed |= out["line_coverage"] > rules.line_coverage
    failed |= out["n_symbols"] > rules.symbols_per_word * out["n_words"]
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_words_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & ~failed
    return out


def _judge(rules: QualityRules, keep_rows: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in text_slices(batch.column("text"), SLICE):
            got = measure(texts, rules)
            if keep_rows:
                yield batch.slice(a, b - a).filter(pa.array(got["kept"]))
                continue
            names = [x.split()[0] for x in COLUMNS.split(", ")] + [f"coverage_{k}" for k in rules.coverage]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(got[x]) for x in names)], ["doc_id", *names])


def quality_figures(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id and the figures and verdict of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    more = "".join(f", coverage_{k} double" for k in rules.coverage)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lambda it: _judge(rules, False, it), f"doc_id long, {COLUMNS}{more}")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs whose text the rules keep, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(lambda it: _judge(rules, True, it), docs.schema)
