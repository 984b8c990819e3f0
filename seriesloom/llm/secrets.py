"""Secret scans: fixed patterns, and character Markov models beside them.

Two first-order character models, one of random strings and one of ordinary
identifiers, are counted from labelled samples with DataFrame operations; the
result is one table of 128 x 128 log-likelihood ratios.  Every long token of a
text that no pattern has covered is scored by the mean of its ratios.

Everything is built from DataFrame functions.  Positions are code points: the
pieces between matches and the matches themselves are laid end to end.

Defined results: a null text is empty and has no spans; repeated rows give
repeated rows; spans of one kind never overlap; other columns are ignored by
`find_secrets` and kept by `redact`.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns of the kinds, in the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Tokens that the models judge.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
KINDS = ["assign", "access", "hex", "random"]

WORDS = (
    "get set is has user name id file path data list map key value index count size read write open close start stop time date string number "
    "array object node tree graph query table column row page view model control service client server request response handler manager factory "
    "builder parser token stream buffer cache queue stack message event listener error exception config option default test case result status "
    "state type class method function module package import export public private static final async await load save update delete create insert "
    "select from where order group the and that with for this are was not but have they which one all there their would about other into more some"
).split()

SPAN = "array<struct<start:int,end:int>>"


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """text, random (0 or 1): n strings of each kind, made by rule; n bounds the sample."""
    ids = spark.range(2 * n, numPartitions=2)
    digest = F.sha2(F.col("id").cast("string"), 256)
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int") + 1)
    random_ = F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).otherwise(F.regexp_replace(F.substring(F.base64(F.unhex(digest)), 1, 40), "[=]", ""))
    parts = [word(k) for k in range(5)]
    camel = F.concat(parts[0], *(F.initcap(p) for p in parts[1:]))
    number = F.translate(F.sha2(F.concat_ws("n", "id"), 256), "abcdef", "")
    running_digits = F.substring(F.lit("0123456789" * 5), F.pmod("id", F.lit(10)).cast("int") + 1, F.lit(20) + F.pmod("id", F.lit(13)).cast("int"))
    ordinary = (
        F.when(F.col("id") % 11 == 0, F.substring(F.concat(number, number), 1, 26))
        .when(F.col("id") % 11 == 1, running_digits)
        .when(F.col("id") % 11 == 2, F.concat_ws("-", F.substring(number, 1, 4), F.substring(number, 5, 2), F.substring(number, 7, 2), F.substring(number, 9, 6), parts[0]))
        .when(F.col("id") % 5 == 0, camel)
        .when(F.col("id") % 5 == 1, F.concat_ws("_", *parts))
        .when(F.col("id") % 5 == 2, F.concat_ws("-", *parts))
        .when(F.col("id") % 5 == 3, F.concat_ws("/", *parts, F.pmod("id", F.lit(100)).cast("string")))
        .otherwise(F.concat(*parts))
    )
    label = F.when(F.col("id") < n, 1).otherwise(0)
    return ids.select(F.when(label == 1, random_).otherwise(ordinary).alias("text"), label.alias("random"))


def codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """128 x 128 ratios log P(next | char, random) - log P(next | char, ordinary)."""
    pairs = samples.select("random", F.filter(codes("text"), lambda c: c < 128).alias("c")).select("random", "c", F.size("c").alias("n")).where("n > 1")
    pairs = pairs.select("random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.col("n") - 1), F.slice("c", F.lit(2), F.col("n") - 1), lambda a, b: a * 128 + b)).alias("pair"))
    counts = {(r.random, r.pair): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}  # at most 2 x 128 x 128 rows
    # 66 characters can follow in a token; each has the same share of the smoothing
    sums = [[sum(counts.get((k, a * 128 + b), 0) for b in range(128)) + 66 * smoothing for a in range(128)] for k in (0, 1)]
    logp = lambda k, a, b: log((counts.get((k, a * 128 + b), 0) + smoothing) / sums[k][a])
    return [round(logp(1, a, b) - logp(0, a, b), 6) for a in range(128) for b in range(128)]


DEFAULT_MODEL: list[list[float]] = []


def default_model(spark: SparkSession) -> list[float]:
    """The model of the default samples, which are the same everywhere; counted once a process."""
    if not DEFAULT_MODEL:
        DEFAULT_MODEL.append(train(labelled_samples(spark)))
    return DEFAULT_MODEL[0]


def mean_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio over the token's character pairs."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to one literal
    both = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.get(table, a * 128 + b))
    pairs = F.transform(F.array(codes(token)), both)
    return F.get(F.transform(pairs, lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(p), F.lit(1))), F.lit(0))


#: Elements of an array that one step of a running value appends to.
STEP = 256


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running value before each of some whole numbers, from 0.

    An array can only be extended by copying it, so values run in chunks, and
    over the chunks: the work grows with the length, not with its square.
    """
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / F.lit(STEP)).cast("int") - 1, F.lit(0))), lambda i: F.slice(values, i * STEP + 1, F.lit(STEP)))

    def along(array: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.lit([]).cast("array<int>").alias("out"))
        return F.aggregate(array, start, lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), merge))
    return F.flatten(F.zip_with(pieces, along(totals, F.lit(0)), along))


def laid_out(matches: str, pieces: str) -> Column:
    """Code-point spans of matches that lie between pieces, in order."""
    gaps = F.transform(F.slice(F.col(pieces), F.lit(1), F.size(matches)), lambda p: F.length(p))
    both = F.zip_with(gaps, F.transform(F.col(matches), lambda m: F.length(m)), lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")))
    begins = running(F.transform(both, lambda x: x["gap"] + x["n"]), lambda a, x: a + x)
    return F.zip_with(begins, both, lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end")))


def blanked(text: Column, pattern: str, gone: Callable[[Column], Column]) -> Column:
    """text with spaces for those matches of a pattern that are gone."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spaces = F.transform(matches, lambda m: F.when(gone(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    put = F.zip_with(F.split(text, pattern, -1), spaces, lambda piece, m: F.concat(piece, F.coalesce(m, F.lit(""))))
    return F.when(F.size(matches) > 0, F.array_join(put, "")).otherwise(text)


def with_spans(docs: DataFrame, model: list[float], threshold: float) -> DataFrame:
    """docs with arrays of spans: _assign, _access, _hex (base) and _random.

    The models judge the long tokens of what the base spans leave of a text.
    """
    df = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    none = F.lit([]).cast("array<string>")

    def found(df: DataFrame, kind: str, text: str, pattern: str) -> DataFrame:
        df = df.withColumn(f"_m_{kind}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        df = df.withColumn(f"_p_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split(text, pattern, -1)).otherwise(none))
        return df.withColumn(f"_s_{kind}", F.when(F.size(f"_m_{kind}") > 0, laid_out(f"_m_{kind}", f"_p_{kind}")).otherwise(F.lit([]).cast(SPAN)))

    for kind, pattern in patterns.items():
        df = found(df, kind, "_text", pattern)
    only = lambda spans, keep: F.transform(F.filter(F.arrays_zip(F.col(spans).alias("s"), keep.alias("k")), lambda x: x["k"]), lambda x: x["s"])
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    df = df.withColumns({"_assign": only("_s_assign", F.transform("_m_assign", long_enough)), "_access": F.col("_s_access"), "_hex": F.col("_s_hex")})
    # what the base spans leave; a match that is too short stays
    df = df.withColumn("_rest", F.when(F.size("_assign") > 0, blanked(F.col("_text"), ASSIGN, long_enough)).otherwise(F.col("_text")))
    for kind in ("access", "hex"):
        df = df.withColumn("_rest", F.when(F.size(f"_{kind}") > 0, blanked(F.col("_rest"), patterns[kind], lambda m: F.lit(True))).otherwise(F.col("_rest")))
    df = found(df, "random", "_rest", TOKEN)
    likely = F.transform("_m_random", lambda m: mean_ratio(m, model) > threshold)
    df = df.withColumn("_random", only("_s_random", likely))
    return df.drop("_rest", *(f"_{x}_{k}" for x in "mps" for k in [*patterns, "random"]))


def as_text(columns: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    def tagged(i: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    names = F.array(*map(F.lit, columns))
    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*(tagged(i, k) for i, k in enumerate(columns)))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


THRESHOLD = 0.8
#: Code points of a text that are cut together.
PIECE = 1024


def find_secrets(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row of docs (doc_id, text)."""
    model = model or default_model(docs.sparkSession)
    df = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, threshold)
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select("doc_id", *counts[:3], F.sha2(as_text(KINDS[:3]), 256).alias("base_sha256"), as_text(KINDS).alias("spans"), counts[3])


def redact(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span, overlapping ones together, replaced by mark; n_chars follows the text."""
    model = model or default_model(docs.sparkSession)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text")  # names of other columns cannot clash
    df = with_spans(whole, model, threshold).withColumn("_all", F.array_sort(F.concat(*(f"_{k}" for k in KINDS))))
    df = df.withColumn("_reach", running(F.transform("_all", lambda s: s["end"]), lambda a, x: F.greatest(a, x)))
    # the text in pieces, so that a gap is cut from where it lies
    df = df.withColumn("_cut", F.when(F.size("_all") > 0, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def between(a: Column, b: Column) -> Column:
        first = F.floor(a / F.lit(PIECE)).cast("int")
        held = F.slice("_cut", first + 1, F.floor(b / F.lit(PIECE)).cast("int") - first + 1)
        return F.when(b > a, F.substr(F.array_join(held, ""), a - first * PIECE + 1, b - a)).otherwise(F.lit(""))

    marked = F.zip_with("_all", "_reach", lambda s, at: F.when((s["start"] < at) & (at > 0), F.lit("")).otherwise(F.concat(between(at, s["start"]), F.lit(mark))))
    last = F.array_max(F.transform("_all", lambda s: s["end"]))
    clean = F.concat(F.array_join(marked, ""), between(last, F.length("_text")))
    df = df.withColumn("_clean", F.when(F.size("_all") > 0, clean).otherwise(F.col("text")))
    row = F.col("_row").withField("text", F.col("_clean"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.size("_all") > 0, F.length("_clean").cast("long")).otherwise(F.col("_row.n_chars")))
    return df.select(row.alias("_row")).select("_row.*")
