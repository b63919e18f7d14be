"""Secret scans: base patterns with offsets, and a randomness test battery under false-discovery control."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spans import PAGE, matches
from .common import LOWER, UPPER, table, written

#: (kind, pattern, part of the match whose length doesn't count, least length), in the order of the contract.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?is)^[a-z_]+["']?\x20*[:=]\x20*["']?""", 6),
    ("access", r"AKIA[A-Z0-9]+", "", 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", "", 24),
)
#: Runs of token characters that the battery looks at.
MIN_TOKEN = 16
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
RANDOM = "random"
MARK = "[SECRET]"
DIGITS = "0123456789"
#: Alphabets of the encodings; a token's is the first whose characters it keeps to. Letters of lower case alone are
#: words that have run together, and no encoding.
ALPHABETS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base32lower", r"^(?=.*[2-7])(?=.*[a-z])[a-z2-7]+$", LOWER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UPPER),
    ("base36lower", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER),
    ("letters", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", UPPER + LOWER),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
#: Ordinary tokens: how a character's class (upper, lower, digit, other) follows the one before, or the start. An
#: encoding without a class shares its part out among the others.
CLASSES = ((0.40, 0.50, 0.08, 0.02), (0.08, 0.82, 0.06, 0.04), (0.11, 0.08, 0.75, 0.06), (0.25, 0.50, 0.23, 0.02), (0.30, 0.50, 0.15, 0.05))
#: Letters of ordinary text in per mille, a to z; they stand in for PRIOR letters seen after each letter.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
PRIOR = 20
FALSE_DISCOVERY = 0.05
#: A token that the three tests tell from random characters at this level is structured, whatever else it is.
STRUCTURED = 0.001
#: p-values are counted by quarter powers of two, down to 2**-50.
STEPS, LAST = 4, 200


def _long_enough(head: str, least: int) -> Callable[[Column], Column]:
    return lambda s: F.length(F.regexp_replace(s["span"], head, "") if head else s["span"]) >= least


def base_spans(text: Column) -> dict[str, Column]:
    """By kind the array<struct<start, end, span>> of the contract's base secrets in a text, in code points."""
    return {kind: F.filter(matches(text, pattern), _long_enough(head, least)) for kind, pattern, head, least in KINDS}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, inside of one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution, by a logistic approximation with error under 0.0002."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(z * 1.5976 + z * z * z * 0.070565992))


def random_p(plain: Column, alphabet: Column) -> Column:
    """The evidence against random characters of the alphabet: three times the least p of the three tests.

    Chi-squared uniformity over the alphabet (its exact mean and variance, upper tail), runs of the lower and
    upper half of the alphabet, and lag-1 serial correlation of the values, both two-sided.
    """
    n, k = F.length(plain).cast("double"), F.length(alphabet).cast("double")
    counts = F.transform(F.split(alphabet, ""), lambda a: F.when(a == "", 0.0).otherwise((F.length(plain) - F.length(F.replace(plain, a, F.lit("")))).cast("double")))
    z_uniform = (k / n * _total(F.transform(counts, lambda c: c * c)) - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)

    def sequence(values: Column) -> Column:
        mean, high = _total(values) / n, _total(F.transform(values, lambda v: (v > k / 2).cast("double")))
        pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = _total(F.transform(pairs, lambda p: ((p["a"] > k / 2) != (p["b"] > k / 2)).cast("double"))) + 1
        twice = 2 * high * (n - high)
        var_runs = twice * (twice - n) / (n * n * (n - 1))
        p_runs = F.when(var_runs > 0, 2 * _tail(F.abs((runs - twice / n - 1) / F.sqrt(var_runs)))).otherwise(0.0)

        def lagged(mean: Column) -> Column:
            lag, spread = _total(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean))), _total(F.transform(values, lambda v: (v - mean) * (v - mean)))
            return _let(F.struct(lag.alias("lag"), spread.alias("spread")), lambda x: F.when(x["spread"] > 0, 2 * _tail(F.abs((x["lag"] / x["spread"] + 1 / n) * F.sqrt(n)))).otherwise(0.0))

        return F.least(p_runs, _let(mean, lagged))

    values = F.filter(F.transform(F.split(plain, ""), lambda c: F.instr(alphabet, c).cast("double")), lambda v: v > 0)
    return F.least(F.lit(1.0), 3 * F.least(_tail(z_uniform), _let(values, sequence)))


def _numbers(x: list[float]) -> Column:
    """A constant array, by way of one string: the optimizer folds it."""
    return F.split(F.lit(",".join(map(repr, x))), ",").cast("array<double>")


class Ordinary:
    """How ordinary tokens of each encoding run: their classes by CLASSES, their letters by pairs in the corpus's own long words.

    Those are the distinct tokens that are one word by their case, so random keys don't teach it.
    """

    def __init__(self, pairs: dict[str, int]):
        said = [x / sum(LETTERS) for x in LETTERS]
        self.letters = [math.log(x) for x in said]  # after no letter
        for a in LOWER:
            own = [pairs.get(a + b, 0) for b in LOWER]
            self.letters = self.letters + [math.log((n + PRIOR * p) / (sum(own) + PRIOR)) for n, p in zip(own, said, strict=True)]
        self.classes: list[float] = []
        for _, _, alphabet in ALPHABETS:
            held = [sum(c in group for c in alphabet) for group in (UPPER, LOWER, DIGITS, "+/-_")]
            for row in CLASSES:
                whole = sum(p for p, n in zip(row, held, strict=True) if n)
                # A class's characters are alike but for letters, whose own pairs decide unless there are few, as in hex.
                self.classes += [math.log(p / whole) - (math.log(n) if i > 1 or n < 26 else 0.0) if n else -99.0 for i, (p, n) in enumerate(zip(row, held, strict=True))]

    def log_p(self, plain: Column, encoding: Column, alphabet: Column) -> Column:
        """The log of an upper bound on the chance that an ordinary token of its length looks as random as this one.

        How much likelier its characters are at random than as ordinary text has a mean of one over ordinary
        tokens, so by Markov's inequality it is above 1 / p with a chance of p at most, at every length. The
        ratio is that of the three tests: frequencies of characters, runs of classes and what follows what.
        """
        letters, classes, every = _numbers(self.letters), _numbers(self.classes), F.lit(UPPER + LOWER + DIGITS + "+/-_")
        few = F.length(alphabet) < 26
        kind = lambda v: F.when(v <= 26, 0).when(v <= 52, 1).when(v <= 62, 2).otherwise(3)
        letter = lambda v: F.when(v <= 52, (v - 1) % 26 + 1).otherwise(0)

        def told(values: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                before = F.get(values, i - 1)
                by_class = F.get(classes, (encoding * len(CLASSES) + F.when(i > 0, kind(before)).otherwise(4)) * 4 + kind(v))
                before_letter = F.when((i > 0) & (before <= 52), letter(before)).otherwise(0)
                by_letter = F.when((v <= 52) & ~few, F.get(letters, before_letter * 26 + letter(v) - 1)).otherwise(0.0)
                return by_class + by_letter + F.log(F.length(alphabet).cast("double"))

            return _total(F.transform(values, one))

        values = F.filter(F.transform(F.split(plain, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(every, c))), lambda v: v > 0)
        return _let(values, told)


def battery(hit: Column, ordinary: Ordinary) -> Column:
    """struct(encoding, band, step) of a token, null if it keeps to no encoding.

    band is a power of two of its length, step a count of quarter powers of two that its p-value is worth: 0
    for a token that the three tests find structured, else by how little an ordinary token of its encoding
    and length looks like it.
    """
    at = None
    for i, (_, shape, _) in enumerate(ALPHABETS):
        at = F.when(hit.rlike(shape), i) if at is None else at.when(hit.rlike(shape), i)

    def judged(i: Column) -> Column:
        alphabet = F.get(F.lit([letters for _, _, letters in ALPHABETS]), i)
        plain = F.when(i == 0, F.lower(hit)).otherwise(hit)
        worth = F.least(F.lit(float(LAST)), F.greatest(F.lit(0.0), F.floor(-ordinary.log_p(plain, i, alphabet) / math.log(2) * STEPS).cast("double")))
        step = F.when(random_p(plain, alphabet) < STRUCTURED, 0.0).otherwise(worth).cast("int")
        return F.when(i.isNotNull(), F.struct(F.get(F.lit([name for name, _, _ in ALPHABETS]), i).alias("encoding"), F.floor(F.log2(F.length(hit))).cast("int").alias("band"), step.alias("step")))

    return _let(at, judged)


def cutoffs(tested: DataFrame) -> dict[str, int]:
    """By encoding and band the step from which tokens are discoveries, by Benjamini and Hochberg's rule.

    tested: the battery's b of each distinct token, null where there is none. A band is a power of two of the length, so that long
    tokens, for which the tests have power, don't lend theirs to short ones. At most 9 encodings x 32 bands x
    201 steps are counted, however long the input.
    """
    counts: dict[str, list[tuple[int, int]]] = {}
    for b, c in tested.groupBy("b").agg(F.count("*").alias("c")).collect():
        if b is not None:
            counts.setdefault(f"{b['encoding']}:{b['band']}", []).append((b["step"], c))
    found = {}
    for key, own in counts.items():
        m, k = sum(c for _, c in own), 0
        for step, c in sorted(own, reverse=True):
            k += c
            if 2.0 ** (-step / STEPS) <= k * FALSE_DISCOVERY / m:
                found[key] = step
    return found


class Scanner:
    """What random tokens are in a corpus: the ordinary tokens it is held against, and the cuts by encoding and length."""

    def __init__(self, docs: DataFrame):
        text = F.coalesce("text", F.lit(""))
        hits = written(docs.where(F.col("text").rlike(TOKEN)).select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), 0))).alias("hit")).distinct(), "tokens")
        runs = hits.where(F.col("hit").rlike("^(?:[A-Z]?[a-z]+|[A-Z]+)$")).select(F.explode(F.regexp_extract_all("hit", F.lit("[a-z]{5,}|[A-Z]{5,}"), 0)).alias("run"))
        pairs = runs.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.lower(F.substring(F.col("run"), i, F.lit(2))))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
        self.ordinary = Ordinary({r["pair"]: r["n"] for r in pairs.collect()})  # 676 pairs at most
        self.cuts = cutoffs(hits.select(battery(F.col("hit"), self.ordinary).alias("b")))

    def random(self, text: Column) -> Column:
        """array<struct<start, end, span>> of the discoveries in a text."""
        if not self.cuts:
            return F.array().cast("array<struct<start:int,end:int,span:string>>")
        cuts = F.create_map(*(F.lit(x) for pair in sorted(self.cuts.items()) for x in pair))

        def discovered(s: Column) -> Column:
            return _let(battery(s["span"], self.ordinary), lambda b: F.coalesce(b["step"] >= F.try_element_at(cuts, F.concat_ws(":", b["encoding"], b["band"].cast("string"))), F.lit(False)))

        return F.filter(matches(text, TOKEN), discovered)

    def spans(self, docs: DataFrame, *keep: str | Column) -> DataFrame:
        """keep and an array of spans for each kind, RANDOM last, row by row."""
        text = F.coalesce("text", F.lit(""))
        found = docs.select(*keep, *(c.alias(kind) for kind, c in base_spans(text).items()), self.random(text).alias(RANDOM))
        base = F.concat(*(F.col(kind) for kind, *_ in KINDS))
        apart = F.filter(RANDOM, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return found.withColumn(RANDOM, apart)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, assign, access, hex, random (arrays of start, end, span) of every document.

    random holds tokens of 16 characters or more that keep to an encoding's alphabet, that the battery doesn't
    find structured, and that are discoveries against ordinary tokens at a false-discovery rate of 5 % in
    their encoding and length band, where they overlap no base span. Null and empty texts have none; each row
    is scanned by its own text, whatever its doc_id. Nothing but distinct tokens is shuffled.
    """
    return Scanner(docs).spans(docs, "doc_id")


def listed(*kinds: str) -> Column:
    """kind:start:end of the spans of these columns by start, then in the order given, comma-joined."""

    def of(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    each = [of(i, kind) for i, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redacted(text: Column, spans: Column) -> Column:
    """text with a mark for each run of overlapping spans; spans by start. Pieces gather in pages, as in matches."""

    def step(a: Column, s: Column) -> Column:
        # Text up to the span, then one mark; a span inside what is covered only moves the end.
        one = F.array(F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(MARK)))
        full = F.size(a["page"]) >= PAGE
        at = F.greatest(a["at"], s["end"]).alias("at")
        grown = F.struct(at, F.when(full, one).otherwise(F.concat(a["page"], one)).alias("page"), F.when(full, F.concat(a["pages"], F.array(F.array_join(a["page"], "")))).otherwise(a["pages"]).alias("pages"))
        return F.when(s["start"] >= a["at"], grown).otherwise(F.struct(at, a["page"].alias("page"), a["pages"].alias("pages")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("page"), F.array().cast("array<string>").alias("pages"))
    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["pages"], ""), F.array_join(a["page"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret span replaced by [SECRET]; overlapping spans by one mark, n_chars in step.

    Each row loses the spans of its own text, in the row itself, whatever its doc_id. Null texts stay null.
    """
    every = F.concat(*(F.col(kind) for kind, *_ in KINDS), F.col(RANDOM))
    found = Scanner(docs).spans(docs, F.struct(*docs.columns).alias("row"), "text")
    found = found.select("row", F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("spans"))
    found = found.withColumn("text", F.when(F.size("spans") > 0, _redacted(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text")))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*((own[c] if c in own else F.col("row")[c]).alias(c) for c in docs.columns))


def op8_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_secrets over all documents: counts, digest and list of the spans."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), n(RANDOM), F.sha2(listed("assign", "access", "hex"), 256).alias("base_sha256"), listed("assign", "access", "hex", RANDOM).alias("spans"))
