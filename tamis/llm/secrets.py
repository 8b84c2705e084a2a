"""Secret scan: patterns, and sliding-window entropy over candidate strings.

Everything is DataFrame code. Spans of a pattern come from its matches and the
gaps between them, in code points. Candidate strings are long runs of key
characters; a window slides over each, the counts of its characters and the sum
of n log2 n are updated for the one that enters and the one that leaves, and
windows whose Shannon entropy passes the limit of the string's character class
make a span. Spans of patterns and harmless words are cut out of a string first and
what remains of it is scanned; strings that are wholly on the allow-list add nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.arrays import largest_before, once, sums_before
from tamis.llm.common import text_of

#: Pattern, least length and the group it applies to, by kind.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    "hex": (r"[0-9a-f]+", 24, 0),
}
#: What to look for first: a run that is too short costs nothing more.
FIRST = {"assign": KINDS["assign"][0], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Runs of characters that keys are made of, and the window over them.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Character classes, tried in turn: (pattern of the whole string, least entropy of a window in bits).
CLASSES = ((r"^[0-9a-fA-F]+$", 2.9), (r"^[A-Za-z0-9]+$", 3.7), (r"^[A-Za-z0-9+/_=-]+$", 3.9))
#: Strings that are no secrets: one kind of character only, words joined by signs, UUIDs, placeholders.
ALLOWED = (
    r"^[a-z+/_=-]+$", r"^[A-Z+/_=-]+$", r"^[A-Za-z]+$", r"^[0-9+/_=-]+$",
    r"^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[+/_=-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: Parts of strings that are no secrets, whatever stands beside them.
HARMLESS = r"(?i)example|placeholder|x{6,}"
LOWEST = 33  # code of the first character that is counted
MASK = "[SECRET]"

SPAN = "array<struct<start:int,end:int>>"


def _places(text: Column, pattern: str, keep: Column | None) -> Column:
    """Spans of all matches; ``keep`` (booleans by match) drops some."""

    def spans(both: Column) -> Column:
        sizes = F.transform(F.arrays_zip(both["hits"].alias("hit"), F.slice(both["gaps"], F.lit(1), F.size(both["hits"])).alias("gap")), lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit")))

        def placed(sized: Column) -> Column:
            before = sums_before(F.transform(sized, lambda x: x["gap"] + x["hit"]))
            return F.transform(F.arrays_zip(sized.alias("x"), before.alias("before")), lambda z: F.struct((z["before"] + z["x"]["gap"]).alias("start"), (z["before"] + z["x"]["gap"] + z["x"]["hit"]).alias("end")))

        return once(sizes, placed)

    found = once(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), spans)
    if keep is None:
        return found
    return F.transform(F.filter(F.arrays_zip(found.alias("span"), keep.alias("keep")), lambda z: z["keep"]), lambda z: z["span"])


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one pattern, leftmost and non-overlapping; failing matches are dropped."""
    pattern, least, group = KINDS[kind]
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.char_length(v) >= least)
    if kind != "assign":  # runs are maximal, so the length can stand in the pattern
        pattern, long_enough = FIRST[kind][:-1] + ",}", None
    return F.when(text.rlike(FIRST[kind]), _places(text, pattern, long_enough)).otherwise(F.array().cast(SPAN))


def _window_span(value: Column, limit: Column) -> Column:
    """First start and last end of the windows of ``value`` whose entropy reaches ``limit``; null if none does."""
    log = F.array(*[F.lit(float(n * log2(n)) if n else 0.0) for n in range(WINDOW + 2)])
    code = lambda i: F.ascii(F.substring(value, i, F.lit(1))) - LOWEST
    size = 127 - LOWEST
    start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(s: Column, i: Column) -> Column:
        enters, leaves = code(i), F.when(i > WINDOW, code(i - WINDOW))
        n_in = F.get(s["counts"], enters)
        same = leaves.eqNullSafe(enters)
        n_out = F.get(s["counts"], leaves)
        total = (
            F.when(same, s["sum"])
            .when(leaves.isNull(), s["sum"] - F.get(log, n_in) + F.get(log, n_in + 1))
            .otherwise(s["sum"] - F.get(log, n_in) + F.get(log, n_in + 1) - F.get(log, n_out) + F.get(log, n_out - 1))
        )
        counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda n, k: n + F.when(k == enters, 1).otherwise(0) - F.when(k == F.coalesce(leaves, F.lit(-1)), 1).otherwise(0)))
        high = (i >= WINDOW) & (log2(WINDOW) - total / WINDOW >= limit)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(high & s["first"].isNull(), i - WINDOW).otherwise(s["first"]).alias("first"), F.when(high, i).otherwise(s["last"]).alias("last"))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), start, step, lambda s: F.when(s["first"].isNotNull(), F.struct(s["first"].alias("start"), s["last"].alias("end"))))


def _replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """``text`` with each of ``spans``, which are in order and may overlap, replaced by ``by(span, end of those before)``."""

    def filled(held: Column) -> Column:
        before = largest_before(F.transform(held, lambda x: x["end"]))
        pieces = F.transform(F.arrays_zip(held.alias("x"), before.alias("at")), lambda z: F.concat(F.substring(text, z["at"] + 1, F.greatest(z["x"]["start"] - z["at"], F.lit(0))), by(z["x"], z["at"])))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.coalesce(F.array_max(F.transform(held, lambda x: x["end"])), F.lit(0)) + 1, F.char_length(text)))

    return once(spans, filled)


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with every character of ``spans`` replaced by a blank, so that places stay."""
    return F.when(F.size(spans) == 0, text).otherwise(_replaced(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)))))


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of high-entropy windows outside the spans of ``base`` and what the allow-list has.

    What is left of a run of key characters beside them is a candidate of its own if it is long enough.
    """
    def weigh(left: Column, s: Column) -> Column:
        value = F.substring(left, s["start"] + 1, s["end"] - s["start"])
        allowed = value.rlike("|".join(f"(?:{p})" for p in ALLOWED))
        limit = F.lit(99.0)
        for pattern, least in reversed(CLASSES):
            limit = F.when(value.rlike(pattern), F.lit(least)).otherwise(limit)
        found = F.when(~allowed, _window_span(value, limit))
        return F.struct((s["start"] + found["start"]).alias("start"), (s["start"] + found["end"]).alias("end"))

    def scan(left: Column) -> Column:
        return F.filter(F.transform(_places(left, CANDIDATE, None), lambda s: weigh(left, s)), lambda s: s["start"].isNotNull())

    def cleared(left: Column) -> Column:
        return F.when(left.rlike(HARMLESS), once(_blanked(left, _places(left, HARMLESS, None)), scan)).otherwise(scan(left))

    return F.when(text.rlike(CANDIDATE), once(_blanked(text, F.array_sort(base)), cleared)).otherwise(F.array().cast(SPAN))


def _listed(*kinds: tuple[str, Column]) -> Column:
    """kind:start:end of all spans by start, then in the order of kinds, comma-joined."""
    def named(order: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("text")))

    all_ = F.concat(*[named(i, kind, spans) for i, (kind, spans) in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(all_), lambda s: s["text"]), ",")


def with_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with columns __text (null as empty) and __assign, __access, __hex, __entropy (arrays of start, end)."""
    out = df.withColumn("__text", text_of(text_col))
    for kind in KINDS:
        out = out.withColumn(f"__{kind}", base_spans(F.col("__text"), kind))
    return out.withColumn("__entropy", entropy_spans(F.col("__text"), F.concat(*[F.col(f"__{k}") for k in KINDS])))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans for every row.

    Defined cases: null text counts as empty and has no spans; repeated rows a row
    each; null ids pass; an empty table gives an empty result; other columns are ignored.
    """
    found = with_spans(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = [(k, F.col(f"__{k}")) for k in KINDS]
    return found.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{k}") for k, c in base],
        F.size("__entropy").cast("long").alias("n_entropy"),
        F.sha2(_listed(*base).cast("binary"), 256).alias("base_sha256"),
        _listed(*base, ("entropy", F.col("__entropy"))).alias("spans"),
    )


def mask_secrets(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``df`` with every span replaced by ``MASK`` and, where there is such a column, the length brought up to date.

    Rows without spans keep text and length as they are (null text stays null).
    """
    found = with_spans(df)
    all_ = F.array_sort(F.concat(*[F.col(f"__{k}") for k in (*KINDS, "entropy")]))
    text = F.col("__text")

    masked = _replaced(text, all_, lambda s, at: F.when(s["start"] < at, "").otherwise(MASK))  # one mask for spans that overlap
    has = F.size(all_) > 0
    out = found.withColumn("__masked", F.when(has, masked)).withColumn(text_col, F.coalesce("__masked", text_col))
    if length_col in df.columns:
        out = out.withColumn(length_col, F.when(F.col("__masked").isNotNull(), F.char_length("__masked").cast(df.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*df.columns)
