"""Secret scans in DataFrame functions: fixed formats, and sliding-window Shannon entropy.

Matches and their offsets come from two passes of one pattern: what it matches and what lies between.
For each character class, candidate strings are slid over with a window whose symbol counts are kept
incrementally: a step changes two counts and the sum of c * log2(c) that entropy follows from.  The hot
windows of a candidate form one span, unless the allow-list recognises the candidate.  Candidates hold a digit:
runs of letters alone are words far more often than secrets, and a random token of 20 letters and digits has none
by a chance of 3 % (32: 0.4 %).  Everything is inside the row, so there is no shuffle.

Offsets are code points, ends exclusive.  Null and empty texts have no spans; repeated rows get equal
spans; ties (equal starts) follow the order of kinds; extra columns stay, but for those that have the name of a
new one, which `scan` replaces and `redact` keeps; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.staging import fresh

#: Formats found by pattern alone.  The group that `least` measures is the third field.
FORMATS = {
    "assign": (
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Runs of one class of which every shorter one fails, so that the pattern may ask for the length itself.
_LONG = {"access": r"AKIA[A-Z0-9]{12,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+"}

#: class: (alphabet, least entropy in bits)
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 2.8),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.5),
}
WINDOW = 20
RUN = 256  # matches that are appended one by one

#: Candidates that are no secrets: identifiers, numbers and dates, placeholders.
ALLOWED = [
    r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"^[0-9+/_=-]+$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx",
    r"(?i)0123456789|abcdefghij",
]

SPAN = "struct<kind:string,start:int,end:int>"


def _at(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of a pattern's leftmost non-overlapping matches."""
    return F.zip_with(
        F.split(text, pattern),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda between, value: F.struct(F.length(between).alias("before"), value.alias("value")),
    )


def _starts(column: str) -> Column:
    """The same with each match's start: a running sum of what lies before it."""
    kind = "array<struct<start:int,value:string>>"
    pieces = F.filter(F.col(column), lambda x: x["value"].isNotNull())
    empty = F.array().cast(kind)

    def add(a: Column, x: Column) -> Column:
        start = (a["at"] + x["before"]).alias("start")
        one = F.array(F.struct(start, x["value"].alias("value")))
        return F.struct(
            (a["at"] + x["before"] + F.length(x["value"])).alias("at"), F.concat(a["out"], one).alias("out")
        )

    def add_block(a: Column, low: Column) -> Column:
        begin = F.struct(a["at"].alias("at"), empty.alias("out"))
        done = F.aggregate(F.slice(F.col(column), low, RUN), begin, add)
        return F.struct(done["at"].alias("at"), F.concat(a["out"], F.array(done["out"])).alias("out"))

    few = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), add)["out"]
    # appending copies an array, so long lists are put together from blocks; the last piece has no match
    many = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(column) - 1, F.lit(1)), F.lit(RUN)),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
        add_block,
    )["out"]
    many = F.filter(F.flatten(many), lambda x: x["value"].isNotNull())
    return F.when(F.size(pieces) == 0, empty).when(F.size(pieces) <= RUN, few).otherwise(many)


def _c_log_c(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def hot_span(value: Column, alphabet: str, least: float, window: int = WINDOW) -> Column:
    """struct<low, high> of the windows of a string with at least that entropy; null without any."""
    codes = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(alphabet), ch))
    bound = window * (F.log2(F.lit(float(window))) - least)  # entropy >= least: sum of c * log2(c) <= bound

    def counted(codes: Column) -> Column:
        first = F.slice(codes, 1, window)
        return F.transform(
            F.sequence(F.lit(1), F.lit(len(alphabet))),
            lambda k: F.size(F.filter(first, lambda c: c == k)),
        )

    def start(codes: Column) -> Column:
        counts = counted(codes)
        total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + _c_log_c(c))
        return F.struct(
            counts.alias("counts"),
            total.alias("total"),
            F.when(total <= bound, F.lit(0)).alias("low"),
            F.when(total <= bound, F.lit(window)).alias("high"),
        )

    def step(a: Column, i: Column, codes: Column) -> Column:
        out, new = F.get(codes, i - 1), F.get(codes, i + window - 1)
        less, more = F.get(a["counts"], out - 1), F.get(a["counts"], new - 1)
        change = _c_log_c(less - 1) - _c_log_c(less) + _c_log_c(more + 1) - _c_log_c(more)
        total = a["total"] + F.when(out == new, F.lit(0.0)).otherwise(change)
        hot = total <= bound + 1e-9
        return F.struct(
            F.transform(
                a["counts"], lambda c, k: c + (k == new - 1).cast("int") - (k == out - 1).cast("int")
            ).alias("counts"),
            total.alias("total"),
            F.coalesce(a["low"], F.when(hot, i)).alias("low"),
            F.when(hot, i + window).otherwise(a["high"]).alias("high"),
        )

    steps = F.when(F.length(value) > window, F.sequence(F.lit(1), F.length(value) - window)).otherwise(
        F.array().cast("array<int>")
    )
    # a lambda over a one-element array names the codes, which are computed once for a candidate
    found = F.transform(
        F.array(codes),
        lambda c: F.aggregate(
            steps, start(c), lambda a, i: step(a, i, c), lambda a: F.struct(a["low"].alias("low"), a["high"].alias("high"))
        ),
    )
    return F.get(found, F.lit(0))


def _hot(kind: str, span, alphabet: str, least: float) -> Column:
    """The hot spans of a class's candidates that no allow-list entry recognises."""

    def place(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), hot_span(x["value"], alphabet, least).alias("hot"))

    listed = F.filter(F.col(f"_{kind}"), lambda x: ~_any_of(x["value"], ALLOWED))
    hot = F.filter(F.transform(listed, place), lambda x: x["hot"]["low"].isNotNull())
    return F.transform(hot, lambda x: span(kind, x["start"] + x["hot"]["low"], x["start"] + x["hot"]["high"]))


def scan(df: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """The given columns and two more, the base spans and all spans: array<SPAN> by start and kind."""
    kinds = [*FORMATS, *CLASSES]
    kept = {f"_own_{i}": c for i, c in enumerate(df.columns) if c.lower() not in (base.lower(), spans.lower())}
    df = df.select(*[F.col(f"`{c}`").alias(k) for k, c in kept.items()], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    pieces = {f"_{k}": _at(F.col("_t"), _LONG.get(k, p)) for k, (p, _, _) in FORMATS.items()}
    pieces["_values"] = F.regexp_extract_all(F.col("_t"), F.lit(FORMATS["assign"][0]), F.lit(FORMATS["assign"][1]))
    for kind, (alphabet, _) in CLASSES.items():
        letters = "[" + alphabet.replace("-", r"\-") + "]"
        pieces[f"_{kind}"] = _at(F.col("_t"), rf"(?<!{letters})(?={letters}*?[0-9]){letters}{{{WINDOW},}}+")
    df = df.withColumns(pieces).drop("_t")
    df = df.withColumns({f"_{k}": _starts(f"_{k}") for k in kinds})

    def span(kind: str, low: Column, high: Column) -> Column:
        return F.struct(
            low.cast("int").alias("start"), F.lit(kinds.index(kind)).alias("rank"), high.cast("int").alias("end"),
            F.lit(kind).alias("kind"),
        )

    def matched(kind: str) -> Column:
        return F.transform(
            F.col(f"_{kind}"), lambda x: span(kind, x["start"], x["start"] + F.length(x["value"]))
        )

    found = {k: matched(k) for k in _LONG}
    valued = F.zip_with(
        "_assign",
        "_values",
        lambda x, v: F.struct(x["start"].alias("start"), x["value"].alias("value"), v.alias("v")),
    )
    found["assign"] = F.transform(
        F.filter(valued, lambda x: F.length(x["v"]) >= FORMATS["assign"][2]),
        lambda x: span("assign", x["start"], x["start"] + F.length(x["value"])),
    )
    found |= {kind: _hot(kind, span, alphabet, least) for kind, (alphabet, least) in CLASSES.items()}
    df = df.withColumns({f"_{k}": v for k, v in found.items()}).drop("_values")
    df = df.withColumn("_base", F.array_sort(F.concat(*[F.col(f"_{k}") for k in FORMATS])))
    every = F.array_sort(F.concat(F.col("_base"), *[F.col(f"_{k}") for k in CLASSES]))
    return df.select(*[F.col(k).alias(c) for k, c in kept.items()], F.col("_base").alias(base), every.alias(spans))


def _any_of(value: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(df: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The text with every span replaced by a mask; overlapping spans count as one."""
    names, (base, spans, cut) = df.columns, (fresh(df, c) for c in ("_base", "_spans", "_cut"))
    df = scan(df, text, base, spans)
    merged = F.aggregate(
        F.col(spans),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (x["start"] <= F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(-1))),
            F.concat(
                F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
                F.array(F.struct(
                    F.get(a, F.size(a) - 1)["start"].alias("start"),
                    F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(a, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    df = df.withColumn(cut, merged)
    pieces = F.transform(
        F.col(cut),
        lambda x, i: F.concat(
            F.substring(F.col(text), F.coalesce(F.get(F.col(cut), i - F.lit(1))["end"], F.lit(0)) + 1,
                        x["start"] - F.coalesce(F.get(F.col(cut), i - F.lit(1))["end"], F.lit(0))),
            F.lit(mask),
        ),
    )
    rest = F.substring(F.col(text), F.get(F.col(cut), F.size(cut) - 1)["end"] + 1, F.length(text))
    masked = F.when(F.size(cut) == 0, F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return df.withColumn(text, masked).select(*[F.col(f"`{c}`") for c in names])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def n(kind: str) -> Column:
        return F.size(F.filter(F.col("base"), lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(documents).select(
        "doc_id",
        *[n(k) for k in FORMATS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
