"""Secret scans with multipart credential linking, in native expressions only.

Strong patterns are reported wherever they occur. Weak candidates (bare key ids, 40-character keys, endpoints) are
reported only where their complementary parts start within ``scope`` characters of them in the same text. That is an
interval join on bins of ``scope`` characters: a candidate meets three bins, and each bin brings only the first and
last start of each part, so no pairs are listed however many parts a text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stabilis.llm.common import checkpointed

#: Kinds in the order in which equal starts are listed: pattern, and the class of credential part they are. Fixed values.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret"),
    "access": (r"AKIA[A-Z0-9]{14,}", "access"),
    "hex": (r"[0-9a-f]{16,}", "secret"),
    "key_id": (r"[A-Z0-9]{16,}", "access"),
    "key": (r"[A-Za-z0-9/+]{40,}", "secret"),
    "endpoint": (r"https?://[A-Za-z0-9.:-]+[A-Za-z0-9/_.~-]*", "endpoint"),
}
STRONG = ("assign", "access", "hex")
#: Classes that must start near a weak candidate for it to count.
NEEDS = {"key_id": ("secret",), "key": ("access",), "endpoint": ("access", "secret")}
#: Characters between the starts of parts that belong together.
SCOPE = 400
_SPAN = "array<struct<start: int, ord: int, stop: int>>"


def _accepted(kind: str, match: Column, value: Column | None) -> Column | None:
    """The condition on a match beyond its pattern."""
    if kind == "assign":
        return F.length(value) >= 12
    if kind == "key_id":
        return match.rlike("[0-9]") & match.rlike("[A-Z]") & ~match.startswith("AKIA") & (F.length(match) < 40)
    if kind == "key":
        return F.length(match) == 40
    return None


def scanned(values: Column, join, back: bool = False) -> Column:
    """Each value joined with all before it (or, ``back``, all after it). Distances double, so the work is n log n."""

    def step(acc, _):
        other = lambda i: F.get(acc["a"], i + acc["d"] if back else i - acc["d"])
        return F.struct(F.transform(acc["a"], lambda x, i: join(x, other(i))).alias("a"), (acc["d"] * 2).alias("d"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)).cast("double"))).cast("int"))
    return F.aggregate(rounds, F.struct(values.alias("a"), F.lit(1).alias("d")), step, lambda acc: acc["a"])


def spans(text: Column, kind: str) -> Column:
    """Start and stop (code points, stop exclusive) of the kind's leftmost non-overlapping matches that count.

    The pieces between matches come from splitting at the same pattern; their lengths and the matches' add up to
    the positions.
    """
    pattern = KINDS[kind][0]
    order = list(KINDS).index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else matches

    def measured(row):
        accepted = _accepted(kind, row["match"], row["value"])
        keep = row["match"].isNotNull() if accepted is None else F.coalesce(accepted, F.lit(False))
        size = F.coalesce(F.length(row["match"]), F.lit(0))
        return F.struct((F.length(row["gap"]) + size).alias("step"), size.alias("size"), keep.alias("keep"))

    def placed(rows):
        stops = scanned(F.transform(rows, lambda r: r["step"]), lambda x, y: x + F.coalesce(y, F.lit(0)))
        both = F.filter(F.arrays_zip(rows.alias("r"), stops.alias("stop")), lambda z: z["r"]["keep"])
        return F.transform(both, lambda z: F.struct((z["stop"] - z["r"]["size"]).alias("start"), F.lit(order).alias("ord"), z["stop"].alias("stop")))

    rows = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), values.alias("value")), measured)
    # (bound once, as a one element array)
    found = F.flatten(F.transform(F.array(rows), placed))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def apart(strong: Column, weak: Column) -> Column:
    """The weak spans that overlap no strong one. In the order of starts, a span overlaps if a strong one before it ends
    later than it starts, or a strong one after it starts before it ends."""
    mark = lambda spans, flag: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(flag).alias("weak"), s["ord"].alias("ord"), s["stop"].alias("stop")))

    def cleared(rows):
        last = scanned(F.transform(rows, lambda r: F.when(r["weak"] == 0, r["stop"]).otherwise(-1)), F.greatest)
        following = scanned(F.transform(rows, lambda r: F.when(r["weak"] == 0, r["start"]).otherwise((1 << 31) - 1)), F.least, back=True)
        clear = lambda z: (z["r"]["weak"] == 1) & (z["last"] <= z["r"]["start"]) & (z["following"] >= z["r"]["stop"])
        return F.transform(F.filter(F.arrays_zip(rows.alias("r"), last.alias("last"), following.alias("following")), clear), lambda z: F.struct(z["r"]["start"].alias("start"), z["r"]["ord"].alias("ord"), z["r"]["stop"].alias("stop")))

    both = F.array_sort(F.concat(mark(strong, 0), mark(weak, 1)))
    found = F.flatten(F.transform(F.array(both), cleared))
    return F.when((F.size(strong) > 0) & (F.size(weak) > 0), found).otherwise(weak)


def listed(parts: Column) -> Column:
    """kind:start:stop of spans by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(parts), lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"], s["stop"])), ",")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates whose complementary parts co-occur; parts and result have uid, ord, start, stop."""
    kinds = list(KINDS)
    classes = F.element_at(F.array(*[F.lit(KINDS[k][1]) for k in kinds]), F.col("ord") + 1)
    parts = parts.withColumn("class", classes).withColumn("bin", F.floor(F.col("start") / scope))
    bins = parts.groupBy("uid", "bin", "class").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    weak = parts.filter(F.col("ord") >= len(STRONG)).select("uid", "ord", "start", "stop", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"))
    near = weak.join(bins, ["uid", "bin"]).filter((F.abs(F.col("low") - F.col("start")) <= scope) | (F.abs(F.col("high") - F.col("start")) <= scope))
    have = near.groupBy("uid", "ord", "start", "stop").agg(F.collect_set("class").alias("have"))
    enough = F.lit(False)
    for kind, needs in NEEDS.items():
        hit = F.col("ord") == kinds.index(kind)
        for c in needs:
            hit = hit & F.array_contains("have", c)
        enough = enough | hit
    return have.filter(enough).drop("have")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256 (of the strong spans) and spans (strong and linked ones).

    Null text counts as empty and has no span. Rows are told apart by their own row number, so repeated rows and null
    ids each get their result. Weak candidates that overlap a strong span are part of it and not listed. Texts are read
    once; only spans are written to the checkpoint folder and joined. The work on a text's m matches grows as m log m.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), *[spans(text, k).alias(k) for k in KINDS]
    )
    found = found.select("id", "uid", *STRONG, F.concat(*STRONG).alias("strong"), F.concat(*[k for k in KINDS if k not in STRONG]).alias("weak"))
    found = checkpointed(found.select("id", "uid", *[F.size(k).cast("long").alias(f"n_{k}") for k in STRONG], "strong", apart(F.col("strong"), F.col("weak")).alias("weak")))
    parts = found.filter(F.size("weak") > 0).select("uid", F.explode(F.concat("strong", "weak")).alias("s")).select("uid", "s.*")
    extra = linked(parts, scope).groupBy("uid").agg(F.collect_list(F.struct("start", "ord", "stop")).alias("extra"))
    return found.join(extra, "uid", "left").select(
        F.col("id").alias(id_col),
        *[f"n_{k}" for k in STRONG],
        F.sha2(listed(F.col("strong")), 256).alias("base_sha256"),
        listed(F.concat("strong", F.coalesce("extra", F.array().cast(_SPAN)))).alias("spans"),
    )
