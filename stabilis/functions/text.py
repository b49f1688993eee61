"""Text expressions: words, sentences, n-grams, lexical diversity, cleaning, seeds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode words: letters, digits and underscores.
WORD = r"[\p{L}\p{N}_]+"
#: Tokens of the vector-space model have at least two such characters.
TERM = r"[\p{L}\p{N}_]{2,}"
#: Four reorderings of an eight-sentence text: positions of the sentences, from one.
ORDERS = {
    "keep_same": [1, 2, 3, 4, 5, 6, 7, 8],
    "intro_conc_swap": [8, 2, 3, 4, 5, 6, 7, 1],
    "adjacent_swap": [2, 1, 4, 3, 6, 5, 8, 7],
    "reverse": [8, 7, 6, 5, 4, 3, 2, 1],
}


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased words in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Pieces after ., ! or ? with white space, or at line breaks; blank pieces are dropped."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(pieces, stripped), lambda s: s != "")


def flat_sentences(text: Column) -> Column:
    """Sentences of a text whose white space is collapsed first, so that line breaks do not end one."""
    flat = stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: stripped(s) != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), stripped), lambda p: p != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined windows of n tokens; none if there are fewer."""
    return bound(tokens, lambda t: _ngrams(t, n))


def _ngrams(tokens: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def mattr(tokens: Column, window: int = 25) -> Column:
    """Mean type-token ratio of all windows; of the whole text if it is not longer; 0 if it is empty."""
    if window < 1:
        raise ValueError("window must be at least 1")
    return bound(tokens, lambda t: _mattr(t, window))


def _mattr(tokens: Column, window: int) -> Column:
    """The types of all windows are counted token by token: a token counts in the windows that hold it, but not the
    token before it of the same type; only the window's reach is searched for that."""
    n = F.size(tokens)

    def windows(token: Column, at: Column) -> Column:
        reach = F.reverse(F.slice(tokens, F.greatest(at - (window - 2), F.lit(1)), F.least(at, F.lit(window - 1))))
        since = F.array_position(reach, token).cast("int")  # distance to the token before, 0 if out of reach
        first = F.greatest(F.lit(0), at - (window - 1), F.when(since > 0, at - since + 1).otherwise(0))
        return F.greatest(F.lit(0), F.least(at, n - window) - first + 1)

    total = F.aggregate(F.transform(tokens, windows), F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        F.when(n == 0, 0.0)
        .when(n <= window, F.size(F.array_distinct(tokens)) / n)
        .otherwise(total / ((n - (window - 1)) * F.lit(float(window))))
    )


def mtld_of(tokens, threshold: float = 0.72) -> float:
    """Mean of the forward and backward number of words per factor; a factor ends when the ratio of types falls to
    the threshold, and what is left counts by how far it has fallen. Without any factor: the number of words."""

    def one_way(sequence) -> float:
        types, size, factors = set(), 0, 0.0
        for token in sequence:
            types.add(token)
            size += 1
            if len(types) / size <= threshold:
                types, size, factors = set(), 0, factors + 1
        if size:
            factors += (1 - len(types) / size) / (1 - threshold)
        return len(sequence) / factors if factors else float(len(sequence))

    tokens = [] if tokens is None else list(tokens)
    return (one_way(tokens) + one_way(tokens[::-1])) / 2 if tokens else 0.0


def mtld(tokens: Column) -> Column:
    """``mtld_of`` per row: a fold with resets, linear in the text, which array expressions would make quadratic."""

    @F.pandas_udf("double")
    def fold(rows: pd.Series) -> pd.Series:
        return rows.map(mtld_of)

    return fold(tokens)


def ratio_similarity(a: Column, b: Column) -> Column:
    """1 - |a - b| / max, and 0 where the maximum is 0."""
    return F.coalesce(1 - F.try_divide(F.abs(a - b), F.greatest(a, b)), F.lit(0.0))


def without_thoughts(text: Column) -> Column:
    """Drop <think> blocks, then stray tags, then outer blanks."""
    return stripped(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"</?think>", ""))


def flattened_json(text: Column, fields: list[str]) -> Column:
    """Stripped required string fields joined by blank lines; null where one is missing or not a string."""
    parsed = F.try_parse_json(text)
    value = lambda f: F.try_variant_get(parsed, f"$['{f}']", "variant")
    parts = [F.when(F.schema_of_variant(value(f)) == "STRING", stripped(F.try_variant_get(parsed, f"$['{f}']", "string"))) for f in fields]
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.isNotNull()
    return F.when(ok, F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n\n"))


def reordered(sents: Column, order: str) -> Column:
    """An eight-sentence array in one of ``ORDERS``; null if it has another length."""
    return F.when(F.size(sents) == 8, F.array(*[F.element_at(sents, i) for i in ORDERS[order]]))


def json_ascii(text: Column) -> Column:
    """A JSON string of ASCII characters: others as escapes of their UTF-16 units."""
    unit = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))
    short = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "000C": "\\f", "000A": "\\n", "000D": "\\r", "0009": "\\t"}

    def escaped(u: Column) -> Column:
        found = F.when((u >= "0020") & (u <= "007E"), F.decode(F.unhex(F.substring(u, 3, 2)), "UTF-8")).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
        for code, shown in short.items():
            found = F.when(u == code, F.lit(shown)).otherwise(found)
        return found

    return F.concat(F.lit('"'), F.array_join(F.transform(unit, escaped), ""), F.lit('"'))


def derived_seed(seed: int, essay: Column, prompt: Column, index: Column) -> Column:
    """The first four bytes of SHA-256 over the JSON list [seed, essay, prompt, index], as Python writes it."""
    text = F.concat(F.lit(f"[{json.dumps(seed)}, "), json_ascii(essay), F.lit(", "), json_ascii(prompt), F.lit(", "), index.cast("string"), F.lit("]"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def short_name(path: Column) -> Column:
    """File stem without its first two underscore-separated parts."""
    stem = F.regexp_replace(path, r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 3, 1 << 20), "_")).otherwise(stem)


def fixed(x: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", x)


def english_word_count(text: Column) -> Column:
    """Words with inner hyphens or apostrophes counted once."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*")), F.lit(0))
