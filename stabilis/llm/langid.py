"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one linear classifier per bit predicts it from hashed byte n-grams. Decoding
weighs the losses of the bits by how well each classifier does on that language, picks the codeword with the least
loss and flags texts whose two nearest codewords are close.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stabilis.llm.common import keyed, mixed, utf8_buffer, words_at

#: Undetermined: null texts and texts without a letter.
UNDETERMINED = "und"
#: log2 of the number of hashed features; lengths of the byte n-grams.
FEATURE_BITS, GRAMS = 13, (2, 3, 4)
#: Bytes that are hashed at a time.
_CHUNK = 1 << 20

def codewords(classes: int, seed: int = 0) -> np.ndarray:
    """A row of -1 and 1 per class: all dichotomies for up to five classes, else the best of seeded random codes."""
    if classes <= 1:
        return np.ones((classes, 1), np.float32)
    if classes <= 5:
        length = 2 ** (classes - 1) - 1
        bits = (np.arange(1, length + 1)[None, :] >> np.arange(classes)[::-1][:, None]) & 1
        return (2.0 * bits - 1).astype(np.float32)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (classes, length))
        gaps = (length - code @ code.T) / 2
        least = gaps[~np.eye(classes, dtype=bool)].min()
        if least > apart and (np.abs(code.sum(0)) < classes).all():
            best, apart = code, least
    return best


def _hashes(raw: np.ndarray) -> np.ndarray:
    """Feature of each n-gram at each byte (row per n); ASCII case is folded, runs of non-letters are not."""
    word = words_at(raw)
    shift = np.uint64(64 - FEATURE_BITS)
    out = np.empty((len(GRAMS), len(raw)), np.int64)
    for k, n in enumerate(GRAMS):
        x = word & np.uint64((1 << 8 * n) - 1)
        x ^= np.uint64(n << 56)
        out[k] = (mixed(x) >> shift).astype(np.int64)
    return out


#: Byte classes: ASCII capitals become small, ASCII that is no letter becomes a blank.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def features(raw: np.ndarray) -> np.ndarray:
    """L2-normalised square roots of a text's n-gram counts."""
    counts = np.zeros(1 << FEATURE_BITS)
    folded = _FOLD[raw]
    reach = max(GRAMS) - 1
    for a in range(0, len(folded), _CHUNK):
        part = folded[a : a + _CHUNK + reach]
        for n, row in zip(GRAMS, _hashes(part)):
            end = min(_CHUNK, len(folded) - a - n + 1)
            if end > 0:
                counts += np.bincount(row[:end], minlength=len(counts))
    x = np.sqrt(counts)
    norm = np.linalg.norm(x)
    return (x / norm if norm else x).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    trust: np.ndarray  # languages x bits; each row sums to one

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted hinge loss of each codeword; x has a row per text."""
        margins = np.clip(x @ self.weights, -1, 1)
        loss = (1 - margins[:, None, :] * self.code[None, :, :]) / 2
        return (loss * self.trust[None, :, :]).sum(2)


def train(rows: list[tuple[str, bytes]], ridge: float = 0.02) -> LanguageModel:
    """Fit a ridge classifier per bit in its dual form; trust comes from leave-one-out predictions."""
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return LanguageModel([], np.ones((0, 1), np.float32), np.zeros((1 << FEATURE_BITS, 1), np.float32), np.ones((0, 1)))
    x = np.stack([np.frombuffer(data, np.float16).astype(np.float32) for _, data in rows])
    y = np.array([languages.index(lang) for lang, _ in rows])
    code = codewords(len(languages))
    share = np.bincount(y, minlength=len(languages))[y] * len(languages) / len(y)
    gram = (x @ x.T).astype(np.float64) + ridge * np.diag(share)  # rarer languages are fitted more closely
    inverse = np.linalg.inv(gram)
    alpha = inverse @ code[y]
    left_out = code[y] - alpha / np.diag(inverse)[:, None]
    right = (np.sign(left_out) == code[y]).astype(float)
    hits = np.stack([right[y == k].mean(0) for k in range(len(languages))]) + 1e-3
    return LanguageModel(languages, code, (x.T @ alpha).astype(np.float32), hits / hits.sum(1, keepdims=True))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = 2400, seed: int = 1) -> LanguageModel:
    """Fit on a bounded sample: about ``texts`` distinct texts in all (hash-chosen), as many of every language.

    Every language can be predicted: one that would get no text gets one at least. What reaches the driver is about
    ``texts`` feature vectors of 16 KB (or one per language, if there are more languages), and the classifiers of all
    bits come from one matrix of that many rows. Rows with a null language or text are not used; with no usable row
    the model has no language.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    draw = F.pmod(F.xxhash64(F.lit(seed), text_col), F.lit(1 << 30))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least")).orderBy("lang").collect()
    if not counts:
        return train([])
    each = max(1, texts // len(counts))
    # a language's texts up to this draw, its own least one in any case
    upto = {r["lang"]: max(r["least"], int(min(1.0, each / r["n"]) * (1 << 30))) for r in counts}
    limits = F.create_map(*[F.lit(x) for pair in upto.items() for x in pair])

    def vectors(batches):
        for batch in batches:
            raw, off = utf8_buffer(batch.column(1))
            data = [features(raw[off[i] : off[i + 1]]).astype(np.float16).tobytes() for i in range(len(batch))]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["lang", "x"])

    sample = (
        rows.filter(draw <= limits[F.col(lang_col)])
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .distinct()
        .mapInArrow(vectors, "lang string, x binary")
        .collect()
    )
    return train(sorted((r["lang"], bytes(r["x"])) for r in sample))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", margin: float = 0.05) -> DataFrame:
    """The input's columns with lang_pred, score and ambiguous added (columns of these names are replaced).

    Every whole text is read. ``score`` (0 to 1) is the share of the nearest codeword in exp(-loss) of the two
    nearest, stretched; ``ambiguous`` marks a loss difference under ``margin``. Null texts and texts without a letter
    get ``und`` with score 0, as does every text when the model has no language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def run(texts):
        import pandas as pd

        m = sent.value
        out = []
        for text in texts:
            if text is None or not m.languages or not any(map(str.isalpha, text)):
                out.append((UNDETERMINED, 0.0, False))
                continue
            loss = m.losses(features(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))[None, :])[0]
            order = np.argsort(loss, kind="stable")
            gap = float(loss[order[1]] - loss[order[0]]) if len(order) > 1 else 1.0
            out.append((m.languages[order[0]], float(1 / (1 + np.exp(-12 * gap))), gap < margin))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    names = ["lang_pred", "score", "ambiguous"]
    rest = [c for c in docs.columns if c not in names]
    rows = keyed(docs, text=F.col(text_col)).select("row", run(F.col("text")).alias("found"))
    return rows.select(*[F.col(f"row.`{c}`") for c in rest], *[F.col(f"found.{n}") for n in names])
