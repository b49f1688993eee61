"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier on the presence of hashed byte n-grams learns from confirmed toxic texts and unlabelled ones.
The risk on negatives is estimated as the unlabelled risk less the class prior's share of the positives' risk, and
is not allowed to fall below zero. The cut between the two classes minimises the same corrected estimate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stabilis.llm.common import checkpointed, mixed, utf8_buffer, words_at

#: log2 of the number of hashed features; lengths of the byte n-grams (the seventh byte is the blank before a word).
FEATURE_BITS, GRAMS = 20, (5, 7)
#: Score from which a text is predicted toxic.
CUT = 0.3
#: Bytes that are hashed at a time.
_CHUNK = 1 << 18
#: ASCII letters are folded, other ASCII becomes a blank.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def _hashes(text: np.ndarray) -> np.ndarray:
    """Features of folded bytes, repeats included: one per place and n-gram length."""
    word = words_at(text)
    out = []
    for n in GRAMS:
        x = word[: len(text) - n + 1] if len(text) >= n else word[:0]
        x = x & np.uint64((1 << 8 * n) - 1)
        x ^= np.uint64(n << 60)
        out.append((mixed(x) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32))
    return np.concatenate(out)


def present(raw: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """Distinct features of a text with a blank before and after it. ``stamp`` is scratch of one integer per feature
    and needs no clearing."""
    text = np.concatenate([[np.uint8(32)], _FOLD[raw], [np.uint8(32)]])
    reach = max(GRAMS) - 1
    parts = []
    for a in range(0, len(text), _CHUNK):
        h = _hashes(text[a : a + _CHUNK + reach])
        order = np.arange(len(h), dtype=np.int32)
        stamp[h] = order
        parts.append(h[stamp[h] == order])
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


@dataclass
class ToxicityModel:
    columns: np.ndarray  # feature ids that count
    weights: np.ndarray  # one per such feature
    bias: float
    cut: float
    scale: float
    prior: float

    def table(self) -> np.ndarray:
        """A weight for every feature."""
        w = np.zeros(1 << FEATURE_BITS, np.float32)
        w[self.columns] = self.weights
        return w

    def score(self, logit: float) -> float:
        """0 to 1; exactly the cut of the class boundary maps to ``CUT``."""
        return float(1 / (1 + np.exp(-np.clip(self.scale * (logit - self.cut) + np.log(CUT / (1 - CUT)), -30, 30))))


def screened(counts: DataFrame, positives: int, unlabelled: int, most: int = 1500, least: int = 40, clearly: float = 2.7) -> np.ndarray:
    """The ``least`` to ``most`` features (h) whose shares of positives (p) and unlabelled texts (u) differ most clearly."""
    p, u = F.col("p") / positives, F.col("u") / unlabelled
    spread = p * (1 - p) / positives + u * (1 - u) / unlabelled + 1 / positives**2
    top = counts.select("h", (F.abs(p - u) / F.sqrt(spread)).alias("clear")).orderBy(F.desc("clear"), "h").limit(most).collect()
    return np.array(sorted(r["h"] for k, r in enumerate(top) if k < least or r["clear"] >= clearly), np.int64)


def nnpu(columns: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 200, rate: float = 0.05, decay: float = 1e-3) -> ToxicityModel:
    """Train by Adam on the non-negative risk with the logistic loss, full batch.

    xp and xu hold the presence of the features ``columns`` in positive and unlabelled texts. Without either kind the
    model has no feature and scores every text the same, below the cut.
    """
    if not len(xp) or not len(xu):
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 1.0, 5.0, prior)
    w, b = np.zeros(len(columns)), -1.0
    m, v, t = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1), 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(steps):
        narrow = w.astype(np.float32)  # a wide vector would widen the matrices
        fp, fu = xp @ narrow + b, xu @ narrow + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # derivative of each text's loss with respect to its logit
        dp_pos = -prior * sigmoid(-fp) / len(fp)
        dp_neg, du_neg = -prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
        if negative < 0:  # step back from the overfitted negative risk alone
            gp, gu = -dp_neg, -du_neg
        else:
            gp, gu = dp_pos + dp_neg, du_neg
        g = np.concatenate([xp.T @ gp.astype(np.float32) + xu.T @ gu.astype(np.float32) + decay * w * (negative >= 0), [gp.sum() + gu.sum()]])
        t += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    narrow = w.astype(np.float32)
    fp, fu = np.sort(xp @ narrow + b), np.sort(xu @ narrow + b)
    cuts = np.unique(np.concatenate([fp, fu]))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    missed = np.searchsorted(fp, cuts) / len(fp)
    alarms = 1 - np.searchsorted(fu, cuts) / len(fu) - prior * (1 - missed)
    risk = prior * missed + np.maximum(alarms, 0)
    best = np.flatnonzero(risk <= risk.min() + 0.01 * prior)  # the middle of the cuts that are about as good
    cut = float(cuts[best].mean()) if len(best) else 0.0
    above = fp[fp > cut]
    scale = 2.0 / max(float(np.median(above)) - cut, 1e-3) if len(above) else 1.0
    return ToxicityModel(columns, w.astype(np.float32), float(b), cut, float(scale), prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = 3000, unlabelled: int = 4000, seed: int = 1) -> ToxicityModel:
    """Fit on a bounded, hash-chosen sample: about ``positives`` confirmed toxic texts and ``unlabelled`` others.

    The class prior is the share of toxic rows among all labelled ones. Unlabelled texts are drawn from all documents,
    labelled or not, and their labels are not used. Labels that are null, or whose id is null, count as no label; if
    an id has several labels the largest counts. The sample (at most twice the two bounds of rows) is written once;
    counts of features and the presence of the chosen ones are made in tasks. The driver gets the chosen features
    and 188 bytes per text.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic"))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    joined = rows.select("_id").join(known, "_id")
    total, toxic = joined.agg(F.count(F.lit(1)), F.sum((F.col("_toxic") == 1).cast("long"))).first()
    count = docs.count()
    if not total or not toxic or not count:
        return nnpu(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros((0, 0)), 0.0)
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter((F.col("_toxic") == 1) & (draw(0) < min(1.0, positives / toxic))).select("_id", F.lit(True).alias("_positive"))
    confirmed = rows.join(F.broadcast(chosen.limit(2 * positives)), "_id").select("_positive", "_text").limit(2 * positives)
    others = rows.filter(draw(1) < min(1.0, unlabelled / count)).select(F.lit(False).alias("_positive"), "_text").limit(2 * unlabelled)
    sample = checkpointed(confirmed.unionAll(others).repartition(8, F.xxhash64("_text")))
    size = 1 << FEATURE_BITS

    def counted(batches):
        stamp, counts = np.zeros(size, np.int32), np.zeros((2, size), np.int32)
        for batch in batches:
            raw, off = utf8_buffer(batch.column(1))
            for i, positive in enumerate(batch.column(0).to_pylist()):
                counts[int(positive), present(raw[off[i] : off[i + 1]], stamp)] += 1
        at = np.flatnonzero(counts.any(0))
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.record_batch([pa.array(part), pa.array(counts[1, part].astype(np.int64)), pa.array(counts[0, part].astype(np.int64))], names=["h", "p", "u"])

    sizes = {r["_positive"]: r["count"] for r in sample.groupBy("_positive").count().collect()}
    np_, nu = sizes.get(True, 0), sizes.get(False, 0)
    if not np_ or not nu:
        return nnpu(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros((0, 0)), 0.0)
    counts = sample.mapInArrow(counted, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    columns = screened(counts, np_, nu)
    sent = docs.sparkSession.sparkContext.broadcast(columns)

    def packed(batches):
        stamp = np.zeros(size, np.int32)
        for batch in batches:
            raw, off = utf8_buffer(batch.column(1))
            data = [np.packbits(np.isin(sent.value, present(raw[off[i] : off[i + 1]], stamp))).tobytes() for i in range(len(batch))]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["positive", "x"])

    found: dict[bool, list] = {True: [], False: []}
    for r in sample.mapInArrow(packed, "positive boolean, x binary").collect():
        found[r["positive"]].append(bytes(r["x"]))
    matrix = {k: np.unpackbits(np.array([np.frombuffer(x, np.uint8) for x in sorted(v)]), axis=1)[:, : len(columns)].astype(np.float32) for k, v in found.items()}
    return nnpu(columns, matrix[True], matrix[False], toxic / total)


def classify(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The input's columns with score (0 to 1) and predicted (1 from ``CUT``) added or replaced.

    Every whole text is scored; null counts as empty, and empty texts get the score of no feature.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        m = sent.value
        w, stamp = m.table(), np.zeros(1 << FEATURE_BITS, np.int32)
        raw, off = utf8_buffer(texts)
        return pa.array([m.score(float(w[present(raw[a:b], stamp)].sum(dtype=np.float64)) + m.bias) for a, b in zip(off, off[1:])], pa.float64())

    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*rest, run(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the texts predicted toxic; null and empty texts stay."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    return classify(rows, model, "_text").filter(F.col("predicted") == 0).select("_row.*")
