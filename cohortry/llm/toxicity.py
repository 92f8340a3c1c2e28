"""Toxicity by multiple-instance learning: a document is toxic if some sentence is (noisy-or)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Labelled documents of each class that the model is fitted on, at most (in expectation: a hash of the id decides).
TRAIN_DOCS = 3_000
#: Features kept: those that tell toxic documents best by the likelihood ratio.
FEATURES = 2_000
#: A feature must occur in so many toxic documents of the sample, and in this share of them.
LEAST_DOCS, LEAST_SHARE = 3, 0.01
#: Besides itself a word counts as its openings of these many characters.
OPENINGS = (4, 5, 6, 7)
ROUNDS = 400
RATE = 0.1
RIDGE = 2e-5
#: Words whose weight a worker remembers.
CACHE_WORDS = 150_000

_SENTENCE = re.compile(rb"[^.!?\n]+")
#: The same where full-width ends occur: their bytes end a sentence too.
_WIDE_ENDS = ("\u3002".encode(), "\uff01".encode(), "\uff1f".encode())
_WIDE_SENTENCE = re.compile(b"|".join(_WIDE_ENDS) + rb"|((?:(?!" + b"|".join(_WIDE_ENDS) + rb")[^.!?\n])+)")
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(word: bytes) -> list[str]:
    """A word and its openings; openings are marked so that they differ from whole words."""
    w = word.decode(errors="replace").lower()
    return [w, *(w[:n] + "*" for n in OPENINGS if len(w) >= n)]


def sentences(text: str | None) -> Iterator[tuple[int, int, list[bytes]]]:
    """Byte ranges and words of a text's sentences, which full stops, ?, ! (also full-width ones) and line ends part; those without words are left out."""
    data = (text or "").encode()
    wide = any(e in data for e in _WIDE_ENDS)
    for m in (_WIDE_SENTENCE if wide else _SENTENCE).finditer(data):
        words = (m.group(1) or b"" if wide else m.group()).translate(_WORDS).split()
        if words:
            yield m.start(), m.end(), words


@dataclass
class ToxicityModel:
    """Weights of features and the bias of a sentence's logit."""

    weights: dict[str, float]
    bias: float
    known: dict[bytes, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def word(self, word: bytes) -> float:
        w = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self.known) < CACHE_WORDS:
            self.known[word] = w
        return w

    def score(self, text: str | None, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and byte range and score of each sentence that scores ``least`` or more.

        A text without words scores as one empty sentence.
        """
        get, word = self.known.get, self.word
        rest = _softplus(self.bias)
        total, found, n = 0.0, [], 0
        for i, j, words in sentences(text):
            n += 1
            z = 0.0
            for w in words:
                x = get(w)
                z += word(w) if x is None else x
            if z:
                z += self.bias
                total += _softplus(z)
                p = _sigmoid(z)
                if p >= least:
                    found.append((i, j, p))
            else:
                total += rest
        return -math.expm1(-(total if n else rest)), found


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(id_col) -> F.Column:
    """Rows never trained on: CRC-32 of the id as text leaves 0 by 5 (a null id counts as empty text: held out)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _fit(bags: list[tuple[int, float, list[list[int]], int]], n_features: int):
    """Weights and bias that make the noisy-or of the sentence scores likeliest, by Adam over the whole sample.

    ``bags``: label, weight, feature numbers of each sentence that has any, and the number of other sentences.
    """
    import numpy as np

    y = np.array([b[0] for b in bags], float)
    share = np.array([b[1] for b in bags], float)
    share /= share.sum()
    bare = np.array([b[3] for b in bags], float)
    of_bag = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    sizes = [len(s) for b in bags for s in b[2]]
    of_sentence = np.repeat(np.arange(len(sizes)), sizes)
    ids = np.array([f for b in bags for s in b[2] for f in s], np.int64)
    rate = float((share * y).sum())
    per = max(1.0, float((share * (bare + np.bincount(of_bag, minlength=len(bags)))).sum()))
    w, b = np.zeros(n_features), math.log(max(rate, 1e-4) / per)
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, ROUNDS + 1):
        z = b + np.bincount(of_sentence, weights=w[ids], minlength=len(sizes))
        z = np.clip(z, -40, 40)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-b))
        off = np.bincount(of_bag, weights=np.logaddexp(0, z), minlength=len(bags)) + bare * math.log1p(math.exp(b))
        # d(-log likelihood)/dz is p for a clean document and -p (1 - P) / P for a toxic one.
        pull = np.where(y > 0, -1 / np.expm1(np.minimum(off, 500).clip(1e-9)), 1.0) * share
        dz = p * pull[of_bag]
        grad = np.append(np.bincount(ids, weights=dz[of_sentence], minlength=n_features) + RIDGE * w, dz.sum() + (bare * p0 * pull).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= float(move[-1])
    return w, b


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on at most about ``train_docs`` labelled documents of each class outside the held-out fifth.

    Labels join by id; of several labels of an id the highest counts, null labels and ids are
    left out.  Features are counted and selected in Spark; what reaches the driver is bounded by
    ``train_docs`` documents as numbers of at most FEATURES features.  Without toxic labels the model is the bias alone.
    """
    docs = small_batches(docs)
    y = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .where(~held_out(F.col("id")))
    )
    n = {r["y"]: r["n"] for r in y.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, train_docs / n[k]) if n.get(k) else 0.0 for k in (0, 1)}
    if not n.get(1):
        return ToxicityModel({}, math.log(1e-3 if n.get(0) else 1.0))
    draw = (F.xxhash64("id", F.lit("toxicity")).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    sample = y.select("id", (F.col("y") > 0).cast("int").alias("y")).where(draw < F.when(F.col("y") > 0, share[1]).otherwise(share[0]))
    # About 2 * train_docs rows of 12 bytes: small by the bound above.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for b in batches:
            for label, t in zip(b.column(1).to_pylist(), b.column(2)):
                words = {w for _, _, ws in sentences(t.as_py()) for w in ws}
                (pos if label else neg).update({f for w in words for f in features(w)})
        names = list(pos)  # features of clean documents only are of no use
        yield pa.RecordBatch.from_arrays(
            [pa.array(names + [f for f in neg if f not in pos], pa.string()), pa.array([pos[f] for f in names] + [0] * sum(f not in pos for f in neg), pa.int64()), pa.array([neg[f] for f in names] + [c for f, c in neg.items() if f not in pos], pa.int64())],
            names=["f", "p", "q"],
        )

    P, Q = float(n[1] * share[1]), float(max(1.0, n.get(0, 0) * share[0]))
    counted = texts.mapInArrow(tidy(count), "f string, p long, q long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    p, q = F.col("p"), F.col("q")
    both = (p + q) / (P + Q)
    gain = p * F.log(p / P / both) + F.when(q > 0, q * F.log(q / Q / both)).otherwise(0.0)
    best = counted.where((p >= max(LEAST_DOCS, LEAST_SHARE * P)) & (p / P > q / Q)).orderBy(F.desc(gain), "f").limit(FEATURES).select("f").collect()
    numbers = {r["f"]: i for i, r in enumerate(sorted(best))}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.get
        for b in batches:
            bags, bare = [], []
            for t in b.column(2):
                bag = [[i for w in ws for f in features(w) if (i := get(f)) is not None] for _, _, ws in sentences(t.as_py())]
                bags.append([s for s in bag if s])
                bare.append(max(1, len(bag)) - len(bags[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.list_(pa.list_(pa.int32()))), pa.array(bare, pa.int64())], names=["id", "y", "bag", "bare"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sorted(texts.mapInArrow(tidy(encode), f"id {kind}, y int, bag array<array<int>>, bare long").collect())
    if not any(r["y"] for r in rows):
        return ToxicityModel({}, math.log(1e-3))
    w, b = _fit([(r["y"], 1 / share[r["y"]], r["bag"], r["bare"]) for r in rows], len(numbers))
    return ToxicityModel({f: float(w[i]) for f, i in numbers.items()}, b)


def toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", least: float = 0.5, score_col: str = "score", spans_col: str = "toxic_sentences") -> DataFrame:
    """``docs`` with the score of each whole text, and the sentences that score ``least`` or more.

    The score is 1 - prod(1 - sentence score).  Sentences come as (first, stop, score), places in UTF-8 bytes.
    Null and empty texts, and those without words, score as one empty sentence.  Other columns pass through;
    ones named like the two new columns are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
    docs = small_batches(docs).drop(score_col, spans_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.score(t.as_py(), least) for t in b.column(b.schema.names.index(text_col))]
            spans = [[{"first": i, "stop": j, "score": p} for i, j, p in s] for _, s in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s for s, _ in got], pa.float64()), pa.array(spans, kind)], names=[*b.schema.names, score_col, spans_col])

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import from_arrow_type

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(spans_col, from_arrow_type(kind))]))


def toxicity_report(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(id, held_out, score, predicted, n_toxic_sentences)`` for every row of ``docs``."""
    model = train(docs, labels, train_docs, id_col, text_col, label_col)
    scored = toxicity(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return scored.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_sentences").cast("long").alias("n_toxic_sentences"),
    )
