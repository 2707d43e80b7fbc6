"""Toxicity of texts by a sparse logistic regression over hashed word features, fitted by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import Words, mix, pieces, term_texts


@dataclass(frozen=True)
class ToxicityModel:
    """Weights other than 0 of some of ``2 ** bits`` feature places, in order of ``places``."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, dtype=np.float32)
        out[self.places] = self.weights
        return out


@dataclass(frozen=True)
class Ftrl:
    """Settings of FTRL-proximal: a coordinate's rate is ``alpha / (beta + sqrt(sum of its squared gradients))``."""

    alpha: float = 1.0
    beta: float = 0.1
    l1: float = 6.0
    l2: float = 0.1
    passes: int = 8


def features(words: Words, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, place) of each word, pair of neighbours and pair with one word between, each kind in its turn."""
    hashes, text = words.hashes(), words.text_of_word
    mask = np.uint64((1 << bits) - 1)
    yield text, (mix(hashes) & mask).astype(np.int64)
    for skip in (1, 2):
        if len(hashes) > skip:
            inside = text[:-skip] == text[skip:]
            pair = mix(hashes[:-skip] * np.uint64(0x9FB21C651E98DF25) + hashes[skip:] + np.uint64(skip))
            yield text[:-skip][inside], (pair & mask).astype(np.int64)[inside]


def _present(text: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, place) once, in order."""
    both = np.unique((text << bits) | place)
    return both >> bits, both & ((1 << bits) - 1)


def _chance(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[int, np.ndarray]], bits: int, settings: Ftrl = Ftrl(), seed: int = 7) -> ToxicityModel:
    """FTRL-proximal over (label, places) rows, one after the other in a seeded order, some times over.

    A coordinate's weight is 0 until its summed gradients pass ``l1``, so that most are.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias
    a, b, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2

    def weights(places: np.ndarray) -> np.ndarray:
        bound = np.where(places == size, 0.0, l1)
        z_ = z[places]
        return np.where(np.abs(z_) <= bound, 0.0, -(z_ - np.sign(z_) * bound) / ((b + np.sqrt(n[places])) / a + l2))

    rng = np.random.default_rng(seed)
    for _ in range(settings.passes):
        for k in rng.permutation(len(rows)).tolist():
            label, places = rows[k]
            places = np.append(places, size)
            w = weights(places)
            g = float(_chance(w.sum())) - label
            after = n[places] + g * g
            z[places] += g - (np.sqrt(after) - np.sqrt(n[places])) / a * w
            n[places] = after
    w = weights(np.arange(size + 1))
    places = np.flatnonzero(w[:-1])
    return ToxicityModel(places, w[places].astype(np.float32), float(w[-1]), bits)


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    docs_per_label: int = 4000,
    words_per_doc: int = 5000,
    bits: int = 20,
    settings: Ftrl = Ftrl(),
    seed: int = 7,
) -> ToxicityModel | None:
    """Fit the model on a bounded sample of the documents that ``labels`` marks 0 or 1.

    The sample has the ``docs_per_label`` marked ids of each label with the smallest seeded hashes, their texts once each, and of a
    text at most ``words_per_doc`` words from a hashed place on. Its features are made in tasks; the driver gets some 12 bytes a word and fits.
    An id marked more than once counts as 1 if any mark is; null marks and ids, and ids without a text, don't count. Without any marked text there is no model.
    """
    marks = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).where("__id is not null and __y is not null")
    marks = marks.groupBy("__id").agg((F.max("__y") > 0).cast("int").alias("__y"))
    by_hash = [F.xxhash64("__id", F.lit(seed)), "__id"]
    drawn = [marks.where(F.col("__y") == y).orderBy(*by_hash).limit(docs_per_label) for y in (0, 1)]
    # at most 2 * docs_per_label ids, whatever the size of the tables
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).where("__text is not null").join(ids, "__id").select("__y", "__text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            words = Words(term_texts(batch.column("__text")), lower=False)
            hashes = words.hashes()
            whole = np.zeros(batch.num_rows, dtype=np.uint64)
            some = words.lengths > 0
            if some.any():
                order = mix(hashes + np.arange(len(hashes), dtype=np.uint64) - np.repeat(words.offsets[:-1], words.lengths).astype(np.uint64))
                whole[some] = np.add.reduceat(order, words.offsets[:-1][some])
            begin = (whole % np.maximum(words.lengths - words_per_doc + 1, 1).astype(np.uint64)).astype(np.int64)
            place = np.arange(len(words)) - np.repeat(words.offsets[:-1] + begin, words.lengths)
            keep = (place >= 0) & (place < words_per_doc)
            before = np.concatenate([[0], np.cumsum(keep)])
            words.codes, words.offsets = words.codes[keep], before[words.offsets]
            parts = [_present(*part, bits) for part in features(words, bits)]
            found = _present(*(np.concatenate(x) for x in zip(*parts)), bits)
            cuts = np.searchsorted(found[0], np.arange(batch.num_rows + 1))
            packed = [found[1][a:b].astype(np.uint32).tobytes() for a, b in zip(cuts, cuts[1:])]
            columns = [batch.column("__y"), pa.array(whole.view(np.int64)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["y", "h", "places"])

    found = rows.mapInArrow(hashed, "y int, h long, places binary").collect()
    once = {(r["h"], r["y"], len(r["places"])): r for r in found}  # copies of a text have one hash and as many features
    kept = [(y, np.frombuffer(r["places"], dtype=np.uint32).astype(np.int64)) for (_, y, _), r in sorted(once.items(), key=lambda x: x[0])]
    return fit(kept, bits, settings, seed) if kept else None


def with_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text", marks: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` and ``marks``: the chance that the text is toxic, and 1 if it is at least a half, else 0.

    The score is that of the whole text: the weights of all its different words, pairs and skip-pairs, and the bias.
    Cases: a null or empty text has the bias alone; without a model the score is 0; equal texts have equal scores;
    an empty table gives an empty table; columns named like the marks are replaced, others are not looked at.
    """
    rest = [x for x in docs.columns if x not in marks]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{x}` {kinds[x]}" for x in rest) + f", `{marks[0]}` double, `{marks[1]}` int"
    read = docs.select(*rest) if text in rest else docs.select(*rest, text)
    if model is None:
        return read.select(*rest, F.lit(0.0).alias(marks[0]), F.lit(0).alias(marks[1]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 12 bytes for each weight other than 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weights = model.dense()
        for batch in pieces(batches, text):
            words = Words(term_texts(batch.column(text)), lower=False)
            owners, places = [], []
            for owner, place in features(words, model.bits):
                used = weights[place] != 0
                owners.append(owner[used])
                places.append(place[used])
            owner, place = _present(np.concatenate(owners), np.concatenate(places), model.bits)
            total = model.bias + np.bincount(owner, weights=weights[place], minlength=batch.num_rows)
            score = _chance(total)
            columns = [*(batch.column(x) for x in rest), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*rest, *marks])

    return read.mapInArrow(run, schema)
