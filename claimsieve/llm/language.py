"""Language of words and documents by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import BLANKS, PIECE_BYTES, Words, mix, pieces, ragged

#: Longest n-gram in bytes of a word with a mark at either end.
GRAM = 5
#: Words of a text that the messages pass through together; longer texts take several blocks.
BLOCK = 32


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` of hashed word features by language, ``moves`` between the languages of neighbours."""

    languages: tuple[str, ...]
    weights: np.ndarray
    moves: np.ndarray


def _gram_parts(values: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature buckets of distinct words and whose they are, in order of the words, one length of n-grams at a time.

    Features are the n-grams of 2 to GRAM bytes of the word between two marks, so that those with a
    mark are its prefixes and suffixes, and the whole word as an entry of the lexicon.
    """
    values = values.cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    begins = offsets[:-1] - offsets[0] + 2 * np.arange(len(lengths))
    marked = np.full(len(data) + 2 * len(lengths), 1, dtype=np.uint64)  # the mark before a word
    marked[begins + lengths + 1] = 2  # the mark behind it
    row = np.repeat(np.arange(len(lengths)), lengths)
    marked[np.arange(len(data)) + 2 * row + 1] = data
    left = np.repeat(begins + lengths + 2, lengths + 2) - np.arange(len(marked))  # bytes up to the word's end
    code = marked.copy()
    places = np.arange(len(marked))
    word = np.repeat(np.arange(len(lengths)), lengths + 2)
    for n in range(2, GRAM + 1):
        code = code[:-1] * np.uint64(0x9FB21C651E98DF25) + marked[n - 1 :] + np.uint64(1)
        inside = left[: len(code)] >= n
        yield (mix(code[inside] + np.uint64(n)) % np.uint64(buckets)).astype(np.int32), word[: len(code)][inside]
    powers = np.cumsum(np.concatenate([[0], marked * mix(places.astype(np.uint64) - np.repeat(begins, lengths + 2).astype(np.uint64))]).astype(np.uint64))
    whole = powers[begins + lengths + 2] - powers[begins]
    yield (mix(whole) % np.uint64(buckets)).astype(np.int32), np.arange(len(lengths))


def _grams(values: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All feature buckets word by word, and where each word's begin."""
    parts = list(_gram_parts(values, buckets))
    features, owners = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(owners, kind="stable")
    return features[order], np.searchsorted(owners[order], np.arange(len(values) + 1))


def _has_letter(values: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(values, r"\p{L}").to_numpy(zero_copy_only=False)


def _emissions(model: LanguageModel, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score of each distinct word in each language; whether it has a letter. Others score alike."""
    letters = _has_letter(values)
    scores = np.zeros((len(values), len(model.languages)), dtype=np.float32)
    if letters.any():
        found = np.zeros((int(letters.sum()), scores.shape[1]), dtype=np.float32)
        for features, owners in _gram_parts(values.filter(pa.array(letters)), len(model.weights)):
            if len(owners):
                begins = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
                found[owners[begins]] += np.add.reduceat(model.weights[features], begins, axis=0)
        scores[letters] = found
    return scores, letters


def marginals(scores: np.ndarray, offsets: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of each language for each word, by forward-backward over each text.

    The texts are cut into blocks. A first pass gives each block's transfer matrix, a second carries
    the messages over the blocks of each text, a third through each block; so the loops are
    as long as a block and as the most blocks of a text, whatever the texts' number.
    """
    k = scores.shape[1]
    lengths = np.diff(offsets)
    count = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), count)
    first = np.cumsum(count) - count
    number = np.arange(len(text)) - first[text]
    begin = offsets[:-1][text] + number * BLOCK
    size = np.minimum(BLOCK, offsets[1:][text] - begin)
    # the longest blocks first, so that those still open at a step are the first rows
    order = np.argsort(-size, kind="stable")
    begin_o, size_o = begin[order], size[order]
    psi = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    move = np.exp(moves - moves.max()).astype(np.float32)
    n = len(text)
    open_at = [int(np.searchsorted(-size_o, -t, side="left")) for t in range(BLOCK)]  # blocks with more than t words
    transfer = np.broadcast_to(np.eye(k, dtype=np.float32), (n, k, k)).copy()
    for t in range(BLOCK):
        m = open_at[t]
        if not m:
            break
        now = (transfer[:m].reshape(-1, k) @ move).reshape(m, k, k) * psi[begin_o[:m] + t][:, None, :]
        transfer[:m] = now / now.max(axis=(1, 2), keepdims=True)
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    into, after = np.ones((n, k), dtype=np.float32), np.ones((n, k), dtype=np.float32)
    by_count = np.argsort(-count, kind="stable")
    long = [int(np.searchsorted(-count[by_count], -b, side="left")) for b in range(int(count.max(initial=0)))]
    for b in range(1, len(long)):
        row = first[by_count[: long[b]]] + b - 1
        step = np.einsum("nk,nkl->nl", into[row], transfer[back[row]])
        into[row + 1] = step / step.max(axis=1, keepdims=True)
    for b in range(len(long) - 1, 0, -1):
        row = first[by_count[: long[b]]] + b
        step = np.einsum("nkl,nl->nk", transfer[back[row]], after[row])
        after[row - 1] = step / step.max(axis=1, keepdims=True)
    forward = np.empty_like(psi)
    message = into[order]
    for t in range(BLOCK):
        m = open_at[t]
        if not m:
            break
        now = (message[:m] @ move) * psi[begin_o[:m] + t]
        message[:m] = now / now.max(axis=1, keepdims=True)
        forward[begin_o[:m] + t] = message[:m]
    message = after[order]
    for t in reversed(range(BLOCK)):
        m = open_at[t]
        if not m:
            continue
        here = begin_o[:m] + t
        forward[here] *= message[:m]
        now = (message[:m] * psi[here]) @ move.T
        message[:m] = now / now.max(axis=1, keepdims=True)
    return forward / forward.sum(axis=1, keepdims=True)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    docs_per_language: int = 150,
    words_per_doc: int = 200,
    buckets: int = 1 << 18,
    rounds: int = 40,
    seed: int = 7,
) -> LanguageModel:
    """Fit the model on the rows of ``docs`` that have a language and a text with words.

    It sees ``docs_per_language`` different texts of each language, or all if there are fewer: those of the smallest
    seeded hashes. Copies of a text count as one, folded within tasks first. Of each text it takes a window
    of at most ``words_per_doc`` words at a hashed place. What reaches the driver is some 2 * ``docs_per_language`` + 100
    such windows a language, as the hash up to which a task keeps texts comes from an approximate count of the different ones.
    As whole texts have one language, the training sequences switch: they are put together
    from runs of words of several languages, and the transitions are learned from them.
    Without such a row the model has no languages.
    """
    words = F.split(F.trim(F.col("t"), F.lit(BLANKS)), r"[ \t\n\x0B\f\r]+")
    rows = docs.select(F.col(lang).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    rows = rows.where(F.col("t").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("t", F.lit(seed)))
    counts = {x["l"]: x["n"] for x in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return LanguageModel((), np.zeros((buckets, 0), dtype=np.float32), np.zeros((0, 0), dtype=np.float32))
    # wide enough that a language has too few below its bound only if it has no more
    share = {name: (2 * docs_per_language + 100) / max(1, n) for name, n in counts.items()}
    bound = {name: (1 << 63) - 1 if x >= 1 else int(x * (1 << 64)) - (1 << 63) for name, x in share.items()}
    upto = F.create_map(*(F.lit(x).cast(kind) for name in bound for x, kind in ((name, "string"), (bound[name], "long"))))
    sample = rows.where(F.col("h") <= upto[F.col("l")]).withColumn("w", words)
    begin = F.greatest(F.lit(0), F.pmod(F.xxhash64("t"), F.greatest(F.lit(1), F.size("w") - words_per_doc)).cast("int"))
    sample = sample.select("l", "h", F.slice("w", begin + 1, F.lit(words_per_doc)).alias("w")).groupBy("l", "h").agg(F.min("w").alias("w"))
    drawn: dict[str, list[tuple[int, int, list[str]]]] = {name: [] for name in sorted(counts)}
    for row in sample.withColumn("o", F.xxhash64("w")).collect():
        drawn[row["l"]].append((row["h"], row["o"], row["w"]))
    streams = {}
    for name, texts in drawn.items():
        kept = sorted(texts)[:docs_per_language]
        streams[name] = [w for _, _, text in sorted(kept, key=lambda x: x[1]) for w in text]
    languages = tuple(x for x in streams if streams[x])
    return _fit(languages, [streams[x] for x in languages], buckets, rounds, seed)


def _fit(languages: tuple[str, ...], streams: list[list[str]], buckets: int, rounds: int, seed: int, length: int = 64, run: int = 16) -> LanguageModel:
    """Stochastic gradient by Adam on the log-likelihood of switching sequences."""
    rng, k = np.random.default_rng(seed), len(languages)
    encoded = pa.array([w for s in streams for w in s], pa.large_string()).dictionary_encode()
    codes, base = encoded.indices.to_numpy().astype(np.int64), np.cumsum([0, *map(len, streams)])
    n = max(1, len(codes) // length)
    words, gold = np.empty((n, length), dtype=np.int64), np.empty((n, length), dtype=np.int64)
    for s in range(n):
        at = 0
        while at < length:
            label, m = int(rng.integers(k)), min(length - at, int(rng.geometric(1 / run)))
            begin = int(rng.integers(len(streams[label])))
            places = base[label] + (begin + np.arange(m)) % len(streams[label])
            words[s, at : at + m], gold[s, at : at + m] = codes[places], label
            at += m
    letters = _has_letter(encoded.dictionary)
    features, begins = _grams(encoded.dictionary, buckets)
    sizes = np.diff(begins)
    weights, moves = np.zeros((buckets, k), dtype=np.float32), np.zeros((k, k), dtype=np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    offsets, flat = np.arange(n + 1) * length, words.ravel()
    hot = np.eye(k, dtype=np.float32)[gold.ravel()]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    for t in range(1, rounds + 1):
        scores = np.add.reduceat(weights[features], begins[:-1], axis=0) * letters[:, None]
        found = marginals(scores[flat], offsets, moves)
        rest = np.zeros((len(letters), k), dtype=np.float32)
        for label in range(k):
            rest[:, label] = np.bincount(flat, weights=(hot - found)[:, label], minlength=len(letters))
        rest *= letters[:, None]
        gradient = np.empty_like(weights)
        for label in range(k):
            gradient[:, label] = np.bincount(features, weights=np.repeat(rest[:, label], sizes), minlength=buckets)
        expected = _expected_pairs(scores, words, moves)
        grads = (gradient / n - 1e-4 * weights, ((pairs - expected) / n).astype(np.float32))
        for x, (m1, m2), g in zip((weights, moves), state, grads):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x += 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
    return LanguageModel(languages, weights, moves)


def _expected_pairs(scores: np.ndarray, words: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected counts of neighbouring labels over sequences of one length."""
    n, length = words.shape
    psi = np.exp(scores - scores.max(axis=1, keepdims=True))[words]
    move = np.exp(moves - moves.max())
    forward, backward = np.empty_like(psi), np.ones_like(psi)
    message = np.ones((n, psi.shape[2]), dtype=psi.dtype)
    for t in range(length):
        message = (message @ move) * psi[:, t]
        message /= message.sum(axis=1, keepdims=True)
        forward[:, t] = message
    for t in reversed(range(length - 1)):
        now = (backward[:, t + 1] * psi[:, t + 1]) @ move.T
        backward[:, t] = now / now.max(axis=1, keepdims=True)
    right = backward[:, 1:] * psi[:, 1:]
    joint = np.einsum("ntk,kl,ntl->ntkl", forward[:, :-1], move, right)
    return (joint / joint.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))


def with_language(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    spans: bool = False,
    marks: tuple[str, str] = ("lang_pred", "score"),
    sureness: tuple[str, str] | None = None,
) -> DataFrame:
    """All columns of ``docs`` and ``marks``, the predicted language and its score, replacing columns of those names.

    Every word's language probabilities come from forward-backward over the whole text. The
    document's are their means over its words with a letter; the prediction is the largest, the score
    its value. With ``spans`` there is also ``lang_spans``: (lang, words) for each run of words whose most
    probable language is the same. ``sureness`` names two more columns: the mean over the words with a letter of
    each word's largest probability, which a text of several languages has as high as others, and these words' number.
    Cases: a null text, or one without a letter, is ``und`` with score 0 and spans of that language, as are all texts if the
    model has no languages; ties go to the language first in order; an empty table gives an empty table. Other columns are
    not looked at.
    """
    names = [*marks, *(sureness or ())] + ["lang_spans"] * spans
    rest = [x for x in docs.columns if x not in names]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{x}` {kinds[x]}" for x in rest) + f", `{marks[0]}` string, `{marks[1]}` double"
    schema += f", `{sureness[0]}` double, `{sureness[1]}` long" if sureness else ""
    schema += ", lang_spans array<struct<lang: string, words: int>>" * spans
    known = np.array([*model.languages, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, PIECE_BYTES // 8):
            words = Words(batch.column(text), lower=False)
            if model.languages:
                scores, letters = _emissions(model, words.values)
                found = marginals(scores[words.codes], words.offsets, model.moves)
            else:
                letters, found = np.zeros(len(words.values), dtype=bool), np.ones((len(words), 1), dtype=np.float32)
            counted = letters[words.codes] if len(words) else np.empty(0, dtype=bool)
            upto = np.concatenate([np.zeros((1, found.shape[1])), np.cumsum(found * counted[:, None], axis=0, dtype=np.float64)])
            total = np.concatenate([[0], np.cumsum(counted)])[words.offsets]
            n = np.diff(total)
            share = np.diff(upto[words.offsets], axis=0) / np.maximum(n, 1)[:, None]
            best = np.where(n > 0, share.argmax(axis=1), len(model.languages))
            score = np.where(n > 0, np.clip(share.max(axis=1), 0, 1), 0.0)
            columns = [*(batch.column(x) for x in rest), pa.array(known[best], pa.string()), pa.array(score)]
            if sureness:
                sure = np.concatenate([[0], np.cumsum(found.max(axis=1) * counted, dtype=np.float64)]) if len(words) else np.zeros(1)
                columns += [pa.array(np.clip(np.diff(sure[words.offsets]) / np.maximum(n, 1), 0, 1)), pa.array(n.astype(np.int64))]
            if spans:
                columns.append(_spans(found.argmax(axis=1), best, words, known))
            yield pa.RecordBatch.from_arrays(columns, rest + names)

    return docs.select(*rest).mapInArrow(run, schema)


def _spans(labels: np.ndarray, best: np.ndarray, words: Words, known: np.ndarray) -> pa.Array:
    text = words.text_of_word
    labels = np.where(best[text] == len(known) - 1, len(known) - 1, labels)
    new = np.ones(len(labels), dtype=bool)
    new[1:] = (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    runs = pa.StructArray.from_arrays([pa.array(known[labels[begin]], pa.string()), pa.array(np.diff(np.append(begin, len(labels))), pa.int32())], ["lang", "words"])
    counts = np.bincount(text[begin], minlength=len(words.lengths))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), runs)
