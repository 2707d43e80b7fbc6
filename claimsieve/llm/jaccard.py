"""Similarity join of word n-gram sets by parity sketches."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.llm.common import PIECE_BYTES, Words, mix, pieces, ragged, release_memory, window_hashes
from claimsieve.llm.components import components
from claimsieve.staging import Workspace

#: Independent sketches of a set with too many empty words in the ones before; half of the smallest sets need a second.
SKETCHES = 8
#: Bits of the sketches for each value in which linked sets may differ: of those that travel with every row of an open bucket, and of those that pairs are compared by.
SHORT, LONG = 4, 16
#: Rows of an open bucket that lie together, and pairs of them that a task looks at together.
BLOCK, PAIRS = 4096, 1 << 18
#: A set's smallest keys that say whether a pair has met in an earlier bucket.
FIRST_KEYS = 16


@dataclass(frozen=True)
class Threshold:
    """Sets link when ``of * intersection >= share * union``."""

    share: int = 80
    of: int = 100

    def bands(self, largest: int) -> np.ndarray:
        """First size of each band. Sets that link lie in one band or in neighbouring ones."""
        edges = [1]
        while edges[-1] <= largest:
            edges.append(edges[-1] * self.of // self.share + 1)
        edges.append(edges[-1] * self.of // self.share + 1)
        return np.array([*edges, edges[-1] * self.of // self.share + 1], dtype=np.int64)

    def most_apart(self, size: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of two sets that link, of at most ``size`` each."""
        return 2 * size * (self.of - self.share) // (self.of + self.share)


    def spare_words(self, apart: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Words of a sketch beyond one more than the differing values, so that few sets have more empty words.

        A set of ``least`` values leaves each word empty by chance; the words are that number on average
        and three deviations more. Where that would be more than a quarter, as in small sets, they are what a sketch without
        them leaves empty and two deviations more, and none for differences under 8: words of single values are in too many sets.
        """
        first = (apart + 1) * np.exp(-least / (apart + 1))
        little = np.where(apart < 8, 0, np.ceil(first + 2 * np.sqrt(first)))
        spare = little
        for _ in range(12):
            words = apart + 1 + spare
            empty = words * np.exp(-least / words)
            spare = np.minimum(np.ceil(empty + 3 * np.sqrt(empty)), apart)
        return np.where(spare * 4 <= apart, spare, little).astype(np.int64)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's ``n``-word shingles in order, and how many each has.

    A text with fewer words has one for all its words, a text without words none.
    """
    hashes, lengths, text = words.hashes(), words.lengths, words.text_of_word
    found = window_hashes(hashes, n)
    inside = text[: len(found)] == text[n - 1 :] if len(found) else np.empty(0, dtype=bool)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    whole = [window_hashes(hashes[a:b], b - a)[0] + np.uint64(b - a) for a, b in zip(words.offsets[short], words.offsets[short + 1])]
    owner = np.concatenate([text[: len(found)][inside], short])
    values = np.concatenate([found[inside], np.array(whole, dtype=np.uint64)])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(lengths))


def _sketch(values: np.ndarray, counts: np.ndarray, words: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity words of each set, ``words`` of them, and whose they are.

    Each value is XORed into one word: 64 parity bits. Sets that differ in d values differ in at most d words.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    spread = values if round_ == 0 else mix(values + np.uint64(round_))
    part = ((spread >> np.uint64(32)) * words[owner].astype(np.uint64)) >> np.uint64(32)
    base = np.cumsum(words) - words
    slot = base[owner] + part.astype(np.int64)
    data = mix(values ^ np.uint64(0xA24BAED4963EE407 + round_))
    if round_:
        order = np.argsort(slot, kind="stable")
        slot, data = slot[order], data[order]
    out = np.zeros(int(words.sum()), dtype=np.uint64)
    if len(slot):
        begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        out[slot[begin]] = np.bitwise_xor.reduceat(data, begin)
    return out, np.repeat(np.arange(len(counts)), words)


def _take(values: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    begins = np.cumsum(counts) - counts
    n = counts[rows]
    return values[np.arange(n.sum()) + np.repeat(begins[rows] - (np.cumsum(n) - n), n)]


def bit_sketches(values: np.ndarray, counts: np.ndarray, threshold: Threshold, bits: int = LONG) -> list[bytes]:
    """Each set's parity bits: every value flips one of a power of two of bits.

    The bits in which two sketches differ are at most the values in which the sets differ. A sketch of twice the bits
    is folded by XOR of its halves. There are at least ``bits`` bits for each value in which linked sets may differ.
    """
    apart = threshold.most_apart(counts.astype(np.int64) * threshold.of // threshold.share)
    size = np.int64(1) << np.ceil(np.log2(np.maximum(64, bits * apart))).astype(np.int64)
    base = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(counts)), counts)
    flipped = base[owner] + (mix(values + np.uint64(0x2545F4914F6CDD1D)) & (size[owner] - 1).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(flipped, minlength=int(size.sum())) & 1).astype(np.uint8)
    packed = np.packbits(parity, bitorder="little").tobytes()
    edges = (np.append(base, size.sum()) // 8).tolist()
    return [packed[a:b] for a, b in zip(edges, edges[1:])]


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded."""
    if len(a) < len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ y).bit_count()


def bucket_keys(values: np.ndarray, counts: np.ndarray, threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) such that sets that link share a key.

    A set goes with its own size band and the next. In a band whose sets differ in at most d values if they
    link, sketches have d + 1 words and a few more, so that such sets agree in at least 1 + the few. The words that agree
    may all be empty in a set with more empty words than the few; only then it takes part with a further sketch too, and
    after the last with a key for each choice of an empty word of the last two.
    """
    rows = np.flatnonzero(counts > 0)
    if not len(rows):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    edges = threshold.bands(int(counts.max()))
    band = np.searchsorted(edges, counts[rows], side="right") - 1
    owners, keys = [], []
    full = _take(values, counts, rows)
    for step in (0, 1):
        group = band + step
        apart = threshold.most_apart(edges[group + 1] - 1)
        few = threshold.spare_words(apart, edges[np.maximum(group - 1, 0)])
        words = apart + 1 + few
        sets, sizes, data = rows, counts[rows], full
        empties: list[list[list[int]]] = []
        for round_ in range(SKETCHES):
            sketch, owner = _sketch(data, sizes, words, round_)
            base = np.cumsum(words) - words
            part = np.arange(len(sketch)) - base[owner]
            salt = mix((group[owner].astype(np.uint64) << np.uint64(40)) + (np.uint64(round_) << np.uint64(36)) + part.astype(np.uint64))
            there = sketch != 0
            owners.append(sets[owner[there]])
            keys.append(mix(sketch[there] ^ salt[there]))
            none = np.bincount(owner[~there], minlength=len(sets))
            weak = np.flatnonzero(none > few)
            cuts = np.searchsorted(owner[~there], np.concatenate([weak, weak + 1]))
            places = part[~there]
            now = [places[a:b].tolist() for a, b in zip(cuts[: len(weak)], cuts[len(weak) :])]
            empties = [[*empties[k][-1:], x] if empties else [x] for k, x in zip(weak.tolist(), now)]
            data = _take(data, sizes, weak)
            sets, sizes, words, few, group = sets[weak], sizes[weak], words[weak], few[weak], group[weak]
            if not len(weak):
                break
        for who, band_, lists in zip(sets.tolist(), group.tolist(), empties if len(sets) else []):
            for choice in itertools.product(*lists):
                key = np.array([len(choice), band_, *choice], dtype=np.uint64)
                owners.append(np.array([who]))
                keys.append(window_hashes(mix(key + np.uint64(1)), len(key)))
    return np.concatenate(owners), np.concatenate(keys)


_SETS = "__id {id}, __n long, __sum long, __xor long, __keys array<long>, __bits binary, __short binary"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def link_near_copies(
    docs: DataFrame, workspace: Workspace, threshold: Threshold = Threshold(), n: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    A document's set holds the distinct ``n``-word shingles of its text, with A-Z in lower case; two
    documents link when their sets' Jaccard similarity reaches the threshold, and ``component_id`` is
    the smallest id that links reach. All links count, though not all are looked at: equal sets are found by two hashes, and of a bucket of
    equal sketch words each set is compared with the first one: first by sketches of single bits, whose
    distance bounds the sets' difference from below, and if that leaves it open by the whole sets. In buckets that
    then still hold several components, all pairs across them are compared by short sketches; those left open are compared like the others. Texts travel to verified pairs alone.
    A task lets out the keys of equal sets once.
    Cases: a null or blank text has no shingles and no links; a text with fewer than ``n`` words has
    one shingle; rows that share an id are one document with the links of all its texts; a row
    without id has no links and component null; an empty table gives an empty table; other columns are not looked at.
    """
    # the stage tables, larger than the documents, go as soon as the result is written
    with Workspace(docs.sparkSession, root=workspace.path) as inner:
        return workspace.stage(_linked(docs, inner, threshold, n, doc_id, text), "near_copies")


def _linked(docs: DataFrame, workspace: Workspace, threshold: Threshold, n: int, doc_id: str, text: str) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    schema = _SETS.format(id=kind)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in pieces(batches, "__text", PIECE_BYTES // 2):
            values, counts = shingle_sets(Words(batch.column("__text"), lower=True), n)
            begins = np.cumsum(counts) - counts
            some = counts > 0
            total, parity = np.zeros(len(counts), dtype=np.uint64), np.zeros(len(counts), dtype=np.uint64)
            if some.any():
                total[some] = np.add.reduceat(mix(values), begins[some])
                parity[some] = np.bitwise_xor.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), begins[some])
            new = some & batch.column("__id").is_valid().to_numpy(zero_copy_only=False)
            for k, mark in enumerate(zip(total.tolist(), parity.tolist())):
                if mark in seen:
                    new[k] = False
                elif new[k]:
                    seen.add(mark)
            fresh = np.flatnonzero(new)
            own, sizes = _take(values, counts, fresh), counts[fresh]
            owner, keys = bucket_keys(own, sizes, threshold)
            bits, short = (np.full(len(counts), None, dtype=object) for _ in range(2))
            bits[fresh] = np.array([*bit_sketches(own, sizes, threshold), None], dtype=object)[:-1]
            short[fresh] = np.array([*bit_sketches(own, sizes, threshold, SHORT), None], dtype=object)[:-1]
            order = np.argsort(owner, kind="stable")
            each = np.zeros(len(counts), dtype=np.int64)
            each[fresh] = np.bincount(owner, minlength=len(fresh))
            columns = [batch.column("__id"), pa.array(counts, pa.int64()), pa.array(_signed(total)), pa.array(_signed(parity)), ragged(_signed(keys[order]), each, pa.int64()), pa.array(bits, pa.binary()), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    sets = workspace.stage(rows.mapInArrow(sketched, schema), "sets")
    alike = ["__n", "__sum", "__xor"]
    classes = sets.where("__n > 0").groupBy(*alike).agg(F.min("__id").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    classes = workspace.stage(classes, "classes")
    equal = sets.drop("__keys").join(classes, alike).select("a", F.col("__id").alias("b")).where("a is not null and b is not null")

    by_key = Window.partitionBy("key").orderBy("doc")
    keyed = sets.where("__id is not null").select(F.col("__id").alias("doc"), F.explode("__keys").alias("key"))
    keyed = keyed.withColumns({"first": F.first("doc").over(by_key), "next": F.lead("doc").over(by_key)})
    shared = workspace.stage(keyed.where("doc != first or next is not null").select("key", "doc", "first"), "buckets")
    near = workspace.stage(shared.where("doc != first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct(), "pairs")
    found = shared.select(F.col("doc").alias("__id")).distinct()
    sketches = workspace.stage(sets.where("__bits is not null").select("__id", "__n", "__bits", "__short").join(found, "__id", "left_semi"), "sketches")

    texts = workspace.stage(rows.join(found, "__id", "left_semi"), "texts")
    links = _verified(_close(near, sketches, threshold), texts, threshold, n).unionByName(equal)
    links = workspace.stage(links, "links")
    label = _more_links(shared, components(links, workspace), links, sketches, texts, threshold, n, workspace)
    out = sets.select("__id", "__n").join(label.withColumnRenamed("node", "__id"), "__id", "left")
    component = F.coalesce("component", "__id")
    return out.select(F.col("__id").alias("doc_id"), F.col("__n").alias("n_shingles"), component.alias("component_id"))


def _bucket_rows(shared: DataFrame, label: DataFrame) -> DataFrame:
    """``key, doc, component`` with the components of ``label``; a set that it doesn't know is its own."""
    known = label.withColumnRenamed("node", "doc")
    return shared.select("key", "doc").join(known, "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _open_buckets(rows: DataFrame, workspace: Workspace) -> DataFrame:
    """The rows of the buckets that hold several components, dealt so that all pairs across components meet.

    ``own`` is a row's block of some ``BLOCK`` rows of its bucket, ``low`` and ``high`` are that and one it is compared with. In a larger bucket the sets of its
    largest component, which need no comparing among themselves, lie in blocks of their own, that only blocks of other sets are compared with.
    """
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all")).where(F.col("all") > F.col("most.n"))
    keys = workspace.stage(keys, "open_keys")
    rows = rows.join(keys, "key")
    other = F.col("component") != F.col("most.component")
    small = F.col("all") <= BLOCK
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK))).cast("int")
    rows = rows.withColumns({"others": F.when(small, 1).otherwise(blocks(F.col("all") - F.col("most.n"))), "rest": F.when(small, 0).otherwise(blocks(F.col("most.n")))})
    spread = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    rows = rows.withColumn("own", F.when(small | other, spread(F.col("others"))).otherwise(F.col("others") + spread(F.greatest(F.lit(1), F.col("rest")))))
    # a block of the largest component meets those of the others alone
    partners = F.when(small | other, F.col("others") + F.col("rest")).otherwise(F.col("others"))
    rows = rows.withColumn("partner", F.explode(F.sequence(F.lit(0), partners - 1)))
    return rows.select("key", F.least("own", "partner").alias("low"), F.greatest("own", "partner").alias("high"), "own", "doc", "component")


def _with_first_keys(dealt: DataFrame) -> DataFrame:
    """The dealt rows with ``first``, the ``FIRST_KEYS`` smallest keys of each set's open buckets."""
    keys = F.slice(F.array_sort(F.collect_set("key")), 1, FIRST_KEYS)
    return dealt.join(dealt.groupBy("doc").agg(keys.alias("first")), "doc")


def _met_before(first: np.ndarray, key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows ``i`` and ``j`` of one bucket both have one of ``first`` below its key, and so share that bucket too."""
    out = np.zeros(len(i), dtype=bool)
    for column in first.T:
        out |= (column[i] < key[i]) & (first[j] == column[i][:, None]).any(axis=1)
    return out


class _Folding:
    """Sketches of several lengths, each a power of two of 64-bit words, compared two by two."""

    def __init__(self, bits: list[bytes]):
        sizes = np.array([len(x) // 8 for x in bits], dtype=np.int64)
        self.level = np.log2(np.maximum(sizes, 1)).astype(np.int64)
        self.words, self.place = {}, np.zeros(len(bits), dtype=np.int64)
        for level in np.unique(self.level).tolist():
            rows = np.flatnonzero(self.level == level)
            self.place[rows] = np.arange(len(rows))
            self.words[level] = np.frombuffer(b"".join(bits[k] for k in rows.tolist()), dtype=np.uint64).reshape(len(rows), -1)

    def apart(self, i: np.ndarray, j: np.ndarray, room: int = 8 << 20) -> np.ndarray:
        """In how many bits the sketches ``i`` and ``j`` differ, the longer ones folded; arrays of ``room`` bytes at a time."""
        i, j = np.where(self.level[i] >= self.level[j], i, j), np.where(self.level[i] >= self.level[j], j, i)
        out = np.empty(len(i), dtype=np.int64)
        kind = self.level[i] * 64 + self.level[j]
        for both in np.unique(kind).tolist():
            long, short = divmod(both, 64)
            rows = np.flatnonzero(kind == both)
            step = max(1, room // (8 << long))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                folded = self.words[long][self.place[i[some]]]
                for _ in range(long - short):
                    half = folded.shape[1] // 2
                    folded = folded[:, :half] ^ folded[:, half:]
                out[some] = np.bitwise_count(folded ^ self.words[short][self.place[j[some]]]).sum(axis=1, dtype=np.int64)
        return out


def _close_in_buckets(rows: DataFrame, threshold: Threshold, wanted: str) -> DataFrame:
    """``a, b``: pairs across components of the dealt buckets whose sketches ``bits`` leave a link open.

    ``wanted`` are "all" of them, of which each leaves the first of the many buckets that near copies share alone
    (or all of these, where none is among the first keys of both); or those "joining": some of the closest that together join all components which such pairs can join; or only
    the "sets" that are in such pairs, each as a pair with itself.
    Pairs are looked at ``PAIRS`` at a time and only close ones leave a task, so its memory is bounded by that and by two blocks.
    """
    kind, pairs_at_once = dict(rows.dtypes)["doc"], PAIRS
    if wanted == "all":
        rows = _with_first_keys(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_buckets(batches):
            group, component = part.pop("group"), part["component"].dictionary_encode().indices.to_numpy()
            sizes, own, docs = part["n"].to_numpy(), part["own"].to_numpy(), part["doc"]
            across = (part["low"].to_numpy() != part["high"].to_numpy())[:, None]
            sketches = _Folding(part["bits"].to_pylist())
            if wanted == "all":
                keys, counts = part["key"].to_numpy(), pc.list_value_length(part["first"]).to_numpy()
                first = np.full((len(group), FIRST_KEYS), np.iinfo(np.int64).max)
                first[np.arange(FIRST_KEYS) < counts[:, None]] = part["first"].flatten().to_numpy()
            end = np.searchsorted(group, group, side="right")
            after = end - 1 - np.arange(len(group))
            upto = np.cumsum(after)
            joined: dict[tuple[int, int], tuple[int, int]] = {}

            def find(x: tuple[int, int]) -> tuple[int, int]:
                while joined.get(x, x) != x:
                    joined[x] = joined.get(joined[x], joined[x])
                    x = joined[x]
                return x

            begin, close = 0, np.zeros(len(group), dtype=bool)
            while begin < len(group):
                stop = max(begin + 1, int(np.searchsorted(upto, upto[begin] - after[begin] + pairs_at_once, side="right")))
                n = after[begin:stop]
                i = np.repeat(np.arange(begin, stop), n)
                j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = stop
                most = (sizes[i] + sizes[j]) * (threshold.of - threshold.share) // (threshold.of + threshold.share)
                open_ = (component[i] != component[j]) & (np.abs(sizes[i] - sizes[j]) <= most) & (~across[i, 0] | (own[i] != own[j]))
                i, j, most = i[open_], j[open_], most[open_]
                apart = sketches.apart(i, j)
                near = apart <= most
                i, j, apart = i[near], j[near], apart[near]
                if wanted == "sets":
                    close[i] = close[j] = True
                    continue
                if wanted == "joining" and len(i):
                    kept = []
                    for k in np.argsort(apart, kind="stable").tolist():
                        one, two = (find((int(group[x]), int(component[x]))) for x in (i[k], j[k]))
                        if one != two:
                            joined[one] = two
                            kept.append(k)
                    i, j = i[kept], j[kept]
                if wanted == "all" and len(i):
                    new = ~_met_before(first, keys, i, j)
                    i, j = i[new], j[new]
                if len(i):
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(i)), docs.take(pa.array(j))], ["a", "b"])
            if close.any():
                some = docs.filter(pa.array(close)).unique()
                yield pa.RecordBatch.from_arrays([some, some], ["a", "b"])

    arranged = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = arranged.mapInArrow(compare, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The columns of batches cut at the ends of (key, low, high), and ``group``, a number for each of these."""
    held: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
        if held is None:
            return
        marks = [held.column(x).to_numpy() for x in ("key", "low", "high")]
        new = np.concatenate([[False], np.any([x[1:] != x[:-1] for x in marks], axis=0)])
        cut = held.num_rows if batch is None else int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            part = held.slice(0, cut).combine_chunks()
            yield {x: pa.concat_arrays(part.column(x).chunks) for x in part.column_names} | {"group": np.cumsum(new[:cut])}
            held = held.slice(cut)
            del part
            release_memory()
        if batch is None:
            return


def _more_links(
    shared: DataFrame, label: DataFrame, links: DataFrame, sets: DataFrame, texts: DataFrame, threshold: Threshold, n: int, workspace: Workspace
) -> DataFrame:
    """``label`` after the links between components whose sets share a bucket.

    Short sketches say which sets may link with another one of their buckets at all; only these go on, with long sketches. Then some of the closest pairs that
    would join the components of each bucket are verified, and at last all pairs that long sketches
    leave open and that are still in different components: few, as those that link are mostly joined by then.
    """
    sketches = lambda bits: sets.select(F.col("__id").alias("doc"), F.col("__n").alias("n"), F.col(bits).alias("bits"))
    rows = workspace.stage(_bucket_rows(shared, label), "bucket_rows")
    some = _close_in_buckets(_open_buckets(rows, workspace).join(sketches("__short"), "doc"), threshold, "sets")
    some = workspace.stage(some.select(F.col("a").alias("doc")), "close_sets")
    rows = workspace.stage(rows.join(some, "doc", "left_semi"), "close_rows")
    tried = None
    for wanted in ("joining", "all"):
        pairs = _close_in_buckets(_open_buckets(rows, workspace).join(sketches("__bits"), "doc"), threshold, wanted)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = workspace.stage(pairs, "open_pairs")
        if pairs.isEmpty():
            return label
        found = workspace.stage(_verified(pairs, texts, threshold, n), "more_links")
        tried = pairs
        if not found.isEmpty():
            links = links.unionByName(found)
            label = components(links, workspace)
            rows = workspace.stage(_bucket_rows(rows, label), "close_rows")
    return label


def _close(pairs: DataFrame, sketches: DataFrame, threshold: Threshold) -> DataFrame:
    """``a, b``: the pairs of which the sketches leave it open whether the sets link."""
    one = sketches.select(F.col("__id").alias("a"), F.col("__n").alias("n_a"), F.col("__bits").alias("bits_a"))
    two = sketches.select(F.col("__id").alias("b"), F.col("__n").alias("n_b"), F.col("__bits").alias("bits_b"))
    kind = dict(pairs.dtypes)["a"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (threshold.of - threshold.share)
            most = (sizes // (threshold.of + threshold.share)).tolist()
            close = [bits_apart(x, y) <= m for x, y, m in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), most)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(close, pa.bool_())], ["a", "b", "close"])

    found = pairs.join(two, "b").join(one, "a").mapInArrow(compare, f"a {kind}, b {kind}, close boolean")
    return found.where("close").select("a", "b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, threshold: Threshold, n: int) -> DataFrame:
    """``a, b``: the pairs whose whole sets reach the threshold."""
    pairs = pairs.select("a", "b")
    one = texts.select(F.col("__id").alias("a"), F.col("__text").alias("text_a"))
    two = texts.select(F.col("__id").alias("b"), F.col("__text").alias("text_b"))
    kind = dict(pairs.dtypes)["a"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_b", PIECE_BYTES // 4):
            first = batch.column("text_a").dictionary_encode()
            both = pa.concat_arrays([first.dictionary.cast(pa.large_string()), batch.column("text_b").cast(pa.large_string())])
            values, counts = shingle_sets(Words(both, lower=True), n)
            left, right = first.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.arange(batch.num_rows) + len(first.dictionary)
            pair = np.concatenate([np.repeat(np.arange(len(left)), counts[left]), np.repeat(np.arange(len(right)), counts[right])])
            data = np.concatenate([_take(values, counts, left), _take(values, counts, right)])
            order = np.lexsort((data, pair))
            data, pair = data[order], pair[order]
            same = (data[1:] == data[:-1]) & (pair[1:] == pair[:-1])
            common = np.bincount(pair[1:][same], minlength=len(left))
            union = counts[left] + counts[right] - common
            linked = (threshold.of * common >= threshold.share * union) & (common > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])

    found = pairs.join(two, "b").join(one, "a").mapInArrow(compare, f"a {kind}, b {kind}, linked boolean")
    return found.where("linked").select("a", "b").distinct()
