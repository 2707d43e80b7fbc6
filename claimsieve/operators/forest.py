"""Random forests over many rows: the trees that MLlib's classifier describes, grown from histograms of narrow rows.

MLlib keeps, for each row, a number for every slot of its vector and one for every tree, which beyond the executors' memory is read from
disk for each level, and adds each row to a histogram of each drawn slot. Here a row is stored once as the few bins in which it differs from a zero
vector. A pass over these rows counts, in tasks, what the nodes of a level need; Spark groups the counts by node, and each group finds its node's split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.staging import Workspace

#: Bins of a slot, rows whose values say where they are cut, classes at most: as in MLlib.
BINS = 32
SAMPLED = 10_000
CLASSES = 100

#: Rows counted at once, and bytes of their bins at most.
_BLOCK_ROWS = 1 << 16
_BLOCK_BYTES = 32 << 20


@dataclass(frozen=True)
class Cuts:
    """Where the slots are cut. Only slots with a cut have a place; a value's bin is the number of cuts under it."""

    slots: np.ndarray  # slot of each place, ascending
    cuts: np.ndarray  # place x BINS - 1, padded with infinity
    numbers: np.ndarray  # cuts of each place

    def bins(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        found = np.zeros(len(values), np.int64)
        step = BINS // 2
        while step:
            probe = found + step
            found = np.where(values <= self.cuts[places, probe - 1], found, probe)
            step //= 2
        return np.minimum(found, self.numbers[places])

    def zeros(self) -> np.ndarray:
        """The bin of zero of each place."""
        return self.bins(np.arange(len(self.slots)), np.zeros(len(self.slots)))


@dataclass
class Tree:
    """Nodes by number: the children of ``k`` are ``2k + 1`` and ``2k + 2``. A split is a place and the last bin that goes left."""

    counts: dict[int, list[int]] = field(default_factory=dict)
    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Task:
    """A node to be split, and the places that it may be split at."""

    tree: int
    node: int
    places: np.ndarray


def cut_values(values: Sequence[float], numbers: Sequence[int], most: int = BINS - 1) -> list[float]:
    """Cuts between distinct ascending values that occur so often: all if they are few, else those that part them most evenly."""
    middles = [(a + b) / 2 for a, b in zip(values, values[1:])]
    if len(middles) <= most:
        return middles
    stride = sum(numbers) / (most + 1)
    cuts, seen, target = [], numbers[0], stride
    for middle, n in zip(middles, numbers[1:]):
        before, seen = seen, seen + n
        if abs(before - target) < abs(seen - target):
            cuts.append(middle)
            target += stride
    return cuts[:most]


def find_cuts(rows: DataFrame, n_rows: int, seed: int) -> Cuts:
    """Cuts from the values of some ten thousand rows, whose repeats Spark counts; the rows that grow the trees are all."""
    sample = rows if n_rows <= SAMPLED else rows.sample(SAMPLED / n_rows, seed)
    v = F.col("v")
    dense = F.transform(v["values"], lambda x, i: F.struct(i.alias("slot"), x.alias("value")))
    sparse = F.zip_with(v["indices"], v["values"], lambda i, x: F.struct(i.alias("slot"), x.alias("value")))
    pairs = sample.select(F.explode(F.when(v["type"] == 0, sparse).otherwise(dense)).alias("pair"))
    # one row for no pair at all counts the sample; -0.0 is 0.0
    size = sample.select(F.lit(-1).alias("slot"), F.lit(1.0).alias("value"))
    some = pairs.select("pair.slot", (F.col("pair.value") + F.lit(0.0)).alias("value")).where("value <> 0")
    counted = some.unionByName(size).groupBy("slot", "value").agg(F.count("*").alias("n"))
    by_slot: dict[int, dict[float, int]] = {}
    for slot, value, n in counted.collect():
        by_slot.setdefault(slot, {})[value] = n
    total = by_slot.pop(-1, {}).get(1.0, 0)
    found = {}
    for slot, numbers in by_slot.items():
        if zeros := total - sum(numbers.values()):
            numbers[0.0] = zeros
        ordered = sorted(numbers.items())
        if cuts := cut_values([x for x, _ in ordered], [n for _, n in ordered], min(BINS, n_rows) - 1):
            found[slot] = cuts
    slots = sorted(found)
    table = np.full((len(slots), BINS - 1), math.inf)
    for place, slot in enumerate(slots):
        table[place, : len(found[slot])] = found[slot]
    return Cuts(np.array(slots, np.int64), table, np.array([len(found[s]) for s in slots], np.int64))


def _binned(cuts: Cuts, slots: int, classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows as their id, class, and place times BINS plus bin where that is not the bin of zero."""
    place_of = np.full(slots, -1, np.int64)
    place_of[cuts.slots] = np.arange(len(cuts.slots))
    zeros = cuts.zeros()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            if not np.all((label >= 0) & (label < classes) & (label == np.floor(label))):
                raise ValueError("labels of a forest are whole numbers from 0")
            kind, _, indices, values = batch.column("v").flatten()
            if batch.column("v").null_count or not np.isfinite(values.flatten().to_numpy()).all():
                raise ValueError("vectors of a forest are neither null nor hold NaN or infinity")
            lengths = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            row = np.repeat(np.arange(len(label)), lengths)
            slot = np.arange(len(row)) - np.repeat(ends - lengths, lengths)
            sparse = kind.to_numpy(zero_copy_only=False) == 0
            slot[sparse[row]] = indices.flatten().to_numpy()
            place, value = place_of[slot], values.flatten().to_numpy()
            row, place, value = (a[place >= 0] for a in (row, place, value))
            bins = cuts.bins(place, value)
            other = bins != zeros[place]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[other], minlength=len(label)))])
            codes = (place * BINS + bins)[other].astype(np.int32)
            arrays = [batch.column("id"), pa.array(label.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(codes))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "class", "codes"])

    return run


def _poisson_table() -> np.ndarray:
    """How often a row is drawn, by 16 random bits: Poisson of mean 1, to within 1 / 65,536 for each number."""
    chances = [math.exp(-1) / math.factorial(k) for k in range(12)]
    ends = np.cumsum(chances)
    return np.searchsorted(ends, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _random_bits(ids: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for each id, by SplitMix64: a row is drawn alike wherever and however often it is read."""
    start = np.random.default_rng(seed).integers(0, 1 << 63, dtype=np.uint64)
    x = (ids.astype(np.uint64) + start) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Level:
    """What a pass counts: for each node its classes, then the classes in each bin of its places, in an array of its own."""

    cuts: Cuts
    classes: int
    trees: list[Tree]
    tasks: list[Task]
    seed: int

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For ``mapInArrow``: a row for each node, counted over the whole task."""
        zeros = self.cuts.zeros().astype(np.uint8)[:, None]
        most = max(1, min(_BLOCK_ROWS, _BLOCK_BYTES // max(1, len(zeros))))
        widths = [self.classes * (1 + int(np.sum(self.cuts.numbers[t.places] + 1))) for t in self.tasks]
        found = [np.zeros(w, np.int64) for w in widths]
        by_tree: dict[int, dict[int, int]] = {}
        for k, task in enumerate(self.tasks):
            by_tree.setdefault(task.tree, {})[task.node] = k
        table = _poisson_table()
        for block in _blocks(batches, most):
            self._add(block, zeros, by_tree, table, found)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["task", "counts"])

    def _add(self, block: pa.Table, zeros: np.ndarray, by_tree: dict[int, dict[int, int]], table: np.ndarray, found: list[np.ndarray]) -> None:
        codes, n = block.column("codes").combine_chunks(), block.num_rows
        row = np.repeat(np.arange(n), codes.value_lengths().to_numpy(zero_copy_only=False))
        code = codes.flatten().to_numpy()
        bins = np.repeat(zeros, n, axis=1)
        bins[code // BINS, row] = code % BINS
        ids, label = block.column("id").to_numpy(), block.column("class").to_numpy()
        of_class = np.stack([label == c for c in range(self.classes)])
        bits, drawn = None, -1
        for tree, wanted in by_tree.items():
            if tree // 4 != drawn:
                bits, drawn = _random_bits(ids, self.seed + 1 + tree // 4), tree // 4
            weight = table[(bits >> np.uint64(16 * (tree % 4))) & np.uint64(0xFFFF)]
            weights = weight.astype(np.float32) * of_class
            above = {0}
            for node in wanted:
                while node:
                    above.add(node)
                    node = (node - 1) // 2
            open_ = [(0, np.flatnonzero(weight))]
            while open_:
                node, rows = open_.pop()
                if node in wanted:
                    self._histograms(self.tasks[wanted[node]], bins, rows, weights, found[wanted[node]])
                    continue
                place, last = self.trees[tree].splits[node]
                right = bins[place].take(rows) > last
                for child, side in ((2 * node + 1, ~right), (2 * node + 2, right)):
                    if child in above:
                        open_.append((child, rows.take(np.flatnonzero(side))))

    def _histograms(self, task: Task, bins: np.ndarray, rows: np.ndarray, weights: np.ndarray, into: np.ndarray) -> None:
        k, numbers = self.classes, self.cuts.numbers[task.places]
        weights = weights.take(rows, axis=1)  # sums of 32-bit floats are exact here, as those of a block stay under 2 ** 24
        total = weights.sum(axis=1)
        into[:k] += total.astype(np.int64)
        halves = task.places[numbers == 1]
        taken = np.empty((len(halves), len(rows)), np.uint8)
        for values, place in zip(taken, halves):
            bins[place].take(rows, out=values, mode="clip")
        ones = iter(taken.astype(np.float32) @ weights.T)
        at = k
        for place, number in zip(task.places, numbers.tolist()):
            if number == 1:
                right = next(ones)
                counts = np.concatenate([total - right, right])
            else:
                values = bins[place].take(rows).astype(np.int64)
                counts = np.stack([np.bincount(values, w, number + 1) for w in weights], axis=1).ravel()
            size = len(counts)
            into[at : at + size] += counts.astype(np.int64)
            at += size

    def best(self, table: pa.Table) -> pa.Table:
        """For ``applyInArrow``: the split of one node, with the classes on both sides; no row where nothing is gained."""
        task = self.tasks[table.column("task")[0].as_py()]
        lists = table.column("counts").combine_chunks()
        counts = lists.flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        k, at = self.classes, self.classes
        total = counts[:k]
        best = (0.0, -1, -1, [], [])
        for place in task.places:
            size = int(self.cuts.numbers[place]) + 1
            left = np.cumsum(counts[at : at + size * k].reshape(size, k), axis=0)[:-1]
            at += size * k
            right = total - left
            both = left.any(axis=1) & right.any(axis=1)
            if not both.any():
                continue
            n_left, n_right = left.sum(axis=1), right.sum(axis=1)
            inside = (n_left * gini(left) + n_right * gini(right)) / total.sum()
            gains = np.where(both, gini(total[None])[0] - inside, -math.inf)
            last = int(gains.argmax())
            if gains[last] > best[0]:
                best = (float(gains[last]), int(place), last, left[last].tolist(), right[last].tolist())
        rows = [dict(zip(("task", "gain", "place", "last", "left", "right"), (table.column("task")[0].as_py(), *best)))] if best[1] >= 0 else []
        return pa.Table.from_pylist(rows, _SPLIT)


_SPLIT = pa.schema(
    [("task", pa.int32()), ("gain", pa.float64()), ("place", pa.int32()), ("last", pa.int32()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]
)


def gini(counts: np.ndarray) -> np.ndarray:
    """Impurity of each row of class counts; 0 without any."""
    n = np.maximum(counts.sum(axis=1), 1)[:, None]
    return np.where(counts.any(axis=1), 1 - ((counts / n) ** 2).sum(axis=1), 0.0)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            held.append(batch.slice(start, rows))
            if sum(b.num_rows for b in held) >= rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _in_passes(tasks: list[Task], cuts: Cuts, classes: int, max_bytes: int) -> Iterator[list[Task]]:
    """Nodes whose counts fit into the memory of a task, one node at least."""
    held, size = [], 0
    for task in tasks:
        own = 8 * classes * (1 + int(np.sum(cuts.numbers[task.places] + 1)))
        if held and size + own > max_bytes:
            yield held
            held, size = [], 0
        held.append(task)
        size += own
    if held:
        yield held


def grow(rows: DataFrame, cuts: Cuts, slots: int, classes: int, trees: int, depth: int, seed: int, max_bytes: int) -> list[Tree]:
    """Trees over the stored rows, level by level, each node with slots of its own draw."""
    grown = [Tree() for _ in range(trees)]
    drawn = slots if trees == 1 else math.ceil(math.sqrt(slots))
    place_of = {int(s): p for p, s in enumerate(cuts.slots)}

    def task(tree: int, node: int) -> Task:
        some = np.random.default_rng([seed, tree, node]).choice(slots, drawn, replace=False)
        return Task(tree, node, np.array(sorted(place_of[s] for s in some.tolist() if s in place_of), np.int64))

    frontier = [task(t, 0) for t in range(trees)]
    for level in range(depth):
        grown_here = []
        for tasks in _in_passes(frontier, cuts, classes, max_bytes):
            step = Level(cuts, classes, grown, tasks, seed)
            counted = rows.mapInArrow(step.count, "task int, counts array<bigint>")
            found = counted.groupBy("task").applyInArrow(lambda table: step.best(table), "task int, gain double, place int, last int, left array<bigint>, right array<bigint>")
            grown_here += [(tasks[r["task"]], r) for r in found.collect()]  # a row for each node
        children = []
        for at, r in grown_here:
            tree, left = grown[at.tree], 2 * at.node + 1
            tree.splits[at.node], tree.gains[at.node] = (r["place"], r["last"]), r["gain"]
            tree.counts[at.node] = [a + b for a, b in zip(r["left"], r["right"])]
            for child, counts in ((left, r["left"]), (left + 1, r["right"])):
                tree.counts[child] = list(counts)
                if sum(c > 0 for c in counts) > 1:
                    children.append((at.tree, child))
        frontier = [task(t, node) for t, node in sorted(children)]
    return grown


def _root_counts(rows: DataFrame, lone: list[int], classes: int, cuts: Cuts, seed: int) -> dict[int, list[int]]:
    """Classes of the rows drawn by trees that are not split at all."""
    step = Level(cuts, classes, [], [Task(t, 0, np.array([], np.int64)) for t in lone], seed)
    counted = rows.mapInArrow(step.count, "task int, counts array<bigint>").select("task", F.posexplode("counts").alias("class", "n"))
    found = {t: [0] * classes for t in lone}
    for k, c, n in counted.groupBy("task", "class").agg(F.sum("n")).collect():
        found[lone[k]][c] = n
    return found


def _model(spark: SparkSession, trees: list[Tree], cuts: Cuts, slots: int, classes: int) -> RandomForestClassificationModel:
    """MLlib's model of the trees. It has no public way to make one, so its nodes are made by their constructors.

    Like there, two leaves that predict the same class become one.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    made, double = jvm.org.apache.spark.ml.tree, jvm.double
    inner, leaf, cut, calculator = made.InternalNode, made.LeafNode, made.ContinuousSplit, jvm.org.apache.spark.mllib.tree.impurity.GiniCalculator

    def merged(tree: Tree, k: int) -> int | None:
        """The class that all leaves below predict, if it is one."""
        counts = tree.counts[k]
        if k not in tree.splits:
            return counts.index(max(counts))
        left, right = merged(tree, 2 * k + 1), merged(tree, 2 * k + 2)
        return counts.index(max(counts)) if left is not None and left == right else None

    def node(tree: Tree, k: int):
        counts = tree.counts[k]
        held = gateway.new_array(double, classes)
        for c, n in enumerate(counts):
            if n:
                held[c] = float(n)
        stats = calculator(held, sum(counts))
        best, impurity = float(counts.index(max(counts))), float(gini(np.array([counts]))[0])
        if merged(tree, k) is not None:
            return leaf(best, impurity, stats)
        place, last = tree.splits[k]
        split = cut(int(cuts.slots[place]), float(cuts.cuts[place, last]))
        return inner(best, impurity, tree.gains[k], node(tree, 2 * k + 1), node(tree, 2 * k + 2), split, stats)

    member, forest = jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, jvm.org.apache.spark.ml.classification.RandomForestClassificationModel
    members = gateway.new_array(member, len(trees))
    for i, tree in enumerate(trees):
        members[i] = member(node(tree, 0), slots, classes)
    return RandomForestClassificationModel(forest(members, slots, classes))


def fit(df: DataFrame, settings: RandomForestClassifier) -> RandomForestClassificationModel:
    """The forest that ``settings`` describe, of which trees, depth, seed, memory and columns are read.

    Each tree draws every row a Poisson number of times, each node the square root of the slots; impurity is Gini's, slots have 32 bins at most,
    cut as MLlib cuts them, and all count as numbers. Three reads of ``df``, a narrow stage table, and a pass over that for each level. Drivers
    and groups hold counts by node alone, whose size does not follow the rows.
    Cases: an empty table, labels that are no whole numbers from 0 to 99, null vectors and values that are not finite raise an error. The model has no
    summary of its training.
    """
    spark, seed = df.sparkSession, settings.getSeed() & 0x7FFFFFFF
    features, label = F.unwrap_udt(settings.getFeaturesCol()), F.col(settings.getLabelCol()).cast("double")
    rows = df.select(features.alias("v"), label.alias("label"))
    seen = rows.agg(F.count("*").alias("n"), F.max("label").alias("high"), F.count_if(F.col("label").isNull()).alias("nulls")).head()
    if not seen["n"] or seen["nulls"] or not 0 <= seen["high"] < CLASSES:
        raise ValueError(f"a forest needs rows, and labels from 0 to {CLASSES - 1}: {seen}")
    first = rows.where("v is not null").select("v.size", F.size("v.values").alias("n")).head()
    if first is None:
        raise ValueError("no vector of the forest's rows is other than null")
    slots, classes = first["n"] if first["size"] is None else first["size"], int(seen["high"]) + 1
    cuts = find_cuts(rows, seen["n"], seed)
    trees, depth = settings.getNumTrees(), settings.getMaxDepth()
    with Workspace(spark) as workspace:
        numbered = rows.select(F.monotonically_increasing_id().alias("id"), "label", "v")
        binned = workspace.stage(numbered.mapInArrow(_binned(cuts, slots, classes), "id bigint, class int, codes array<int>"), "binned")
        grown = grow(binned, cuts, slots, classes, trees, depth, seed, settings.getMaxMemoryInMB() << 20)
        if lone := [t for t, tree in enumerate(grown) if not tree.counts]:
            for t, counts in _root_counts(binned, lone, classes, cuts, seed).items():
                grown[t].counts[0] = counts
    model = settings._copyValues(_model(spark, grown, cuts, slots, classes))
    model._transfer_params_to_java()
    return model
