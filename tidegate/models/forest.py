"""Random forest with balanced class weights, grown and stored by tasks.

Each tree takes every training row as often as a seeded Poisson count of its key says. Nodes of more than
`SUBTREE_ROWS` rows are split by counts per feature and byte; smaller ones are grown on their rows. A table of up to
`HELD_PARTS` times as many rows is read as a whole by each task, which grows some trees of it without a shuffle. Of a larger
one, the counts are summed over all tasks, and the rows of one small node meet in the task that grows it; both ways lead to
the same trees. Trees are written to the shared checkpoint folder by the tasks that grew them, and scored by tasks that read
a file of trees at a time: the driver holds only cuts of features and splits of nodes too large for a task.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegate.functions.hashing import row_hash
from tidegate.models import trees as T
from tidegate.models.linear import class_weights
from tidegate.operators.metrics import add_rates, confusion_counts
from tidegate.operators.sampling import stratified_folds, subsample_rows
from tidegate.session import fit_input, scratch_path

MAX_DEPTH = 30
#: Rows of one node that one task may grow on: one byte a feature each.
SUBTREE_ROWS = 100_000
#: How many times as many rows of a whole table a task may hold.
HELD_PARTS = 10
TREES_PER_TASK = 4
ROWS_PER_TASK = 10_000
#: Rows binned or scored at once.
CHUNK = 50_000
#: Accuracy of the quantiles that become cuts.
CUT_ACCURACY = 4_000
MOST_FILES = 200
ROWS = "key long, y int, bytes binary"
NODES = "tree int, root long, feature binary, cut binary, left binary, share binary"
WHOLE_TREES = "forest int, " + NODES
BEST = "tree int, node long, feature int, cut int, sides array<array<long>>"
KINDS = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "share": np.float32}


@dataclass(frozen=True)
class RandomForest:
    """Folder of node arrays, cuts per feature, and by tree the splits and the leaves (shares) above the stored nodes."""

    path: str
    trees: int
    cuts: list[np.ndarray]
    splits: dict[int, dict[int, tuple[int, int]]] = field(default_factory=dict)
    leaves: dict[int, dict[int, float]] = field(default_factory=dict)

    def score(self, vector: str = "features") -> Column:
        """Mean share of class 1 over the trees; narrow, so it also runs on streams."""
        return mean_shares([self], vector)[0]

    def mean_shares(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for tree, splits in self.splits.items():
            at = T.route(rows, splits)
            for node, share in self.leaves.get(tree, {}).items():
                total[at == node] += share
        for tree, root, nodes in stored_nodes(self.path):
            if tree in self.splits:
                here = np.flatnonzero(T.route(rows, self.splits[tree]) == root)
                total[here] += T.shares(rows[here], nodes)
            else:
                total += T.shares(rows, nodes)
        return total / self.trees


def mean_shares(forests: Sequence[RandomForest], vector: str = "features") -> Column:
    """The score of every forest, as an array column; a task reads one file of trees after the other."""

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, size = [], 0

        def shares():
            found = np.empty((size, len(forests)))
            for i, forest in enumerate(forests):
                found[:, i] = forest.mean_shares(np.concatenate([to_bytes(values, forest.cuts) for values in held]))
            return pd.Series(list(found))

        for batch in batches:
            if len(batch):
                held.append(np.stack(batch.to_numpy()))
                size += len(batch)
            if size >= CHUNK:
                yield shares()
                held, size = [], 0
        if size:
            yield shares()

    return scored(vector_to_array(F.col(vector)))


def _stored(path: str) -> Iterator[pa.Table]:
    """The Parquet files of a folder, by name; none if no task wrote to it."""
    store, place = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and path[5:7] != "//" else path)
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
    for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with store.open_input_file(name) as file:
            yield pq.read_table(file)


def stored_nodes(path: str) -> Iterator[tuple[int, int, tuple]]:
    """tree, root and node arrays of every stored part, file by file."""
    for table in _stored(path):
        for part in table.sort_by([("tree", "ascending"), ("root", "ascending")]).to_pylist():
            yield part["tree"], part["root"], tuple(np.frombuffer(part[c], kind) for c, kind in KINDS.items())


def to_bytes(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """One byte per feature: how many of its cuts are below the value."""
    return np.stack([np.searchsorted(c, values[:, i]).astype(np.uint8) for i, c in enumerate(cuts)], axis=1)


def feature_cuts(rows: DataFrame, vector: str = "_x") -> list[np.ndarray]:
    """Up to 255 cuts per feature, at its quantiles; none above the largest value."""
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    steps = ", ".join(f"{i / (T.BINS - 1)!r}D" for i in range(T.BINS))
    cells = ", ".join(f"percentile_approx({vector}[{i}], array({steps}), {CUT_ACCURACY})" for i in range(width))
    found = rows.agg(F.expr(f"array({cells})").alias("q")).first().q if width else []
    return [np.unique(np.array(q, float))[:-1][:T.BINS - 1] for q in found]


def _binned(cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                rows = [r.tobytes() for r in to_bytes(values, cuts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("y"), pa.array(rows, pa.binary())], ["key", "y", "bytes"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch], width: int, size: int = CHUNK):
    """Keys, classes and bytes of a task's rows, `size` or a few more at a time."""
    held, count = [], 0

    def joined():
        table = pa.Table.from_batches(held)
        rows = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(-1, width)
        return table.column("key").to_numpy(), table.column("y").to_numpy().astype(np.uint8), rows

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= size:
            yield joined()
            held, count = [], 0
    if count:
        yield joined()


class _Growth(NamedTuple):
    """What a forest is grown by: tables of `rows` rows and `width` features, of which a node looks at `tried`."""

    trees: int
    depth: int
    seed: int
    most: int
    rows: int
    width: int
    weights: tuple[float, float]
    mixed: bool

    @property
    def tried(self) -> int:
        return math.ceil(math.sqrt(self.width))

    @property
    def large(self) -> bool:
        return self.rows > self.most and self.mixed and self.depth > 0

    def features(self, tree: int, node: int, time: int) -> np.ndarray:
        """The features that a large node looks at, the `time`-th time that it does."""
        first = time * self.tried
        return T.feature_order(self.seed, tree, node << 6, 1, self.width)[0][first : first + self.tried]

    def part(self, tree: int, root: int, rows, y, times):
        """Node arrays of the part of a tree below `root`."""
        return T.grow(rows, y, times, self.weights, self.depth - root.bit_length() + 1, self.tried, self.seed, tree, root)


class _Best(NamedTuple):
    tree: int
    node: int
    feature: int
    cut: int
    sides: list


def _counts(table: np.ndarray, y: np.ndarray, times: np.ndarray, here: np.ndarray, features) -> np.ndarray:
    """Per feature and byte: taken rows of class 0, of class 1, and rows, of the rows `here`."""
    counts = np.zeros((len(features), T.BINS, 3), np.int64)
    for place, f in enumerate(features):
        byte = table[here, f]
        counts[place, :, :2] = np.bincount(byte.astype(np.int64) * 2 + y[here], times[here], 2 * T.BINS).reshape(-1, 2)
        counts[place, :, 2] = np.bincount(byte, minlength=T.BINS)
    return counts


def _best_split(tree: int, node: int, counts: np.ndarray, features, weights) -> _Best:
    """The split by these features; feature -1 if none parts the rows."""
    found, top = (-1, 0, [counts[0].sum(axis=0).tolist()]), -1.0
    for f, cells in zip(features, counts, strict=True):
        used = np.flatnonzero(cells[:, 2])
        below = np.cumsum(cells[used], axis=0)
        low, high = below[:-1], below[-1] - below[:-1]
        if len(low):
            value = T.purity(low[:, 0], low[:, 1], weights) + T.purity(high[:, 0], high[:, 1], weights)
            i = int(np.argmax(value))
            if value[i] > top:
                found, top = (int(f), int(used[i] + used[i + 1] - 1) // 2, [low[i].tolist(), high[i].tolist()]), value[i]
    return _Best(tree, node, *found)


def _large_nodes(rows: DataFrame, wanted: dict, splits: dict, growth: _Growth) -> list:
    """Best split of each wanted (tree, node), by the features that it looks at the `wanted`-th time."""
    by_tree = defaultdict(list)
    for tree, node in wanted:
        by_tree[tree].append(node)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for keys, y, table in _chunks(batches, growth.width):
            for tree, nodes in by_tree.items():
                times, at = T.bootstrap(keys, tree), T.route(table, splits.get(tree, {}))
                for node in nodes:
                    here = np.flatnonzero((at == node) & (times > 0))
                    counts = _counts(table, y, times, here, growth.features(tree, node, wanted[tree, node]))
                    sums[tree, node] = sums.get((tree, node), 0) + counts
        for (tree, node), counts in sums.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "node": [node], "counts": [counts.tobytes()]})

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(key[0]), int(key[1])
        counts = sum(np.frombuffer(c, np.int64).reshape(-1, T.BINS, 3) for c in pdf["counts"])
        found = _best_split(tree, node, counts, growth.features(tree, node, wanted[tree, node]), growth.weights)
        return pd.DataFrame([found], columns=_Best._fields)

    counted = rows.mapInArrow(count, "tree int, node long, counts binary")
    return counted.groupBy("tree", "node").applyInPandas(best, BEST).collect()


def _large_nodes_here(table: np.ndarray, y: np.ndarray, times: np.ndarray, wanted: dict, splits: dict, growth: _Growth) -> list:
    """The same for one tree whose rows are all here."""
    found = []
    for (tree, node), time in wanted.items():
        features = growth.features(tree, node, time)
        here = np.flatnonzero((T.route(table, splits.get(tree, {})) == node) & (times > 0))
        found.append(_best_split(tree, node, _counts(table, y, times, here, features), features, growth.weights))
    return found


def _upper_splits(best_splits: Callable, trees: Sequence[int], growth: _Growth):
    """Splits and leaves of each tree above nodes of at most `most` rows."""
    splits, leaves = defaultdict(dict), defaultdict(dict)
    wanted = {(tree, 1): 0 for tree in trees}
    while wanted:
        following = {}
        for r in best_splits(wanted, splits):
            if r.feature < 0:
                again = wanted[r.tree, r.node] + 1
                if again * growth.tried < growth.width:
                    following[r.tree, r.node] = again
                else:
                    leaves[r.tree][r.node] = _share(r.sides[0], growth.weights)
                continue
            splits[r.tree][r.node] = (r.feature, r.cut)
            for child, side in zip((2 * r.node, 2 * r.node + 1), r.sides, strict=True):
                if side[0] == 0 or side[1] == 0 or child.bit_length() > growth.depth:
                    leaves[r.tree][child] = _share(side, growth.weights)
                elif side[2] > growth.most:
                    following[r.tree, child] = 0
        wanted = following
    # a root that cannot be split
    for tree in [t for t in leaves if t not in splits]:
        splits[tree] = {}
    return dict(splits), dict(leaves)


def _share(side, weights) -> float:
    return weights[1] * side[1] / (weights[0] * side[0] + weights[1] * side[1])


def _dealt(trees: int, splits: dict, leaves: dict, width: int):
    """Blocks of (key of a part, classes, counts, bytes) that the task which grows a part reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, y, table in _chunks(batches, width):
            for tree in range(trees):
                times = T.bootstrap(keys, tree)
                at = np.where(times > 0, T.route(table, splits.get(tree, {})), 0)
                for root in np.unique(at[at > 0]).tolist():
                    if root not in leaves.get(tree, {}):
                        here = np.flatnonzero(at == root)
                        yield pa.RecordBatch.from_pydict({
                            "tree": pa.array([tree], pa.int32()), "root": [root], "y": [y[here].tobytes()],
                            "times": [times[here].tobytes()], "bytes": [table[here].tobytes()]})

    return run


def _whole_tree(table: np.ndarray, y: np.ndarray, times: np.ndarray, tree: int, growth: _Growth):
    """Node arrays of one tree by all its rows."""
    splits, leaves = {}, {}
    if growth.large:
        splits, leaves = _upper_splits(
            lambda wanted, splits: _large_nodes_here(table, y, times, wanted, splits, growth), [tree], growth)
    splits, leaves, parts = splits.get(tree, {}), leaves.get(tree, {}), {}
    at = np.where(times > 0, T.route(table, splits), 0)
    for root in np.unique(at[at > 0]).tolist():
        if root not in leaves:
            here = np.flatnonzero(at == root)
            parts[root] = growth.part(tree, root, table.T.take(here, axis=1).T, y[here], times[here])
    return T.joined(splits, leaves, parts) if splits or leaves or parts else None


def _grow_whole(tables: list[tuple[str, _Growth]], trees: int):
    """Grows the trees that the numbers of a task name, forest by forest; a task holds one table at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for number in batch.column(0).to_pylist():
                forest, tree = divmod(number, trees)
                path, growth = tables[forest]
                if held != forest:
                    parts = (batch for stored in _stored(path) for batch in stored.to_batches())
                    keys, y, table = next(_chunks(parts, growth.width, math.inf))
                    table, held = np.ascontiguousarray(table.T).T, forest
                nodes = _whole_tree(table, y, T.bootstrap(keys, tree), tree, growth)
                if nodes:
                    yield pa.RecordBatch.from_pydict({
                        "forest": pa.array([forest], pa.int32()), "tree": pa.array([tree], pa.int32()), "root": [1],
                        **{c: [a.tobytes()] for c, a in zip(KINDS, nodes, strict=True)}})

    return run


def _grow_parts(rows: DataFrame, growth: _Growth, path: str) -> tuple[dict, dict]:
    """Splits and leaves above the parts, which are written by the tasks that grow them."""
    splits, leaves = {}, {}
    if growth.large:
        splits, leaves = _upper_splits(
            lambda wanted, splits: _large_nodes(rows, wanted, splits, growth), range(growth.trees), growth)

    def grown(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, root = int(key[0]), int(key[1])
        y, times, table = (np.frombuffer(b"".join(pdf[c]), np.uint8) for c in ("y", "times", "bytes"))
        nodes = growth.part(tree, root, table.reshape(len(y), -1), y, times)
        return pd.DataFrame([(tree, root, *(a.tobytes() for a in nodes))], columns=["tree", "root", *KINDS])

    blocks = rows.mapInArrow(
        _dealt(growth.trees, splits, leaves, growth.width), "tree int, root long, y binary, times binary, bytes binary")
    blocks.repartition(min(growth.trees, MOST_FILES), "tree").groupBy("tree", "root").applyInPandas(grown, NODES).write.parquet(path)
    return splits, leaves


def fit_random_forest(
    train: DataFrame, trees: int = 400, depth: int = 30, seed: int = 42, subtree_rows: int = SUBTREE_ROWS
) -> RandomForest:
    """Expects features, y. Weights are balanced over the whole training set; row_id, if there, names a row."""
    return fit_random_forests(train, [None], trees, depth, seed, subtree_rows)[0]


def fit_random_forests(
    train: DataFrame, without: Sequence[str | None], trees: int = 400, depth: int = 30, seed: int = 42,
    subtree_rows: int = SUBTREE_ROWS,
) -> list[RandomForest]:
    """A forest for each entry: without the rows of that category, or on all rows (None). The trees of all grow side by side."""
    spark, depth = train.sparkSession, min(depth, MAX_DEPTH)
    identity = "row_id" if "row_id" in train.columns else F.monotonically_increasing_id()
    named = train.select(row_hash(seed, [identity]).alias("key"), F.col("y").cast("int").alias("y"),
                         vector_to_array("features").alias("_x"), *[c for c in ["category"] if any(x is not None for x in without)])
    kept = [F.lit(True) if category is None else F.col("category") != category for category in without]
    sizes = train.agg(*[F.count_if((F.col("y") == y) & keep) for keep in kept for y in (0, 1)], F.count(F.lit(1))).first()
    path, whole, forests = scratch_path(spark, "forest"), [], [None] * len(without)
    with fit_input(named.repartition(max(1, math.ceil(sizes[-1] / ROWS_PER_TASK))), "forest-rows") as values:
        for i, keep in enumerate(kept):
            n0, n1 = sizes[2 * i : 2 * i + 2]
            cuts = feature_cuts(values.filter(keep))
            growth = _Growth(trees, depth, seed, subtree_rows, n0 + n1, len(cuts), class_weights(n0, n1), n0 > 0 and n1 > 0)
            binned = values.filter(keep).select("key", "y", "_x").mapInArrow(_binned(cuts), ROWS)
            if growth.rows <= HELD_PARTS * subtree_rows:
                rows = scratch_path(spark, "forest-bytes")
                binned.write.parquet(rows)
                forests[i] = RandomForest(f"{path}/forest={len(whole)}", trees, cuts)
                if growth.rows:
                    whole.append((rows, growth))
            else:
                with fit_input(binned, "forest-bytes") as rows:
                    forests[i] = RandomForest(f"{path}-{i}", trees, cuts, *_grow_parts(rows, growth, f"{path}-{i}"))
        if whole:
            numbers = spark.range(0, len(whole) * trees, 1, max(1, math.ceil(len(whole) * trees / TREES_PER_TASK)))
            grown = numbers.mapInArrow(_grow_whole(whole, trees), WHOLE_TREES)
            grown.write.partitionBy("forest").parquet(path)
    return forests


def save_random_forest(model: RandomForest, spark: SparkSession, path: str) -> None:
    """Folders nodes and info."""
    stored = spark.read.parquet(model.path)
    stored.repartition(min(model.trees, MOST_FILES), "tree").write.mode("overwrite").parquet(f"{path}/nodes")
    upper = [(t, n, f, c, None) for t, found in model.splits.items() for n, (f, c) in found.items()]
    upper += [(t, n, None, None, s) for t, found in model.leaves.items() for n, s in found.items()]
    spark.createDataFrame(
        [(model.trees, [c.tolist() for c in model.cuts], upper)],
        "trees int, cuts array<array<double>>, upper array<struct<tree:int,node:long,feature:int,cut:int,share:double>>",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/info")


def load_random_forest(spark: SparkSession, path: str) -> RandomForest:
    info = spark.read.parquet(f"{path}/info").first()
    splits, leaves = defaultdict(dict), defaultdict(dict)
    for r in info.upper:
        splits[r.tree] |= {r.node: (r.feature, r.cut)} if r.feature is not None else {}
        if r.feature is None:
            leaves[r.tree][r.node] = r.share
    return RandomForest(f"{path}/nodes", info.trees, [np.array(c) for c in info.cuts], dict(splits), dict(leaves))


def score_forest(model: RandomForest, df: DataFrame, output: str = "p") -> DataFrame:
    return df.withColumn(output, model.score())


def fold_macro_f1(predictions: DataFrame) -> float:
    """Mean over the folds of the macro-F1 within a fold; expects fold, y, yhat."""
    table = add_rates(confusion_counts(predictions, ["fold"]), ["macro_f1"])
    return float(table.agg(F.avg("macro_f1")).first()[0])


def forest_cv_score(train: DataFrame, trees: int, depth: int, seed: int, rows: int | None, folds: int = 3) -> float:
    """Cross-validated macro-F1 of the forest on an exact-size subsample (None: all rows)."""
    sample = subsample_rows(train.select("row_id", "features", "y"), rows, seed, key=["row_id"])
    with fit_input(stratified_folds(sample, folds, seed, key=["row_id"])) as split:
        parts = []
        for fold in range(folds):
            model = fit_random_forest(split.filter(F.col("fold") != fold), trees, depth, seed)
            scored = score_forest(model, split.filter(F.col("fold") == fold))
            parts.append(scored.select("fold", "y", (F.col("p") > 0.5).cast("int").alias("yhat")))
        predictions = parts[0]
        for part in parts[1:]:
            predictions = predictions.unionByName(part)
        return fold_macro_f1(predictions)
