"""M6 / M7 on many rows: MLlib's random forest grown over bin numbers.

MLlib keeps a number for each expanded feature of a row, 9.7 KB a row for a column of 2,405 levels,
and meets each row again for every tree and level.  Here a row keeps one whole number a column: the bin
of a numeric column, the level of a one-hot one.  A level's feature is 1 in the rows of that level and 0 in
all others, so counts by level and a node's total say what MLlib counts for each feature apart.

The trees are MLlib's: Poisson bootstrap, at most ``maxBins`` bins, a fresh draw of features for each
node, Gini impurity with class weights or variance, splits while they gain and up to ``maxDepth``, equal
sibling leaves merged.  The first of equal gains wins.  Two things differ: thresholds come from the quantiles
of all rows, where MLlib takes some 10,000, and the random draws are numpy's.  A tree without either (few
values a column, no bootstrap, all features) is MLlib's node for node.

* ``_items``: one pass bins the rows and draws their bootstrap counts.  Where few combinations of
  bins (cells) are possible, rows of a cell can't be told apart by any tree: each task sums them
  and the passes below meet cells alone.  Otherwise a row is stored with a byte a tree.
* a level of all trees is one pass: tasks walk their rows down to the open nodes and count the
  features drawn there, a node's counts meet in one group, which chooses its split.  Levels whose
  counts pass ``GROUP_BYTES`` a task take several passes.
* the driver holds the nodes alone.  They are stored in MLlib's format and loaded as its model, which
  scores rows and gives importances.
"""

from __future__ import annotations

import json
import math
import sys
import time
import uuid

from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.roles import qcol
from tabprofile.session import ensure_checkpoint_dir
from tabprofile.sources.sinks import shared_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASK_ROWS = 1 << 20      # rows binned in one task
CHUNK_ROWS = 1 << 17     # rows walked down the trees at a time ...
CHUNK_BYTES = 32 << 20   # ... of no more bytes than these
CELL_BYTES = 32 << 20    # sums of all cells in one task; with more of them rows stay apart
GROUP_BYTES = 128 << 20  # counts of open nodes in one task
BLOCK_BYTES = 1 << 20    # counts of neighbouring nodes that travel together
RANKS = 10_000           # ranks that quantiles tell apart
LOOKUP = 1 << 22         # numbers in a table of wanted (node, bin) pairs; a longer one is searched
EPSILON = 2.0 ** -52     # MLlib's: a purer node is a leaf
BEST = "tree int, node int, feature int, code int, gain double, total array<double>, left array<double>"
NODE = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
        "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


def grown(ready: DataFrame, prep_stages: list, forest, rows: int):
    """MLlib's model of the estimator ``forest`` for the ``rows`` rows of ``ready``, the table that
    ``prep_stages`` (indexers, encoders and last the assembler of ``features``) made."""
    import numpy as np
    cols = _columns(ready, prep_stages)
    classes = "RandomForestClassif" in type(forest).__name__
    plan = {"trees": forest.getNumTrees(), "numeric": np.array([c[2] is None for c in cols]), "seed": forest.getSeed(),
            "rate": forest.getSubsamplingRate(), "bootstrap": forest.getBootstrap(), "depth": forest.getMaxDepth(),
            "min_rows": forest.getMinInstancesPerNode(), "min_gain": forest.getMinInfoGain(), "weights": None, "stats": 3}
    if classes:
        n = len(ready.schema["label"].metadata["ml_attr"]["vals"])
        plan.update(stats=n, weights=np.zeros(n))
        for r in ready.select("label", "weight").distinct().collect():  # one row a class
            plan["weights"][int(r["label"])] = r["weight"]
    cuts = _thresholds(ready, [c[0] for c in cols if c[2] is None], min(forest.getMaxBins(), rows))
    plan["cuts"] = [cuts.get(c[0]) for c in cols]
    plan["bins"] = [len(cuts[c[0]]) + 1 if c[2] is None else c[2] + 1 for c in cols]
    size = [1 if c[2] is None else c[2] for c in cols]
    plan["column"] = np.repeat(np.arange(len(cols)), size)
    plan["first"] = np.cumsum([0, *size])[:-1]
    plan["slots"] = np.repeat([b if c[2] is None else 1 for b, c in zip(plan["bins"], cols)], size)
    features = int(sum(size))
    plan["draw"] = {"all": features, "sqrt": math.ceil(math.sqrt(features))}[forest.getFeatureSubsetStrategy()]
    plan["cells"] = math.prod(plan["bins"]) * (plan["stats"] if classes else 3) * plan["trees"] * 8 <= CELL_BYTES
    items = _items(ready, cols, plan, rows)
    return _stored(ready.sparkSession, _grow(items, plan), plan, forest, features)


def _columns(ready: DataFrame, prep_stages: list) -> list[tuple]:
    """``(column, feature, levels)`` in the order of the features, ``levels`` None for a numeric column and
    the names standing for number and level; checked against the vector's width."""
    source = {s.getOutputCol(): s.getInputCol() for s in prep_stages if isinstance(s, OneHotEncoder)}
    out, at = [], 0
    for name in prep_stages[-1].getInputCols():
        levels = ready.schema[name].metadata["ml_attr"]["num_attrs"] if name in source else None
        out.append((source.get(name, name), at, levels))
        at += 1 if levels is None else levels
    if at != ready.schema["features"].metadata["ml_attr"]["num_attrs"]:
        raise ValueError("the assembled features are not the numeric and one-hot columns")
    return out


def _thresholds(df: DataFrame, cols: list[str], max_bins: int) -> dict:
    """At most ``max_bins - 1`` thresholds a numeric column, from all rows: the middles between its
    values where they are few, else quantiles, right to a row in ``RANKS``.  A value that fills several
    bins gets one of its own and the others share the rest."""
    import numpy as np
    if not cols:
        return {}
    df = df.select(*[qcol(c).cast("double").alias(c) for c in cols])

    def parts(c, bins):
        return F.percentile_approx(c, [i / bins for i in range(1, bins)], RANKS)

    one = df.agg(*[f(qcol(c)).alias(f"{name}_{c}") for c in cols for name, f in (("n", F.approx_count_distinct), ("top", F.max))],
                 *[parts(qcol(c), max_bins).alias(f"cuts_{c}") for c in cols if max_bins > 1]).first()
    few = [c for c in cols if one[f"n_{c}"] <= 2 * max_bins]
    sets = df.agg(*[F.collect_set(qcol(c)).alias(c) for c in few]).first() if few else {}  # some 2 x max_bins values a column
    cuts = {}
    for c in cols:
        if c in few and len(sets[c]) <= max_bins:
            values = np.sort(sets[c])
            cuts[c] = (values[1:] + values[:-1]) / 2
            continue
        values, times = np.unique(one[f"cuts_{c}"] if max_bins > 1 else [], return_counts=True)
        hot = [float(v) for v in values[times > 1]]
        if hot:
            bins = max_bins - 2 * len(hot)
            free = df.where(~qcol(c).isin(hot)).agg(parts(qcol(c), bins)).first()[0] if bins > 1 else None
            values = np.unique([*(free or []), *hot, *[float(np.nextafter(v, -np.inf)) for v in hot]])
        cuts[c] = values[values < one[f"top_{c}"]]
    return cuts


def _items(ready: DataFrame, cols: list[tuple], plan: dict, rows: int) -> DataFrame:
    """The stored table of cells or rows: bin numbers ``k0``, ``k1``, ..., ``y`` (the class; the label of a
    row in a regression) and ``drawn``, for each tree a byte, the row's bootstrap count, or for a cell
    8-byte sums: the counts, in a regression also those of label and squared label."""
    import numpy as np
    import pyarrow as pa
    names, trees, classes = [f"k{i}" for i in range(len(cols))], plan["trees"], plan["weights"] is not None
    raw = ready.select(*[qcol(c).cast("double" if n is None else "int").alias(k) for k, (c, _, n) in zip(names, cols)], F.col("label").alias("y"))
    parts = max(math.ceil(rows / TASK_ROWS), ready.sparkSession.sparkContext.defaultParallelism)

    def draws(rng, n):
        if plan["bootstrap"]:
            return np.minimum(rng.poisson(plan["rate"], (trees, n)), 255).astype(np.uint8)
        return (rng.random((trees, n)) < plan["rate"]).astype(np.uint8)

    def batch_of(codes, y, drawn):
        arrays = [pa.array(c.astype(np.int32)) for c in codes] + [pa.array(np.asarray(y, "float64"))]
        ends = np.arange(len(drawn) + 1, dtype=np.int32) * drawn[:1].nbytes
        blob = pa.Array.from_buffers(pa.binary(), len(drawn), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(drawn))])
        return pa.RecordBatch.from_arrays([*arrays, blob], [*names, "y", "drawn"])

    def task(batches):
        from pyspark import TaskContext
        rng = np.random.default_rng([plan["seed"] & (2 ** 63 - 1), TaskContext.get().partitionId()])
        shape = [*plan["bins"], *([plan["stats"]] if classes else [])]
        cells = math.prod(shape)
        sums = np.zeros((trees, 1 if classes else 3, cells)) if plan["cells"] else None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = []
            for i, cuts in enumerate(plan["cuts"]):
                v = batch.column(i).to_numpy(zero_copy_only=False)
                codes.append(np.searchsorted(cuts, v) if cuts is not None else np.minimum(v, plan["bins"][i] - 1))
            y, drawn = batch.column(len(codes)).to_numpy(zero_copy_only=False), draws(rng, batch.num_rows)
            if sums is None:
                yield batch_of(codes, y, drawn.T)
                continue
            cell = np.ravel_multi_index([*codes, *([y.astype(int)] if classes else [])], shape)
            for t in range(trees):
                for s, k in zip(sums[t], [drawn[t]] if classes else [drawn[t], drawn[t] * y, drawn[t] * y * y]):
                    s += np.bincount(cell, k, cells)
        if sums is not None:
            used = np.flatnonzero(sums[:, 0].any(0))
            for start in range(0, len(used), 1024):
                at = used[start:start + 1024]
                codes = np.unravel_index(at, shape)
                yield batch_of(codes[:len(names)], codes[-1] if classes else np.zeros(len(at)), sums[:, :, at].transpose(2, 0, 1))

    schema = ", ".join([*[f"{k} int" for k in names], "y double", "drawn binary"])
    return shared_table(raw.repartition(parts).mapInArrow(task, schema), "forest-rows")


def _layout(plan: dict, drawn):
    """Where the counts of nodes lie: a slot for the total of each node (``heads``), then one for each
    drawn level and one for each bin of a drawn numeric column (``starts``); and the number of slots."""
    import numpy as np
    width = plan["slots"][drawn]
    ends = np.cumsum(1 + width.sum(1))
    heads = np.concatenate([[0], ends[:-1]])
    return heads, heads[:, None] + 1 + np.cumsum(width, 1) - width, int(ends[-1])


def _drawn(plan: dict, open_nodes: dict) -> dict:
    """The features of each open node, ascending."""
    import numpy as np
    n, out = len(plan["column"]), {}
    for t, nodes in open_nodes.items():
        rng = np.random.default_rng([plan["seed"] & (2 ** 63 - 1), t, int(nodes[0])])
        rows = [np.arange(n) if plan["draw"] == n else np.sort(rng.choice(n, plan["draw"], replace=False)) for _ in nodes]
        out[t] = np.array(rows, np.int32)
    return out


def _walk(tree: tuple, codes, numeric, depth: int):
    """The node of ``tree`` that each row (a column of ``codes``) has reached."""
    import numpy as np
    column, code, left = tree
    node, every = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
    for _ in range(depth):
        c = column[node]
        value, cut = codes[c, every], code[node]
        right = np.where(numeric[c], value > cut, value == cut)
        node = np.where(c < 0, node, left[node] + right)
    return node


def _places(keys, wanted, slots, size: int):
    """The slot of each key, -1 for one that isn't in ``wanted`` (ascending)."""
    import numpy as np
    if size <= LOOKUP:
        table = np.full(size, -1, np.int64)
        table[wanted] = slots
        return table[keys]
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return np.where(wanted[at] == keys, slots[at], -1)


def _wanted(plan: dict, drawn, starts) -> list[tuple]:
    """For each column ``(keys, slots)``: node x bins + bin for the bins that are counted."""
    import numpy as np
    out, owner = [], plan["column"][drawn]
    for c, bins in enumerate(plan["bins"]):
        node, place = np.nonzero(owner == c)
        first = starts[node, place]
        if plan["numeric"][c]:
            bin_ = np.arange(bins)
            out.append(((node[:, None] * bins + bin_).ravel(), (first[:, None] + bin_).ravel()))
        else:
            out.append((node * bins + drawn[node, place] - plan["first"][c], first))
    return out


def _count(plan: dict, trees: dict, open_nodes: dict, drawn: dict, depth: int):
    """The task of a pass: the counts of its rows at the open nodes, in blocks of nodes."""
    import numpy as np
    import pyarrow as pa
    classes, s = plan["weights"] is not None, plan["stats"]

    def add(held, sums, layouts):
        table = [[b.column(i).to_numpy(zero_copy_only=False) for b in held] for i in range(len(plan["bins"]) + 1)]
        codes, y = np.stack([np.concatenate(c) for c in table[:-1]]), np.concatenate(table[-1])
        blobs = []
        for b in held:
            blob = b.column(len(table))
            ends = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset:blob.offset + len(blob) + 1]
            blobs.append(np.frombuffer(blob.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(blob), -1))
        values = np.concatenate(blobs)
        if plan["cells"]:
            values = np.ascontiguousarray(values).view(np.float64).reshape(len(values), plan["trees"], -1).transpose(1, 2, 0)
        else:
            values = np.ascontiguousarray(values.T)[:, None]
        for t, nodes in open_nodes.items():
            here = np.flatnonzero(values[t, 0])
            of = np.full(len(trees[t][0]), -1)
            of[nodes] = np.arange(len(nodes))
            mine = codes[:, here]
            node = of[_walk(trees[t], mine, plan["numeric"], depth)]
            inside = node >= 0
            here, mine, node = here[inside], mine[:, inside], node[inside]
            if not len(here):
                continue
            heads, starts, n = layouts[t]
            rows, slots = [np.arange(len(here))], [heads[node]]
            for c, (keys, places) in enumerate(_wanted(plan, drawn[t], starts)):
                if len(keys):
                    slot = _places(node * plan["bins"][c] + mine[c], keys, places, len(nodes) * plan["bins"][c])
                    rows.append(np.flatnonzero(slot >= 0))
                    slots.append(slot[rows[-1]])
            rows, slots = here[np.concatenate(rows)], np.concatenate(slots)
            k = values[t][:, rows].astype(np.float64)
            if classes:
                sums[t] += np.bincount(slots * s + y[rows].astype(np.int64), k[0], n * s)
                continue
            if not plan["cells"]:
                k = [k[0], k[0] * y[rows], k[0] * y[rows] * y[rows]]
            for j in range(3):
                sums[t][j::3] += np.bincount(slots, k[j], n)

    def task(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        layouts = {t: _layout(plan, drawn[t]) for t in open_nodes}
        sums = {t: np.zeros(layouts[t][2] * s) for t in open_nodes}
        held, rows, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
                add(held, sums, layouts)
                held, rows, size = [], 0, 0
        if held:
            add(held, sums, layouts)
        for t, nodes in open_nodes.items():
            ends = np.append(layouts[t][0], layouts[t][2])
            for first, last in _blocks(plan, ends):
                data = sums[t][ends[first] * s:ends[last] * s]
                if data.any():
                    yield pa.RecordBatch.from_pylist([{"tree": t, "first": first, "part": part, "data": data.tobytes()}],
                                                     pa.schema([("tree", pa.int32()), ("first", pa.int32()), ("part", pa.int32()), ("data", pa.binary())]))
    return task


def _blocks(plan: dict, ends) -> list[tuple[int, int]]:
    """Neighbouring nodes in blocks of about ``BLOCK_BYTES``; ``ends`` has where each node's slots begin."""
    out, first = [], 0
    for j in range(1, len(ends)):
        if j == len(ends) - 1 or (ends[j + 1] - ends[first]) * plan["stats"] * 8 > BLOCK_BYTES:
            out.append((first, j))
            first = j
    return out


def _impurity(plan: dict, stats):
    """``(impurity, weight, rows)`` of the counts in the last axis of ``stats``."""
    import numpy as np
    if plan["weights"] is not None:
        w = stats * plan["weights"]
        n = w.sum(-1)
        safe = np.where(n > 0, n, 1)
        return np.where(n > 0, 1 - ((w / safe[..., None]) ** 2).sum(-1), 0), n, stats.sum(-1)
    n = stats[..., 0]
    safe = np.where(n > 0, n, 1)
    return np.where(n > 0, (stats[..., 2] - stats[..., 1] * stats[..., 1] / safe) / safe, 0), n, n


def _choose(plan: dict, open_nodes: dict, drawn: dict):
    """The group function of a pass: the split of each node of a block, feature -1 where none gains."""
    import numpy as np
    import pyarrow as pa
    s = plan["stats"]

    def group(key, table):
        t, first = key[0].as_py(), key[1].as_py()
        heads, starts, n = _layout(plan, drawn[t])
        ends = np.append(heads, n)
        last = next(b for a, b in _blocks(plan, ends) if a == first)
        order = np.argsort(table.column("part").to_numpy())
        blobs = table.column("data").to_pylist()
        data = sum(np.frombuffer(blobs[i], np.float64) for i in order).reshape(-1, s)
        heads, starts, features = heads[first:last] - ends[first], starts[first:last] - ends[first], drawn[t][first:last]
        total = data[heads]
        impurity, weight, _ = _impurity(plan, total)
        owner = plan["column"][features]
        found = []  # (node of the block, feature, code, left)
        for c, bins in enumerate(plan["bins"]):
            node, place = np.nonzero(owner == c)
            if plan["numeric"][c]:
                left = np.cumsum(data[starts[node, place][:, None] + np.arange(bins - 1)], 1).reshape(-1, s)
                found.append((np.repeat(node, bins - 1), np.repeat(features[node, place], bins - 1), np.tile(np.arange(bins - 1), len(node)), left))
            else:
                found.append((node, features[node, place], features[node, place] - plan["first"][c], total[node] - data[starts[node, place]]))
        node, feature, code, left = (np.concatenate(x) for x in zip(*found))
        (il, wl, nl), (ir, wr, nr) = _impurity(plan, left), _impurity(plan, total[node] - left)
        whole = np.where(weight[node] > 0, weight[node], 1)
        gain = impurity[node] - wl / whole * il - wr / whole * ir
        good = (nl >= plan["min_rows"]) & (nr >= plan["min_rows"]) & (gain >= plan["min_gain"]) & (gain > 0)
        node, feature, code, left, gain = (x[good] for x in (node, feature, code, left, gain))
        order = np.lexsort((code, feature, -gain, node))
        best = {}
        for i in order[np.unique(node[order], return_index=True)[1]]:
            best[int(node[i])] = i
        rows = []
        for j in range(last - first):
            i = best.get(j)
            rows.append({"tree": t, "node": int(open_nodes[t][first + j]), "feature": -1 if i is None else int(feature[i]),
                         "code": -1 if i is None else int(code[i]), "gain": 0.0 if i is None else float(gain[i]),
                         "total": total[j].tolist(), "left": None if i is None else left[i].tolist()})
        kinds = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        return pa.Table.from_pylist(rows, pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in BEST.split(", ")]))
    return group


def _grow(items: DataFrame, plan: dict) -> list[dict]:
    """The trees as lists a node: ``feature`` (-1: a leaf), ``code``, ``left`` (the right child follows),
    ``gain`` and ``stats``."""
    import numpy as np
    trees = [{"feature": [-1], "code": [-1], "left": [-1], "gain": [-1.0], "stats": [None]} for _ in range(plan["trees"])]
    todo = [(t, 0) for t in range(plan["trees"])]
    for depth in range(plan["depth"]):
        groups, size = [[]], 0
        per = (1 + int(np.sort(plan["slots"])[-plan["draw"]:].sum())) * plan["stats"] * 8  # counts of a node at most
        for x in todo:
            if size + per > GROUP_BYTES and groups[-1]:
                groups.append([])
                size = 0
            groups[-1].append(x)
            size += per
        # as the level began: rows are walked to its nodes in all of its passes
        arrays = [(np.array([plan["column"][f] if f >= 0 else -1 for f in x["feature"]], np.int32), np.array(x["code"], np.int32),
                   np.array(x["left"], np.int64)) for x in trees]
        todo = []
        for group in groups:
            open_nodes = {}
            for t, j in group:
                open_nodes.setdefault(t, []).append(j)
            drawn = _drawn(plan, open_nodes)
            walked = {t: arrays[t] for t in open_nodes}
            counts = items.mapInArrow(_count(plan, walked, open_nodes, drawn, depth), "tree int, first int, part int, data binary")
            found = counts.groupBy("tree", "first").applyInArrow(_choose(plan, open_nodes, drawn), BEST).collect()  # one row a node
            for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
                x, j = trees[r["tree"]], r["node"]
                x["stats"][j] = np.array(r["total"])
                if r["feature"] < 0:
                    continue
                left = np.array(r["left"])
                x["feature"][j], x["code"][j], x["gain"][j], x["left"][j] = r["feature"], r["code"], r["gain"], len(x["left"])
                for stats in (left, x["stats"][j] - left):
                    if depth + 1 < plan["depth"] and _impurity(plan, stats)[0] >= EPSILON:
                        todo.append((r["tree"], len(x["left"])))
                    for name, value in (("feature", -1), ("code", -1), ("left", -1), ("gain", -1.0), ("stats", stats)):
                        x[name].append(value)
        if not todo:
            break
    return trees


def _merged(x: dict, plan: dict) -> list[tuple]:
    """A tree as rows of MLlib's ``NODE``, equal sibling leaves merged."""
    import numpy as np
    stats = np.array([np.zeros(plan["stats"]) if s is None else s for s in x["stats"]])
    impurity, weight, rows = _impurity(plan, stats)
    kept = stats * plan["weights"] if plan["weights"] is not None else stats
    says = kept.argmax(1).astype(float) if plan["weights"] is not None else kept[:, 1] / np.maximum(kept[:, 0], 1)
    left = list(x["left"])
    for j in reversed(range(len(left))):
        i = left[j]
        if i >= 0 and left[i] < 0 and left[i + 1] < 0 and says[i] == says[i + 1]:
            left[j] = -1
    order, number = [0], {0: 0}
    for j in order:  # grows: children follow their parents
        if left[j] >= 0:
            for i in (left[j], left[j] + 1):
                number[i] = len(order)
                order.append(i)
    out = []
    for j in order:
        split, gain, children = (-1, [], -1), -1.0, (-1, -1)
        if left[j] >= 0:
            f, code = x["feature"][j], x["code"][j]
            c = plan["column"][f]
            split = (f, [float(plan["cuts"][c][code])], -1) if plan["numeric"][c] else (f, [0.0], 2)
            gain, children = x["gain"][j], (number[left[j]], number[left[j] + 1])
        out.append((number[j], float(says[j]), float(impurity[j]), kept[j].tolist(), int(rows[j]), gain, *children, split))
    return out


def _stored(spark, trees: list[dict], plan: dict, forest, features: int):
    """MLlib's model of ``trees``, by way of its own format in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    classes = plan["weights"] is not None
    package, kind = ("classification", "Classification") if classes else ("regression", "Regression")
    more = {"numFeatures": features} | ({"numClasses": plan["stats"]} if classes else {})

    def metadata(name, **extra):
        return json.dumps({"class": f"org.apache.spark.ml.{package}.{name}{kind}Model", "timestamp": int(time.time() * 1000),
                           "sparkVersion": spark.version, "uid": f"{name}_{uuid.uuid4().hex[:12]}", "paramMap": {}, "defaultParamMap": {}} | extra)

    given = {p.name: v for p, v in forest._paramMap.items()}
    usual = {p.name: v for p, v in forest._defaultParamMap.items()}
    top = metadata("RandomForest", paramMap=given, defaultParamMap=usual, numTrees=len(trees), **more)
    spark.createDataFrame([(top,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    one = [(t, metadata("DecisionTree", **more), 1.0) for t in range(len(trees))]
    spark.createDataFrame(one, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    nodes = [(t, n) for t, x in enumerate(trees) for n in _merged(x, plan)]
    spark.createDataFrame(nodes, NODE, verifySchema=False).write.parquet(f"{path}/data")
    return (RandomForestClassificationModel if classes else RandomForestRegressionModel).load(path)
