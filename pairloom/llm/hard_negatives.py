"""Hard negatives of embedding vectors by best-first search in STR-packed R-trees.

Vectors are whole numbers (256 times each component, rounded down) and scores are their inner products. An anchor's positives are its
first POSITIVES other rows of the same label; its negatives for a positive of score p are the first NEGATIVES rows of another
label whose score lies between LOW and HIGH percent of p. Higher scores come first, then smaller vec_ids.

1. *Tiles.* The two coordinates that vary most cut all rows into slabs and these into tiles, at approximate quantiles, so that
   a tile has about ``BLOCK`` rows; a tile that has more (equal vectors) is dealt to several blocks. Each block's minimum
   bounding box is kept.
2. *Tree.* Within a block each label's rows are packed by sort-tile-recursion over the coordinates that vary most, to leaves
   of ``LEAF`` rows below nodes of ``FANOUT`` leaves, all with minimum bounding boxes.
3. *Search.* A box gives an interval of every coordinate's product with the query, hence of the score. Each query has a queue
   of boxes, the best reachable score first; boxes outside its score window, or strictly below the k-th score found, are
   pruned, and the search ends when none is left. Queries of a block run side by side: a round opens the best
   boxes of every query, and queries that open the same box share one matrix product.
4. *Over all blocks.* An anchor searches its own block first. Its k-th score there, and the windows, prune whole blocks by their
   boxes; only pairs of query and block that can matter are shuffled. A block with many queries is sent to several tasks of
   at most about ``QUERIES`` queries each. The best k of each block are ranked per query at the end.

Nothing is collected or broadcast but the quantiles (at most ``SLABS`` squared numbers). The search is exact.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; of rows that share a
vec_id the one with the smallest label, then vector, takes part; shorter vectors are filled up with zeros; an empty table or an anchor without positives or
fitting negatives gives no rows; scores must fit a long (beyond that the sum wraps, so scale such vectors down);
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm import jobs, packed
from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)

SCALE = 256
ANCHORS = 50  # anchors are the rows whose vec_id is divisible by this
SHIFTED = 7  # rows whose vec_id is divisible by this first get the next of LABELS labels
LABELS = 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95

BLOCK = 4096
SLABS = 512
LEAF = 32
FANOUT = 16
QUERIES = 2048
AT_ONCE = 4  # boxes that a query opens in a round
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

FOUND = "query long, id long, score long"
QUERY = "query long, anchor long, label long, vector array<long>, low long, high long, kth long"


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    given = jobs.with_columns(embeddings, vec_id="long", label="long", embedding="array<double>")
    whole = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    label = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(x * SCALE).cast("long"))
    one = kept.select("vec_id", F.struct(label.alias("label"), vector.alias("vector")).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return one.select("vec_id", "row.*")


def _part(column: Column, cuts: str) -> Column:
    """How many cuts lie below a value."""
    return F.size(F.filter(cuts, lambda c: c < column))


def tiled(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` with the number of their block; blocks have about ``block`` rows and are near in space."""
    numbers = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    count, width = numbers[0], numbers[1]
    blocks = -(-count // block)
    if blocks <= 1 or not width:
        return rows.withColumn("block", F.lit(0).cast("long"))
    spread = rows.agg(*[F.coalesce(F.stddev_pop(F.get("vector", F.lit(i)).cast("double")), F.lit(0.0)) for i in range(width)]).first()
    first, second = (sorted(range(width), key=lambda i: (-spread[i], i)) * 2)[:2]
    slabs = min(SLABS, max(1, int(np.ceil(np.sqrt(blocks)))))
    per_slab = min(SLABS, -(-blocks // slabs))
    x, y = (F.coalesce(F.get("vector", F.lit(i)), F.lit(0)) for i in (first, second))

    def quantiles(column: Column, parts: int) -> Column:
        if parts < 2:
            return F.array().cast("array<bigint>")
        return F.percentile_approx(column, [k / parts for k in range(1, parts)], 20 * parts)

    cuts = rows.agg(quantiles(x, slabs).alias("c")).first()["c"]
    rows = rows.withColumn("slab", _part(x, F.array(*map(F.lit, cuts)).cast("array<bigint>")))
    tiles = F.broadcast(rows.groupBy("slab").agg(quantiles(y, per_slab).alias("cuts")))  # at most SLABS rows of SLABS numbers
    rows = rows.join(tiles, "slab").withColumn("tile", (F.col("slab") * per_slab + _part(y, "cuts")).cast("long")).drop("slab", "cuts")
    size = rows.groupBy("tile").count()
    parts = F.broadcast(size.select("tile", F.ceil(F.col("count") / (2 * block)).alias("parts")))  # at most SLABS squared rows
    block_number = F.col("tile") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return rows.join(parts, "tile").withColumn("block", block_number).drop("tile", "parts")


def matrix(column, width: int = 0) -> np.ndarray:
    """Vectors of an Arrow column as rows of whole numbers, shorter ones filled up with zeros."""
    flat, bounds = packed.list_bounds(column)
    size = np.diff(bounds)
    out = np.zeros((len(size), max(width, int(size.max()) if len(size) else 0)), dtype=np.int64)
    out[np.repeat(np.arange(len(size)), size), packed.ranges(np.zeros(len(size)), size)] = flat
    return out


def packed_order(vectors: np.ndarray) -> np.ndarray:
    """Order of the rows by sort-tile-recursion, so that every LEAF consecutive ones are near each other."""
    pending, done = [(np.arange(len(vectors)), 0)], []
    by_spread = np.argsort(-(vectors.max(axis=0) - vectors.min(axis=0)).astype(np.float64), kind="stable") if vectors.size else []
    while pending:
        rows, level = pending.pop()
        leaves = -(-len(rows) // LEAF)
        if leaves <= 1 or level >= len(by_spread):
            done.append(rows)
            continue
        rows = rows[np.argsort(vectors[rows, by_spread[level]], kind="stable")]
        cut = -(-leaves // 2) * LEAF
        pending += [(rows[cut:], level + 1), (rows[:cut], level + 1)]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class Tree:
    """An STR-packed R-tree of one block; the children of a node lie side by side."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order, starts = [], []
        for label in np.unique(labels):
            rows = np.flatnonzero(labels == label)
            rows = rows[packed_order(vectors[rows])]
            starts += [sum(map(len, order)) + k for k in range(0, len(rows), LEAF)]
            order.append(rows)
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.leaf = np.append(starts, len(order)).astype(np.int64)
        self.node = np.append(np.arange(0, len(starts), FANOUT), len(starts))
        self.low, self.high = (f.reduceat(self.vectors, self.leaf[:-1], axis=0) for f in (np.minimum, np.maximum))
        self.leaf_label = self.labels[self.leaf[:-1]]
        self.node_low = np.minimum.reduceat(self.low, self.node[:-1], axis=0)
        self.node_high = np.maximum.reduceat(self.high, self.node[:-1], axis=0)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products; in floating point where that is exact, which is many times faster."""
    a, b = (int(np.abs(m).max()) if m.size else 0 for m in (queries, rows))
    if a * b * max(1, queries.shape[1]) < 1 << 53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def intervals(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of every query within every box."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    return products(plus, low) + products(minus, high), products(plus, high) + products(minus, low)


def reachable(least, most, low, high, kth):
    """The best score that a box may hold for a query, LEAST where it is pruned."""
    best = np.minimum(most, high[:, None])
    return np.where((most >= low[:, None]) & (least <= high[:, None]) & (best >= kth[:, None]), best, LEAST)


def search(tree: Tree, queries: dict[str, np.ndarray], k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of the first k fitting rows of the block for each query.

    ``queries`` holds vector, label, anchor, low, high and kth; ``same`` asks for rows of the query's label other than
    the anchor, else for rows of other labels.
    """
    vectors, label, anchor, low, high = (queries[name] for name in ("vector", "label", "anchor", "low", "high"))
    n, kth = len(vectors), queries["kth"].copy()
    leaves = len(tree.leaf) - 1
    fits = (tree.leaf_label[None, :] == label[:, None]) == same
    nodes = reachable(*intervals(vectors, tree.node_low, tree.node_high), low, high, kth)
    queue = np.concatenate([np.full((n, leaves), LEAST), nodes], axis=1)
    scores, ids = np.full((n, k), LEAST), np.full((n, k), MOST)
    live = np.arange(n)
    while len(live):
        at_once = min(AT_ONCE, queue.shape[1])
        top = np.argpartition(-queue[live].astype(np.float64), at_once - 1, axis=1)[:, :at_once]
        value = np.take_along_axis(queue[live], top, axis=1)
        value = np.where(value >= np.maximum(kth[live], LEAST + 1)[:, None], value, LEAST)
        going = (value > LEAST).any(axis=1)
        live, top, value = live[going], top[going], value[going]
        who, column = np.nonzero(value > LEAST)
        box, who = top[who, column], live[who]
        order = np.argsort(box, kind="stable")
        box, who = box[order], who[order]
        queue[who, box] = LEAST
        for one in np.split(np.arange(len(box)), np.flatnonzero(np.diff(box)) + 1):
            if not len(one):
                continue
            q, b = who[one], int(box[one[0]])
            if b >= leaves:
                part = slice(tree.node[b - leaves], tree.node[b - leaves + 1])
                best = reachable(*intervals(vectors[q], tree.low[part], tree.high[part]), low[q], high[q], kth[q])
                queue[q, part] = np.where(fits[q, part], best, LEAST)
                continue
            rows = slice(tree.leaf[b], tree.leaf[b + 1])
            score = products(vectors[q], tree.vectors[rows])
            good = (score >= low[q, None]) & (score <= high[q, None])
            if same:
                good &= tree.ids[rows][None, :] != anchor[q, None]
            score = np.where(good, score, LEAST)
            both = np.concatenate([scores[q], score], axis=1)
            names = np.concatenate([ids[q], np.where(good, tree.ids[rows][None, :], MOST)], axis=1)
            first = np.lexsort((names, -both.astype(np.float64) if abs(both[both > LEAST]).max(initial=0) < 1 << 53 else ~both), axis=1)[:, :k]
            scores[q], ids[q] = np.take_along_axis(both, first, axis=1), np.take_along_axis(names, first, axis=1)
            kth[q] = np.maximum(kth[q], scores[q, k - 1])
    place, column = np.nonzero(scores > LEAST)
    return place, ids[place, column], scores[place, column]


def _searched(rows: pa.Table, asked: pa.Table, k: int, same: bool) -> pa.Table:
    if not rows.num_rows or not asked.num_rows:
        place = ids = scores = np.zeros(0, np.int64)
        number = place
    else:
        width = max(int(packed.pa.compute.max(packed.pa.compute.list_value_length(t.column("vector"))).as_py() or 0) for t in (rows, asked))
        tree = Tree(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("vector"), max(1, width)))
        queries = {name: asked.column(name).to_numpy() for name in ("label", "anchor", "low", "high", "kth")}
        place, ids, scores = search(tree, queries | {"vector": matrix(asked.column("vector"), max(1, width))}, k, same)
        number = asked.column("query").to_numpy()
    return pa.table({"query": number[place], "id": ids, "score": scores})


def _boxes(rows: pa.Table) -> pa.Table:
    vectors = matrix(rows.column("vector"))
    return pa.table({"block": [rows.column("block")[0].as_py()], "box_low": [vectors.min(axis=0)], "box_high": [vectors.max(axis=0)]})


def _routed(boxes: pa.Table, asked: pa.Table) -> pa.Table:
    """Pairs of a query and a block that its score window and k-th score leave open."""
    names = ("query", "block")
    if not boxes.num_rows or not asked.num_rows:
        return pa.table({name: pa.array([], pa.int64()) for name in names})
    sides = [matrix(boxes.column(c)) for c in ("box_low", "box_high")]
    vectors = matrix(asked.column("vector"), sides[0].shape[1])
    sides = [np.pad(s, ((0, 0), (0, vectors.shape[1] - s.shape[1]))) for s in sides]
    low, high, kth = (asked.column(c).to_numpy() for c in ("low", "high", "kth"))
    open_ = reachable(*intervals(vectors, *sides), low, high, kth) > LEAST
    block = boxes.column("block").to_numpy()
    open_ &= block[None, :] != asked.column("home").to_numpy()[:, None]
    query, place = np.nonzero(open_)
    return pa.table(dict(zip(names, (asked.column("query").to_numpy()[query], block[place]))))


def _search_blocks(rows: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """The first k of every (query, block); a block goes once to each task of about QUERIES of its queries."""
    count = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("tasks"))
    asked = asked.join(count, "block").withColumn("task", F.pmod(F.xxhash64("query"), F.col("tasks")).cast("int"))
    copies = rows.join(count, "block").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))

    def run(left, right):
        return _searched(left, right, k, same)

    copies = copies.select(*(F.col(name).alias(name) for name in copies.columns))  # both sides may stem from the same rows
    return copies.groupBy("block", "task").cogroup(asked.groupBy("block", "task")).applyInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, boxes: DataFrame, queries: DataFrame, k: int, same: bool, home: bool) -> DataFrame:
    """(query, id, score, rank): the first k fitting rows of all blocks for every query (QUERY, home: its own block)."""
    found = None
    if home:
        found = jobs.staged(_search_blocks(rows, queries.withColumn("block", F.col("home")), k, same), "home")
        kth = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("own"))
        queries = queries.join(kth, "query", "left").withColumn("kth", F.greatest("kth", F.coalesce("own", "kth"))).drop("own")
    else:
        queries = queries.withColumn("home", F.lit(-1).cast("long"))
    groups = -(-boxes.count() // 512)
    asked = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(0, groups - 1)))))
    parts = max(1, -(-queries.count() // QUERIES))
    asked = asked.withColumn("task", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
    dealt = boxes.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(max(1, groups))).cast("int"))
    dealt = dealt.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    routes = dealt.groupBy("group", "task").cogroup(asked.groupBy("group", "task")).applyInArrow(_routed, "query long, block long")
    routed = jobs.staged(queries.join(routes, "query"), "routed")
    more = _search_blocks(rows, routed, k, same)
    return _first(more if found is None else found.unionByName(more), k)


def mined(embeddings: DataFrame, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = jobs.staged(tiled(jobs.staged(prepared(embeddings), "vectors"), block), "blocks")
    boxes = jobs.staged(rows.groupBy("block").applyInArrow(_boxes, "block long, box_low array<long>, box_high array<long>"), "boxes")
    anchors = rows.where(F.col("vec_id") % ANCHORS == 0)
    open_ = [F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"), F.lit(LEAST).alias("kth")]
    asked = anchors.select(F.col("vec_id").alias("query"), F.col("vec_id").alias("anchor"), "label", "vector", *open_, F.col("block").alias("home"))
    positives = jobs.staged(nearest(rows, boxes, asked, POSITIVES, True, True), "positives")
    told = positives.select(F.col("query").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank")
    windows = told.where("positive_score >= 0").join(anchors.select(F.col("vec_id").alias("anchor"), "label", "vector"), "anchor")
    score = F.col("positive_score").cast("decimal(20,0)")
    windows = windows.select(
        F.xxhash64("anchor", "rank").alias("query"),
        "anchor",
        "label",
        "vector",
        F.ceil(score * LOW / 100).cast("long").alias("low"),
        F.floor(score * HIGH / 100).cast("long").alias("high"),
        F.lit(LEAST).alias("kth"),
        "positive_id",
        "positive_score",
    )
    windows = jobs.staged(windows.where("low <= high"), "windows")
    found = nearest(rows, boxes, windows.drop("positive_id", "positive_score"), NEGATIVES, False, False)
    named = windows.select("query", F.col("anchor").alias("anchor_id"), "positive_id", "positive_score")
    return found.join(named, "query").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
