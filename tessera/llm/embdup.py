"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2 - 2c.  Vectors are rotated
by a seeded orthogonal matrix and split into blocks of few dimensions; each block
gets the share of the squared distance that its dimensions have.  Two vectors
within the whole distance are within the budget of at least one block, so the
union of the blocks' range joins misses no pair; each candidate is verified in
double precision on the stored vectors.

A block's range join lays a grid over dimensions of the block.  A vector is at home
in one cell and visits the cells whose distance to it, summed over the grid's
dimensions, is within the budget: no other cell can hold a partner.  How fine the
grid is, and over how many of the block's dimensions, follows from the number of
vectors that meet and a table of visits and hits of random vectors (``grids``).

There are two levels.  Vectors of a label with at most ``local`` of them meet in one
task, whose grids are looked up in memory (``near_in_block``).  Larger labels are dealt
by block and cell of a coarse grid (``coarse_grid``);
coordinates are shipped only to cells that hold another vector, and inside a cell
the same lookup on a finer grid finds the pairs.  A cell that is fuller is cut in tiles of
bounded size, which cover all its pairs.  A pair counts only in the first block whose budget it
meets, so no list of pairs is made or deduplicated: tiles return a number of links
per vector and edges that span the tile's linked groups.  Equal vectors are one
class that is compared once.

Edge cases: a null label, a vector that is null, empty, zero, or holds a null or
non-finite component links with nothing and is its own component; so does a row
without a vec_id, as in the SQL, where it equals no id: no row counts it, and its
component is null; vectors of different lengths are not compared; repeated rows
are members of one class and link with each other; rows that repeat a vec_id are
one node; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_arrow, mix, table, written
from tessera.llm.components import components

BLOCK_DIMS = 8
#: Vectors that meet in one task, and homes of a cell that are compared in one tile.
LOCAL, TILE = 8192, 4096
#: Numbers of a task's vectors at most, whatever their length.
LOCAL_NUMBERS = 1 << 22
#: Single-precision coordinates stand in for exact ones in the blocks.
SLACK = 1 + 1e-4
#: Widths of cells, in radii, and the cost of looking up a cell, in compared pairs.
WIDTHS, VISIT = (4.0, 3.0, 2.0, 1.5, 1.0), 3.0
#: Share of all pairs of random vectors that may be looked at.
MOST = 0.18


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(4711 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int) -> np.ndarray:
    """Where the blocks of d dimensions start."""
    return np.array([b[0] for b in np.array_split(np.arange(d), max(1, d // BLOCK_DIMS))])


def budgets(d: int, cosine: float) -> np.ndarray:
    sizes = np.diff(np.append(blocks(d), d))
    return (2 - 2 * cosine) * sizes / d * SLACK + 1e-9


def _vectors(column) -> list[np.ndarray]:
    """Index groups by length would be needed for ragged data: one array a row."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.split(flat, np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(c) else []


def _rotate(batches):
    for batch in batches:
        rows = _vectors(batch.column("embedding"))
        out = [(x / np.linalg.norm(x) @ rotation_of(len(x))).astype(np.float32) for x in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32()))], [*batch.schema.names, "rotated"])


_rotations: dict[int, np.ndarray] = {}


def rotation_of(d: int) -> np.ndarray:
    if d not in _rotations:
        _rotations[d] = rotation(d)
    return _rotations[d]


def visits(x: np.ndarray, width: float, ahead: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cells within a distance of 1 of each row of x, for cells of the
    given width.  With ``ahead`` only those that come after the row's own in order: of
    two cells that see each other, one is ahead of the other."""
    home = np.floor(x / width)
    row, far = np.arange(len(x)), np.zeros(len(x))
    steps = np.zeros((len(x), 0), np.int32)
    sign = np.zeros(len(x), np.int8)
    reach = math.ceil(1 / width)
    for k in range(x.shape[1]):
        below = x[:, k] - home[:, k] * width
        parts = []
        for step in range(-reach, reach + 1):
            gap = 0.0 if step == 0 else below[row] - (step + 1) * width if step < 0 else step * width - below[row]
            now = far + gap**2
            ok = now <= SLACK
            first = np.where(sign == 0, np.sign(step), sign)
            if ahead:
                ok &= first >= 0
            w = np.flatnonzero(ok)
            parts.append((row[w], now[w], np.concatenate([steps[w], np.full((len(w), 1), step, np.int32)], axis=1), first[w]))
        row, far, steps, sign = (np.concatenate(c) for c in zip(*parts, strict=True))
    if ahead:
        w = np.flatnonzero(sign > 0)
        row, steps = row[w], steps[w]
    return row, home[row].astype(np.int32) + steps


@lru_cache(maxsize=256)
def grids(d: int, cosine: float, size: int) -> tuple[tuple[float, int, float, float], ...]:
    """(width, dimensions, visits, share): how many cells a vector visits in a block of
    ``size`` of d dimensions, and the share of all vectors at home there, for random vectors."""
    rng = np.random.default_rng(99)
    budget = (2 - 2 * cosine) * size / d * SLACK + 1e-9
    x = rng.normal(0, 1 / math.sqrt(d), (256, size)) / math.sqrt(budget)
    y = rng.normal(0, 1 / math.sqrt(d), (1024, size)) / math.sqrt(budget)
    out = []
    for width in WIDTHS:
        home = np.floor(y / width)
        gap = np.maximum(np.maximum(home[None] * width - x[:, None], x[:, None] - (home[None] + 1) * width), 0) ** 2
        total = np.cumsum(gap, axis=2)
        for g in range(2, size + 1):
            seen = len(visits(x[:64, :g], width)[0]) / 64
            out.append((width, g, seen, float((total[:, :, g - 1] <= SLACK).mean())))
            if seen > 3000:
                break
    return tuple(out)


def grid_for(d: int, cosine: float, size: int, n: int) -> tuple[float, int]:
    """The grid of least cost for n vectors that meet, of those that compare at most
    ``MOST`` of all pairs over all blocks, if there are any."""
    known = grids(d, cosine, size)
    few = [k for k in known if k[3] * max(1, d // BLOCK_DIMS) <= MOST] or [min(known, key=lambda k: k[3])]
    return min(few, key=lambda k: VISIT * k[2] + k[3] * n)[:2]


def coarse_grid(d: int, cosine: float, size: int, n: int) -> tuple[float, int]:
    """The grid that ships the fewest rows for n vectors of a label: visitors once for each
    tile of homes, homes once for each tile of all in their cell."""

    def rows(k) -> float:
        held = k[3] * n
        return k[2] / 2 * math.ceil(held / k[2] / TILE) + math.ceil(held / TILE)

    return min(grids(d, cosine, size), key=rows)[:2]


def near_in_block(own: np.ndarray, other: np.ndarray | None, budget: float, width: float, g: int):
    """Yields (p, q, compared) in parts: the rows p of ``other`` and q of ``own`` within the
    budget, or without ``other`` all pairs within ``own``, each once.  compared: how many
    pairs have been looked at."""
    unit = math.sqrt(budget)
    cell = np.floor(own[:, :g] / unit / width).astype(np.int32)
    order = np.lexsort(cell.T[::-1])
    cell = cell[order]
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]).any(axis=1)
    begin = np.append(np.flatnonzero(new), len(cell))
    known = _keys(cell[new])
    rank = np.argsort(known, kind="stable")
    known = known[rank]

    def within(p, q):
        far = own if other is None else other
        return ((far[p] - own[q]) ** 2).sum(axis=1) <= budget * SLACK + 1e-9

    def looked_up(row, keys):
        at = np.searchsorted(known, keys)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == keys)
        group = rank[at[hit]]
        row, n = row[hit], begin[group + 1] - begin[group]
        edge = np.concatenate([[0], np.cumsum(n)])
        i = 0
        while i < len(row):  # about PAIRS pairs at once, a cell of many is cut by its rows
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + PAIRS, "right")) - 1)
            m = n[i:j]
            p = np.repeat(row[i:j], m)
            q = order[np.repeat(begin[group[i:j]], m) + np.arange(len(p)) - np.repeat(edge[i:j] - edge[i], m)]
            yield p, q
            i = j

    if other is None:
        # inside a cell: each row with those after it
        last = np.repeat(begin[1:], np.diff(begin))
        n = last - np.arange(len(cell)) - 1
        edge = np.concatenate([[0], np.cumsum(n)])
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + PAIRS, "right")) - 1)
            m = n[i:j]
            p = np.repeat(np.arange(i, j), m)
            q = p + 1 + np.arange(len(p)) - np.repeat(edge[i:j] - edge[i], m)
            p, q = order[p], order[q]
            keep = within(p, q)
            yield p[keep], q[keep], len(p)
            i = j
    source = own if other is None else other
    for lo in range(0, len(source), 512):
        row, seen = visits(source[lo : lo + 512, :g] / unit, width, ahead=other is None)
        for p, q in looked_up(row + lo, _keys(seen)):
            keep = within(p, q)
            yield p[keep], q[keep], len(p)


PAIRS = 1 << 17
_KEY = np.random.default_rng(5).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _keys(cells: np.ndarray) -> np.ndarray:
    """One 64-bit number a cell."""
    return mix((cells.astype(np.int64).view(np.uint64) * _KEY[: cells.shape[1]]).sum(axis=1, dtype=np.uint64))


_CELL = ["label", "dim", "block", "cell"]


def _cells(cosine: float):
    """Home and visited cells of each class of large labels, in each block."""
    names = ["node", *_CELL, "home"]

    def run(batches):
        for batch in batches:
            rows = _vectors(batch.column("rotated"))
            nodes, labels, sizes = (batch.column(c).to_numpy() for c in ("node", "label", "population"))
            level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
            dims = np.array([len(r) for r in rows])
            for d, k in {*zip(dims.tolist(), level.tolist(), strict=True)}:
                who = np.flatnonzero((dims == d) & (level == k))
                x = np.array([rows[i] for i in who], np.float64)
                edges = [*blocks(d), d]
                for j, budget in enumerate(budgets(d, cosine)):
                    width, g = coarse_grid(d, cosine, edges[j + 1] - edges[j], 1 << k)
                    at = x[:, edges[j] : edges[j] + g] / math.sqrt(budget)
                    row, cell = visits(at, width, ahead=True)
                    own = np.floor(at / width).astype(np.int32)
                    row, key = np.concatenate([np.arange(len(at)), row]), _keys(np.concatenate([own, cell])).view(np.int64)
                    home = np.arange(len(row)) < len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[who[row]], pa.int64()), pa.array(labels[who[row]], pa.int32()), pa.array(np.full(len(row), d), pa.int32()), pa.array(np.full(len(row), j), pa.int32()), pa.array(key), pa.array(home)], names)

    return run


def _tile(cosine: float):
    """Links per vector and spanning edges of a tile.  role: 1 is at home, 0 is compared
    with it, 2 both; ``home``: whether a row compared with is at home in the cell elsewhere."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("compared", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        block, d = t.column("block")[0].as_py(), t.column("dim")[0].as_py()
        node, n, role, at_home = (t.column(c).to_numpy() for c in ("node", "n", "role", "home"))
        x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        r = t.column("rotated").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        starts, most = blocks(d), budgets(d, cosine)
        edges = [*starts, d]
        home, other = np.flatnonzero(role >= 1), np.flatnonzero(role == 0)
        both = (role == 2).any()
        links, compared, pairs = np.zeros(len(node), np.int64), 0, []
        for j in range(len(starts)) if block < 0 else [block]:
            own = r[home, edges[j] : edges[j + 1]]
            width, g = grid_for(d, cosine, edges[j + 1] - edges[j], len(node))
            for there in (None, other) if both else (other,):
                if not len(home) or (there is not None and not len(there)):
                    continue
                for p, q, looked in near_in_block(own, None if there is None else r[there, edges[j] : edges[j + 1]], most[j], width, g):
                    compared += looked
                    p, q = home[p] if there is None else there[p], home[q]
                    keep = (node[p] != node[q]) & ((role[p] > 0) | ~at_home[p] | (node[p] > node[q]))
                    p, q = p[keep], q[keep]
                    keep = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= cosine
                    p, q = p[keep], q[keep]
                    by_block = np.add.reduceat((r[p] - r[q]) ** 2, starts, axis=1) <= most
                    keep = by_block[:, j] & ~by_block[:, :j].any(axis=1)
                    p, q = p[keep], q[keep]
                    np.add.at(links, p, n[q])
                    np.add.at(links, q, n[p])
                    pairs.append((p, q))
        p, q = (np.concatenate([np.zeros(0, np.int64), *z]) for z in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        least = node.copy()
        while len(p):  # the least node of each linked group
            new = least.copy()
            np.minimum.at(new, p, least[q])
            np.minimum.at(new, q, least[p])
            if (new == least).all():
                break
            least = new
        linked, joined = np.flatnonzero(links), np.flatnonzero(least != node)
        a, b = np.concatenate([node[linked], node[joined]]), np.concatenate([node[linked], least[joined]])
        looked_at = np.zeros(len(a), np.int64)
        if len(a):
            looked_at[0] = compared
        elif len(node):  # a row that links nothing tells how much was compared
            a = b = node[:1]
            looked_at = np.array([compared])
        return pa.Table.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([links[linked], np.zeros(len(a) - len(linked), np.int64)])), pa.array(looked_at)], schema=schema)

    return run


_FOUND = "a long, b long, links long, compared long"


def found_links(classes: DataFrame, cosine: float, local: int) -> DataFrame:
    """(a, b, links, compared): per tile the links of each vector (a = b), the edges that
    span its linked groups, and in one row of each tile how many pairs were looked at; from
    classes (label, embedding, node, n, rotated, population)."""
    room = F.least(F.lit(local), F.floor(F.lit(LOCAL_NUMBERS) / F.size("rotated")))
    small = F.col("population") <= room
    of = ["node", *_CELL]
    lone = classes.where(small & (F.col("population") > 1)).select("node", "label", F.size("rotated").alias("dim"), F.lit(-1).alias("block"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("role"), F.lit(True).alias("home"))
    large = classes.where(~small).select("node", "label", "rotated", "population")
    narrow = written(large.mapInArrow(_cells(cosine), "node long, label int, dim int, block int, cell long, home boolean"), "cells")
    sizes = narrow.groupBy(*_CELL).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("size")).where("homes > 0 and size > 1")
    placed = narrow.join(sizes, _CELL)
    hs, ns = F.ceil(F.col("homes") / TILE).cast("int"), F.ceil(F.col("size") / TILE).cast("int")
    hash_ = F.xxhash64("node")
    one = (hs == 1) & (ns == 1)
    upto = lambda k: F.sequence(F.lit(0), k - 1)
    single = placed.where(one).select(*of, F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("home"), 2).otherwise(0).alias("role"), "home")
    compared = placed.where(~one & F.col("home")).select(*of, F.pmod(hash_, hs).cast("int").alias("i"), F.explode(upto(ns)).alias("j"), F.lit(1).alias("role"), "home")
    against = placed.where(~one).select(*of, F.explode(upto(hs)).alias("i"), F.pmod(hash_, ns).cast("int").alias("j"), F.lit(0).alias("role"), "home")
    cut = single.unionAll(compared).unionAll(against).join(classes.select("node", "n", "embedding", "rotated"), "node")
    whole = lone.join(classes.select("node", "n", "embedding", "rotated"), "node")
    return whole.unionAll(cut).groupBy(*_CELL, "i", "j").applyInArrow(_tile(cosine), _FOUND)


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of vectors (vec_id, label, embedding, valid), and the classes of equal valid ones."""
    bound_arrow(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("wide"), "embedding")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    square = F.aggregate("wide", F.lit(0.0), lambda s, v: s + v * v)
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("wide") > 0) & ~F.exists("wide", bad), F.lit(False))
    rows = rows.withColumn("valid", F.when(valid, square > 0).otherwise(False)).drop("wide")
    # of invalid rows no vector is kept: they need not meet anywhere
    rows = rows.select("vec_id", "valid", F.when(F.col("valid"), F.col("label")).alias("label"), F.when(F.col("valid"), F.col("embedding")).alias("embedding"))
    classes = rows.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    classes = written(classes.mapInArrow(_rotate, "label int, embedding array<float>, node long, n long, rotated array<float>"), "vectors")
    # written, the counts have a known size: Spark broadcasts them below the session's threshold
    populations = written(classes.groupBy("label").agg(F.count("*").alias("population")), "labels")
    return rows, classes.join(populations, "label")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, local: int = LOCAL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label).
    Labels of more than ``local`` distinct vectors are dealt by block and cell."""
    rows, classes = vector_classes(vectors)
    found = written(found_links(classes, cosine, local), "found")
    parts = components(found.where("a <> b").select("a", "b"))
    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    known = classes.select("label", "embedding", "node", "n").join(links, "node", "left").join(parts, "node", "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.join(known, ["label", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: cosine of at least 0.98 within equal labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE x.norm > 0 AND y.norm > 0 AND list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, component_id = vec_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
