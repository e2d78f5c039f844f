"""Pairs of vectors above a cosine bound, and the nearest ones, within scopes by blocked products.

Rows and probes of a scope are dealt into tiles of at most ``ENTRIES`` vector
entries a side, and each tile is a matrix product, some probes at a time;
small scopes share a task.  For pairs above a bound a scope with more rows is
cut into cells: every row belongs to the nearest of a few directions, and by
the triangle inequality on angles a probe can only match rows of cells within
the cell's radius plus the bound's angle of it, so its other products are
never formed.  Cells are packed into tiles, so a probe is copied once for each
tile that it meets and not for each cell.  (Near-independent random vectors
have no far cells; a few of them tell, and then no cells are made and every
pair of a scope is looked at.)

Products in single precision select candidates with a margin; the reported
similarity is then summed in the order of the vector's entries, as the column
form does.  For pairs above a bound most candidates are dropped by a bound on
the product from a few rotated entries and the length of the rest (Cauchy and
Schwarz), so that full products are rare.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import ship_package, stored

ENTRIES = 1 << 21
CELLS = 64
AT_ONCE = 256  # probes of a product
ROWS_AT_ONCE = 1 << 13  # and rows, where their pairs are looked for
SHORTENED = 32  # entries from which a bound on products is looked at first
PRODUCTS = 250_000_000  # of a task, about
WORTH = 0.7  # cells are multiplied one by one when no more than this share of the products is left
_SCOPE = ("s1", "s2", "s3", "s4")
_TILE = (*_SCOPE, "g", "i", "j")
OUT = "src string, arrival_order bigint, dst string, dst_kind string, dst_order bigint, sim double"


def _unit(column: pa.Array, norms: np.ndarray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) / norms[:, None]


def _directions(rows: DataFrame, cells: int) -> np.ndarray:
    """A few rows' directions, the same for the same data: at most ``cells`` to the driver.
    Those of the commonest dimension among them; vectors of another stay in a cell of their own."""
    chosen = rows.select("dst").distinct().orderBy(F.xxhash64("dst"), "dst").limit(cells)
    found = rows.select("dst", "vec", "norm").join(F.broadcast(chosen), "dst").dropDuplicates(["dst"]).collect()
    few = sorted(found, key=lambda r: r["dst"])
    dims = [len(r["vec"]) for r in few]
    few = [r for r in few if len(r["vec"]) == max(dims, key=lambda d: (dims.count(d), d))]
    return np.array([r["vec"] for r in few]) / np.array([r["norm"] for r in few])[:, None]


def _apart(directions: np.ndarray, lo: float) -> bool:
    """Whether cells around the directions can leave out products: judged by the directions, which are
    rows themselves, so their angles to the nearest other stand for the radius of a cell."""
    angles = np.arccos(np.clip(directions @ directions.T, -1, 1))
    others = angles[~np.eye(len(angles), dtype=bool)].reshape(len(angles), -1)
    return others.size == 0 or bool((others <= np.quantile(others.min(axis=1), 0.9) + math.acos(lo)).mean() <= WORTH)


def _with_angles(df: DataFrame, directions: np.ndarray) -> DataFrame:
    """Adds ``angles`` to all directions (of vectors of their dimension, else empty)."""
    from pyspark.sql import types as T

    schema = T.StructType(df.schema.fields + [T.StructField("angles", T.ArrayType(T.DoubleType()))])
    dim = directions.shape[1]

    def run(batches):
        for batch in batches:
            vec, norm = batch.column("vec"), batch.column("norm").to_numpy()
            sizes = vec.value_lengths().to_numpy(zero_copy_only=False)
            fits = np.flatnonzero(sizes == dim)
            unit = _unit(vec.take(pa.array(fits)), norm[fits], dim)
            found = np.arccos(np.clip(unit @ directions.T, -1, 1)).ravel()
            ends = np.append(0, np.cumsum(np.where(sizes == dim, len(directions), 0))).astype(np.int32)
            angles = pa.ListArray.from_arrays(pa.array(ends), pa.array(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, angles], names=[*batch.schema.names, "angles"])

    return df.mapInArrow(run, schema)


def tiles(probes: DataFrame, rows: DataFrame, lo: float | None, tile: int | None = None, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """The probes and rows of ``_tiles``."""
    return _tiles(probes, rows, lo, tile, cells)[:2]


def _tiles(probes: DataFrame, rows: DataFrame, lo: float | None, tile: int | None = None,
           cells: int = CELLS) -> tuple[DataFrame, DataFrame, int, int]:
    """(probes, rows, number of buckets, number of tasks): both sides dealt to tiles: both get ``g`` (a pack of cells, or a large cell's own), ``i``
    (piece of rows) and ``j`` (piece of probes), once for each tile that they take part in; rows
    their ``cell``, and probes the ``cells`` of the tile that they can match (null: all)."""
    held = F.lit(tile) if tile else F.greatest(F.lit(1024), F.floor(F.lit(ENTRIES) / F.greatest(F.max(F.size("vec")), F.lit(1))))
    many = rows.groupBy(*_SCOPE).agg(F.count("*").alias("n"), held.cast("bigint").alias("t"), F.max(F.size("vec")).alias("dim"))
    asked = probes.groupBy(*_SCOPE).agg(F.count("*").alias("m"))
    sizes = stored(many.join(asked, [*_SCOPE]).withColumn("big", F.col("n") > F.col("t")))
    # tasks by the size of the copies and the number of products, at any number of shuffle partitions
    copies = F.col("n") * F.ceil(F.col("m") / F.col("t")) + F.col("m") * F.ceil(F.col("n") / F.col("t"))
    full = copies.cast("double") * F.greatest("dim", F.lit(16)) / F.lit(ENTRIES)
    made = sizes.agg(F.sum(full).alias("full"), F.sum(F.col("n").cast("double") * F.col("m")).alias("products")).first()
    tasks = 1 + math.ceil((made["full"] or 0) / 4) + math.ceil((made["products"] or 0) / PRODUCTS)
    probes, rows = probes.join(sizes.select(*_SCOPE, "big"), [*_SCOPE]), rows.join(sizes.select(*_SCOPE, "big"), [*_SCOPE])
    sizes = sizes.drop("dim")
    none = F.array().cast("array<double>")
    directions = None if lo is None or sizes.filter("big").isEmpty() else _directions(rows.filter("big"), cells)
    if directions is None or not _apart(directions, lo):
        probes, rows = probes.withColumn("angles", none), rows.withColumn("angles", none)
    else:
        def angled(df: DataFrame) -> DataFrame:
            return _with_angles(df.filter("big"), directions).unionByName(df.filter("not big").withColumn("angles", none))

        probes, rows = stored(angled(probes)), stored(angled(rows))
    nearest = F.when(F.size("angles") > 0, F.array_position("angles", F.array_min("angles")).cast("int")).otherwise(F.lit(0))
    rows = rows.withColumn("cell", nearest).withColumn("away", F.array_min("angles"))
    made = rows.groupBy(*_SCOPE, "cell").agg(F.count("*").alias("k"), F.max("away").alias("radius")).join(sizes, [*_SCOPE])
    packed = F.when(F.col("k") <= F.col("t"), F.col("k"))  # a cell above a tile has pieces of its own
    before = F.sum(packed).over(Window.partitionBy(*_SCOPE).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    pack = F.when(packed.isNotNull(), F.floor(F.coalesce(before, F.lit(0)) / F.col("t"))).otherwise(-1 - F.col("cell"))
    made = stored(made.select(
        *_SCOPE, "cell", "radius", pack.cast("int").alias("g"), F.ceil(F.col("k") / F.col("t")).cast("int").alias("pieces"),
        F.ceil(F.col("m") / F.col("t")).cast("int").alias("parts")))
    # at most ``cells`` + 1 entries a scope
    layout = made.groupBy(*_SCOPE).agg(F.collect_list(F.struct("cell", "radius", "g", "pieces")).alias("layout"), F.max("parts").alias("parts"))
    reach = F.lit(math.acos(-1.0 if lo is None else lo) + 1e-6)

    def near(c: Column) -> Column:
        return (c["cell"] == 0) | (F.size("angles") == 0) | (
            F.try_element_at("angles", F.greatest(c["cell"], F.lit(1))) <= c["radius"] + reach)

    piece = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = (probes.join(layout, [*_SCOPE]).withColumn("j", piece("src", "parts")).withColumn("met", F.filter("layout", near))
              .withColumn("g", F.explode(F.array_distinct(F.transform("met", lambda c: c["g"])))))
    mine = F.transform(F.filter("met", lambda c: c["g"] == F.col("g")), lambda c: c["cell"])
    there = F.filter("layout", lambda c: c["g"] == F.col("g"))
    probes = (probes.withColumn("cells", F.when(F.size(mine) < F.size(there), mine)).withColumn("pieces", there[0]["pieces"])
              .withColumn("i", every("pieces")))
    rows = rows.join(made.drop("radius"), [*_SCOPE, "cell"]).withColumn("i", piece("dst", "pieces")).withColumn("j", every("parts"))
    return (probes.drop("angles", "big", "layout", "met", "pieces", "parts"), rows.drop("angles", "big", "away", "pieces", "parts"),
            8 * tasks, tasks)


def _groups(probes: pa.Table, rows: pa.Table):
    """(dimension, places of probes, places of rows) that are to be multiplied: the tiles of a
    bucket one after another, cell by cell where probes leave some out."""
    found: dict[tuple, list] = {}
    for side, table in enumerate((probes, rows)):
        keys = zip(*(table.column(c).to_pylist() for c in _TILE), (table.column("vec").chunk(0).value_lengths() if len(table) else pa.array([])).to_pylist())
        for at, key in enumerate(keys):
            found.setdefault(key, [[], []])[side].append(at)
    cells, cell = probes.column("cells").combine_chunks(), rows.column("cell").to_numpy()
    for (*_, dim), (ps, rs) in found.items():
        if not ps or not rs or not dim:
            continue
        ps, rs = np.array(ps), np.array(rs)
        mine = cells.take(pa.array(ps))
        if mine.null_count == len(ps):
            yield dim, ps, rs
            continue
        here, count = np.unique(cell[rs], return_counts=True)
        meets = np.zeros((len(ps), len(here)), bool)
        meets[np.asarray(mine.is_null())] = True
        whose = np.repeat(np.arange(len(ps)), mine.value_lengths().fill_null(0).to_numpy())
        named = mine.flatten().to_numpy()
        at = np.minimum(np.searchsorted(here, named), len(here) - 1)
        known = here[at] == named
        meets[whose[known], at[known]] = True
        if (meets @ count).sum() > WORTH * len(ps) * len(rs):
            yield dim, ps, rs
            continue
        for k, c in enumerate(here.tolist()):
            if meets[:, k].any():
                yield dim, ps[meets[:, k]], rs[cell[rs] == c]


def _vectors(table: pa.Table, at: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, norms, unit vectors in single precision) at the places ``at``."""
    vec = table.column("vec").chunk(0).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = table.column("norm").to_numpy()[at]
    return vec, norm, (vec / norm[:, None]).astype(np.float32)


def _margin(dim: int) -> float:
    return 3e-7 * (dim + 8)  # more than a product in single precision is off


@functools.lru_cache(maxsize=4)
def _rotation(dim: int) -> np.ndarray:
    """Orthonormal columns, fewer than ``dim``, the same for the same dimension."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, 3 * dim // 8)))[0].astype(np.float32)


def _short(unit: np.ndarray) -> np.ndarray:
    """Vectors whose products are no less than those of ``unit``: some rotated entries and the length of the rest."""
    some = unit @ _rotation(unit.shape[1])
    rest = np.einsum("ij,ij->i", unit, unit) - np.einsum("ij,ij->i", some, some)
    return np.hstack([some, np.sqrt(np.maximum(rest, 0) + np.float32(1e-5))[:, None]])


def _places(hits: np.ndarray) -> np.ndarray:
    """Where few flags are set: eight are looked at together."""
    flat = hits.ravel()
    whole = len(flat) // 8 * 8
    at = (8 * np.flatnonzero(flat[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def _exact(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarities of the pairs (x, y), summed in order of the entries."""
    step = max(1, ENTRIES // a.shape[1])
    dots = [np.cumsum(a[x[k:k + step]] * b[y[k:k + step]], axis=1)[:, -1] for k in range(0, len(x), step)]
    return np.concatenate([np.empty(0), *dots]) / (an[x] * bn[y])


def _longs(table: pa.Table, name: str, none: int) -> np.ndarray:
    return table.column(name).fill_null(none).to_numpy()


def _product(probes: pa.Table, rows: pa.Table, lo: float) -> pa.Table:
    """The pairs of one bucket."""
    probes, rows = probes.combine_chunks(), rows.combine_chunks()
    least = np.iinfo(np.int64).min
    p_at, r_at = _longs(probes, "arrival_order", least), _longs(rows, "dst_order", least)
    timeless = np.asarray(rows.column("dst_order").is_null())
    parts: list[tuple] = []
    for dim, ps, rs in _groups(probes, rows):
        ps = ps[np.argsort(p_at[ps], kind="stable")]
        rs = rs[np.lexsort((r_at[rs], ~timeless[rs]))]
        ordered = r_at[rs][int(timeless[rs].sum()):]
        (a, an, a32), (b, bn, b32) = _vectors(probes, ps, dim), _vectors(rows, rs, dim)
        short = dim >= SHORTENED and len(ps) >= dim and len(rs) >= dim  # else the rotation costs more
        a_few, b_few = (_short(a32), _short(b32)) if short else (a32, b32)
        line = lo - (2 if short else 1) * _margin(dim)
        for k in range(0, len(ps), AT_ONCE):
            some = slice(k, k + AT_ONCE)
            until = len(rs) - len(ordered) + int(np.searchsorted(ordered, p_at[ps[some]].max()))  # later rows are no one's
            for j in range(0, until, ROWS_AT_ONCE):
                here = slice(j, min(j + ROWS_AT_ONCE, until))
                met = a_few[some] @ b_few[here].T
                at = _places(met >= line)
                if short and len(at) > met.size // 64:  # the bound drops too little here
                    at = _places(a32[some] @ b32[here].T >= lo - _margin(dim))
                x, y = np.divmod(at, met.shape[1])
                x, y = x + k, y + j
                earlier = timeless[rs[y]] | (r_at[rs[y]] < p_at[ps[x]])
                x, y = x[earlier], y[earlier]
                sim = _exact(a, an, b, bn, x, y)
                hit = sim >= lo
                parts.append((ps[x[hit]], rs[y[hit]], sim[hit]))
    p, r, sim = (np.concatenate([np.empty(0, dtype), *(part[k] for part in parts)]) for k, dtype in enumerate((np.int64, np.int64, float)))
    p, r = pa.array(p), pa.array(r)
    return pa.table({"src": probes.column("src").take(p), "arrival_order": probes.column("arrival_order").take(p), "dst": rows.column("dst").take(r),
                     "dst_kind": rows.column("dst_kind").take(r), "dst_order": rows.column("dst_order").take(r), "sim": pa.array(sim)})


def _best(probes: pa.Table, rows: pa.Table) -> pa.Table:
    """Of one bucket: each probe's ``k`` rows of the greatest similarity (ties: least dst) in each tile,
    among those with born < at < died."""
    probes, rows = probes.combine_chunks(), rows.combine_chunks()
    least, greatest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    at, k_of = _longs(probes, "at", 0), probes.column("k").to_numpy()
    born, died = _longs(rows, "born", least), _longs(rows, "died", greatest)
    ids = np.array(rows.column("dst").to_pylist(), dtype=object)
    ageless = bool((born == least).all() and (died == greatest).all())
    parts: list[tuple] = []
    for dim, ps, rs in _groups(probes, rows):
        rs = rs[np.argsort(ids[rs], kind="stable")]
        (a, an, a32), (b, bn, b32) = _vectors(probes, ps, dim), _vectors(rows, rs, dim)
        if ageless:  # of equal vectors only the first ids can count
            order = np.argsort(np.unique(np.ascontiguousarray(b).view(f"V{8 * dim}").ravel(), return_inverse=True)[1], kind="stable")
            same = np.all(b[order][1:] == b[order][:-1], axis=1)
            run = np.arange(len(order)) - np.maximum.accumulate(np.where(np.append(False, same), 0, np.arange(len(order))))
            keep = np.sort(order[run < k_of[ps].max()])
            rs, b, bn, b32 = rs[keep], b[keep], bn[keep], b32[keep]
        for c in range(0, len(ps), AT_ONCE):
            some = ps[c:c + AT_ONCE]
            met = a32[c:c + AT_ONCE] @ b32.T
            if not ageless:
                met[(born[rs][None, :] >= at[some][:, None]) | (died[rs][None, :] <= at[some][:, None])] = -np.inf
            k = int(k_of[some].max())
            line = np.partition(met, len(rs) - k, axis=1)[:, len(rs) - k] if k < len(rs) else np.full(len(some), -np.inf)
            x, y = np.nonzero((met >= line[:, None] - 2 * _margin(dim)) & (met > -np.inf))
            sim = _exact(a[c:c + AT_ONCE], an[c:c + AT_ONCE], b, bn, x, y)
            order = np.lexsort((y, -sim, x))
            x, y, sim = x[order], y[order], sim[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            hit = place < k_of[some[x]]
            parts.append((some[x[hit]], rs[y[hit]], sim[hit]))
    p, r, sim = (np.concatenate([np.empty(0, dtype), *(part[k] for part in parts)]) for k, dtype in enumerate((np.int64, np.int64, float)))
    return pa.table({"src": probes.column("src").take(pa.array(p)), "dst": rows.column("dst").take(pa.array(r)), "sim": pa.array(sim)})


def _dealt(probes: DataFrame, rows: DataFrame, buckets: int, tasks: int, p_cols: list[str], r_cols: list[str]):
    """Tiles in buckets, whose number grows with the tiles' so that a bucket stays small; tasks by the
    work, which small input may hide (products of few vectors are many)."""
    ship_package(probes.sparkSession)
    bucket = F.pmod(F.xxhash64(*_TILE), F.lit(buckets))
    p = probes.withColumn("bucket", bucket).select("bucket", *_TILE, "cells", "vec", "norm", *p_cols)
    r = rows.withColumn("bucket", bucket).select("bucket", *_TILE, "cell", "vec", "norm", *r_cols)
    return p.repartition(tasks, "bucket").groupBy("bucket").cogroup(r.repartition(tasks, "bucket").groupBy("bucket"))


def pairs_above(probes: DataFrame, rows: DataFrame, lo: float, tile: int | None = None, cells: int = CELLS) -> DataFrame:
    """probes(src, arrival_order, s1-s4, vec, norm), rows(dst, dst_kind, dst_order, s1-s4, vec,
    norm) -> the pairs of a scope with cosine >= ``lo``, rows with an order only before the
    probe's.  Norms must be positive."""
    probes, rows, *shape = _tiles(probes, rows, lo, tile, cells)
    return _dealt(probes, rows, *shape, ["src", "arrival_order"], ["dst", "dst_kind", "dst_order"]).applyInArrow(lambda a, b: _product(a, b, lo), OUT)


def best(probes: DataFrame, rows: DataFrame, tile: int | None = None) -> DataFrame:
    """probes(src, at, k, s1-s4, vec, norm), rows(dst, born, died, s1-s4, vec, norm) -> (src, dst,
    sim): from each tile of a probe's scope the ``k`` rows of the greatest cosine (ties: least
    dst), among which are those of the scope.  Rows count that have born < at < died (nulls:
    always).  Norms must be positive."""
    probes, rows, *shape = _tiles(probes, rows, None, tile)
    kind = dict(probes.dtypes)["src"]
    return _dealt(probes, rows, *shape, ["src", "at", "k"], ["dst", "born", "died"]).applyInArrow(_best, f"src {kind}, dst string, sim double")


class _Part:
    """Some probes of a scope, by time, and the best rows met so far.  Rows come in order of dst, a
    chunk at a time, and none but the chunk's vectors are held."""

    def __init__(self, key: tuple) -> None:
        self.key, self.probes, self.rows = key, [], []
        self.ids, self.marks, self.met = [], [], 0
        self.best: list | None = None

    def add(self, some: pa.RecordBatch) -> None:
        n = int(np.searchsorted(some.column("side").to_numpy(), 1))
        if n:
            self.probes.append(some.slice(0, n))
        if n < some.num_rows and self.probes:
            self.rows.append(some.slice(n))
            if sum(r.num_rows for r in self.rows) * self.key[-1] >= ENTRIES // 2:
                self._look()

    def _open(self) -> None:
        table = pa.Table.from_batches(self.probes).combine_chunks()
        self.probes = [table]
        self.a, self.an, self.a32 = _vectors(table, np.arange(len(table)), self.key[-1])
        self.at, self.k = table.column("begin").to_numpy(), table.column("k").to_numpy().astype(np.int64)
        none = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.best = [none] * -(-len(table) // AT_ONCE)
        self.floor = np.full(len(table), -np.inf)  # similarity that a row must reach

    def _look(self) -> None:
        if self.best is None:
            self._open()
        dim, at = self.key[-1], self.at
        table = pa.Table.from_batches(self.rows).combine_chunks()
        self.rows = []
        self.ids.append(table.column("dst").chunk(0))
        self.marks.append(table.column("mark").chunk(0))
        b, bn, b32 = _vectors(table, np.arange(len(table)), dim)
        born, died, seq = table.column("begin").to_numpy(), table.column("died").to_numpy(), self.met + np.arange(len(table))
        self.met += len(table)
        always = np.flatnonzero((born < at.min()) & (died > at.max()))
        if len(always) > self.k.max():  # of equal vectors only the first ids can count
            which = np.unique(np.ascontiguousarray(b[always]).view(f"V{8 * dim}").ravel(), return_inverse=True)[1].ravel()
            order = np.argsort(which, kind="stable")
            late = np.arange(len(order)) - np.searchsorted(which[order], which[order]) >= self.k.max()
            if late.any():
                keep = np.setdiff1d(np.arange(len(table)), always[order[late]])
                b, bn, b32, born, died, seq = b[keep], bn[keep], b32[keep], born[keep], died[keep], seq[keep]
        for c in range(len(self.best)):
            some = slice(c * AT_ONCE, (c + 1) * AT_ONCE)
            now, first, last = at[some, None], at[some].min(), at[some].max()
            alive = np.flatnonzero((born < last) & (died > first))
            if not len(alive):
                continue
            met = self.a32[some] @ b32[alive].T
            brief = np.flatnonzero((born[alive] >= first) | (died[alive] <= last))
            out = (born[alive[brief]] >= now) | (died[alive[brief]] <= now)
            met[:, brief] = np.where(out, -np.inf, met[:, brief])
            k = int(self.k[some].max())
            line = self.floor[some] - _margin(dim)
            if k < len(alive):
                line = np.maximum(line, np.partition(met, len(alive) - k, axis=1)[:, len(alive) - k] - 2 * _margin(dim))
            line = np.maximum(line, np.finfo(np.float32).min).astype(np.float32)
            x, y = np.divmod(_places(met >= line[:, None]), len(alive))
            if not len(x):
                continue
            y = alive[y]
            sim = _exact(self.a[some], self.an[some], b, bn, x, y)
            x, sim, y = (np.concatenate(pair) for pair in zip(self.best[c], (x, sim, seq[y])))
            order = np.lexsort((y, -sim, x))
            x, sim, y = x[order], sim[order], y[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            hit = place < self.k[some][x]
            full = place == self.k[some][x] - 1
            self.floor[some][x[full]] = sim[full]
            self.best[c] = x[hit], sim[hit], y[hit]

    def found(self):
        if self.rows:
            self._look()
        if self.best is None:
            return
        ids, marks, table = pa.concat_arrays(self.ids), pa.concat_arrays(self.marks), self.probes[0]
        for c in range(0, len(self.best), 8):
            some = self.best[c:c + 8]
            of = table.slice(c * AT_ONCE, len(some) * AT_ONCE)
            x = np.concatenate([part[0] + k * AT_ONCE for k, part in enumerate(some)])
            sim, y = np.concatenate([part[1] for part in some]), pa.array(np.concatenate([part[2] for part in some]))
            ends = np.append(0, np.cumsum(np.bincount(x, minlength=len(of)))).astype(np.int32)
            rows = pa.StructArray.from_arrays([ids.take(y), pa.array(sim), marks.take(y)], names=["dst", "sim", "mark"])
            lists = pa.ListArray.from_arrays(pa.array(ends), rows)
            yield pa.RecordBatch.from_arrays([of.column("src").chunk(0), of.column("k").chunk(0), lists], names=["src", "k", "found"])


def _parts_found(batches):
    """Probes and rows of parts, one part after another and probes first -> the probes with their best rows."""
    part = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("part", "sub", "piece", "dim")], axis=1)
        start = 0
        for end in (*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)):
            key = tuple(keys[start].tolist())
            if part is None or part.key != key:
                if part is not None:
                    yield from part.found()
                part = _Part(key)
            part.add(batch.slice(start, end - start))
            start = end
    if part is not None:
        yield from part.found()


def nearest(probes: DataFrame, rows: DataFrame, tile: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """probes(src, at, k, s1-s4, vec, norm), rows(dst, born, died, s1-s4, vec, norm, mark?) -> (src, k,
    found): the ``k`` rows of the greatest cosine in the probe's scope as an array of (dst, sim,
    mark), the nearest first (ties: least dst).  Rows count that have born < at < died (nulls:
    always).  Norms must be positive.

    A scope's probes are dealt into parts by slices of time, and a row goes to the slices it lives
    in.  A part meets its rows in one task as they stream by, so no pair is ever shuffled.  Where a
    part has very many rows they are dealt to several tasks: the second result (null: there
    is none) has such probes, once for each of them."""
    ship_package(probes.sparkSession)
    scope = [*_SCOPE, "dim"]
    least, greatest = -(1 << 63), (1 << 63) - 1
    probes = probes.filter("k > 0").withColumn("dim", F.size("vec")).withColumn("at", F.coalesce("at", F.lit(0)).cast("bigint"))
    rows = (rows.withColumn("dim", F.size("vec")).withColumn("born", F.coalesce("born", F.lit(least).cast("bigint")))
            .withColumn("died", F.coalesce("died", F.lit(greatest).cast("bigint"))))
    if "mark" not in rows.columns:
        rows = rows.withColumn("mark", F.lit(None).cast("double"))
    asked = probes.groupBy(*scope).agg(F.count("*").alias("m"), F.max("k").alias("most"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    held = F.lit(tile) if tile else F.greatest(F.lit(1024), F.floor(F.lit(ENTRIES) / F.greatest("dim", "most")))
    asked = asked.withColumn("t", held.cast("bigint"))
    sizes = stored(asked.join(rows.select(*scope).distinct(), scope, "left_semi").select(
        *scope, "t", "lo", "hi", F.when(F.col("hi") > F.col("lo"), F.ceil(F.col("m") / F.col("t"))).otherwise(F.lit(1)).alias("slices")))

    def slice_of(time: Column) -> Column:
        lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
        at = F.floor((time.cast("double") - lo) / ((hi - lo + 1) / F.col("slices")))
        return F.least(at, F.col("slices") - 1).cast("int")

    probes = probes.join(sizes, scope).withColumn("slice", slice_of(F.col("at")))
    lived = F.sequence(slice_of(F.greatest("born", "lo")), slice_of(F.least("died", "hi")))
    rows = rows.join(sizes, scope).filter("born < hi and died > lo").withColumn("slice", F.explode(lived))
    key = [*scope, "slice"]
    piece = F.lit(tile) if tile else F.greatest(F.lit(1024), F.floor(F.lit(4 * ENTRIES) / F.col("dim")))
    made = probes.groupBy(*key).agg(F.count("*").alias("m"), F.first("t").alias("t")).join(rows.groupBy(*key).agg(F.count("*").alias("n")), key)
    made = made.select(*key, "m", "n", F.ceil(F.col("m") / F.col("t")).cast("int").alias("subs"), F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    parts = stored(made.withColumn("part", F.monotonically_increasing_id()))
    copies = (F.col("m") * F.col("pieces") + F.col("n") * F.col("subs")).cast("double") * F.greatest("dim", F.lit(16)) / F.lit(ENTRIES)

    def run(some: DataFrame) -> DataFrame:
        work = some.agg(F.sum(copies).alias("full"), F.sum(F.col("m").cast("double") * F.col("n")).alias("products")).first()
        tasks = 1 + math.ceil((work["full"] or 0) / 2) + math.ceil((work["products"] or 0) / PRODUCTS)
        some = some.drop("m", "n")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
        place = ["part", "sub", "piece", "dim"]
        kind = dict(probes.dtypes)["src"]
        p = probes.join(some, key).withColumn("sub", one("src", "subs")).withColumn("piece", every("pieces")).select(
            *place, F.lit(0).alias("side"), "src", F.lit(None).cast("string").alias("dst"), F.col("at").alias("begin"),
            F.lit(None).cast("bigint").alias("died"), F.col("k").cast("int").alias("k"), F.lit(None).cast("double").alias("mark"), "vec", "norm")
        r = rows.join(some, key).withColumn("piece", one("dst", "pieces")).withColumn("sub", every("subs")).select(
            *place, F.lit(1).alias("side"), F.lit(None).cast(kind).alias("src"), "dst", F.col("born").alias("begin"), "died",
            F.lit(None).cast("int").alias("k"), "mark", "vec", "norm")
        order = ["part", "sub", "piece", "side", F.when(F.col("side") == 0, F.col("begin")), "dst"]
        return p.unionByName(r).repartition(tasks, "part", "sub", "piece").sortWithinPartitions(*order).mapInArrow(
            _parts_found, f"src {kind}, k int, found array<struct<dst:string,sim:double,mark:double>>")

    cut = parts.filter("pieces > 1")
    return run(parts.filter("pieces = 1")), None if cut.isEmpty() else run(cut)


def _newest(probes: pa.Table, rows: pa.Table) -> pa.Table:
    """Of one bucket: each probe's ``k`` newest rows of each tile (ties: least dst) with born < at < died.
    Rows are looked through from the newest on, and only as long as a probe lacks some."""
    least, greatest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    found: dict[tuple, list] = {}
    for side, table in enumerate((probes, rows)):
        for at, key in enumerate(zip(*(table.column(c).to_pylist() for c in _TILE))):
            found.setdefault(key, [[], []])[side].append(at)
    at, k_of = _longs(probes, "at", 0), probes.column("k").to_numpy().astype(np.int64)
    born, died, newness = _longs(rows, "born", least), _longs(rows, "died", greatest), rows.column("newness").to_numpy()
    ids = np.array(rows.column("dst").to_pylist(), dtype=object)
    parts: list[tuple] = []
    for ps, rs in found.values():
        rs = np.array(rs, dtype=np.int64)
        rs = rs[np.argsort(ids[rs], kind="stable")]
        rs = rs[np.argsort(-(newness[rs] + 1), kind="stable")]
        for c in range(0, len(ps), 4 * AT_ONCE):
            some = np.array(ps[c:c + 4 * AT_ONCE], dtype=np.int64)
            lacks = k_of[some].copy()
            for start in range(0, len(rs), 512):
                here = rs[start:start + 512]
                alive = (born[here][None, :] < at[some][:, None]) & (died[here][None, :] > at[some][:, None])
                x, y = np.nonzero(alive)
                place = np.arange(len(x)) - np.searchsorted(x, x)
                hit = place < lacks[x]
                parts.append((some[x[hit]], here[y[hit]]))
                lacks -= np.bincount(x[hit], minlength=len(some))
                some, lacks = some[lacks > 0], lacks[lacks > 0]
                if not len(some):
                    break
    p, r = (np.concatenate([np.empty(0, np.int64), *(part[k] for part in parts)]) for k in (0, 1))
    return pa.table({"src": probes.column("src").take(pa.array(p)), "dst": rows.column("dst").take(pa.array(r))})


def newest(probes: DataFrame, rows: DataFrame, tile: int = ENTRIES // 16) -> DataFrame:
    """probes(src, at, k, s1-s4), rows(dst, born, died, newness, s1-s4) -> (src, dst): from each tile
    of a probe's scope the ``k`` newest rows, among which are those of the scope."""
    kind = dict(probes.dtypes)["src"]
    none = [F.array().cast("array<double>").alias("vec"), F.lit(1.0).alias("norm")]
    probes, rows, *shape = _tiles(probes.select("*", *none), rows.select("*", *none), None, tile)
    return _dealt(probes, rows, *shape, ["src", "at", "k"], ["dst", "born", "died", "newness"]).applyInArrow(_newest, f"src {kind}, dst string")


def compared(probes: DataFrame, rows: DataFrame, lo: float, tile: int | None = None, cells: int = CELLS) -> int:
    """The number of products that ``pairs_above`` takes, at most."""
    probes, rows = tiles(probes, rows, lo, tile, cells)
    r = rows.groupBy(*_TILE, "cell").agg(F.count("*").alias("r"))
    whole = probes.filter("cells is null").groupBy(*_TILE).agg(F.count("*").alias("p")).join(r, [*_TILE])
    some = probes.select(*_TILE, F.explode("cells").alias("cell")).groupBy(*_TILE, "cell").agg(F.count("*").alias("p")).join(r, [*_TILE, "cell"])
    return whole.select("p", "r").unionByName(some.select("p", "r")).agg(F.coalesce(F.sum(F.col("p") * F.col("r")), F.lit(0))).first()[0]


def usable(vec: Column, norm: Column) -> Column:
    """Vectors with a direction: others have no similarity to anything."""
    return vec.isNotNull() & (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))


def plain(vec: Column, norm: Column) -> Column:
    """Usable vectors whose products of norms are neither lost nor infinite."""
    return F.coalesce(usable(vec, norm) & (norm > 1e-100) & (norm < 1e100), F.lit(False))
