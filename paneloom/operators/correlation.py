"""Pearson, Spearman and Kendall correlations, pruning of correlated columns and feature selection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.operators.cleaning import numerical_columns
from paneloom.operators.dedupe import union_all
from paneloom.operators.spread import GROUP_ROWS, attach, largest_group, running_total, settle, slices_of

#: Up to this many pairs are computed as built-in aggregates; beyond it per-task moment matrices are added up.
PAIRS_IN_AGGREGATE = 30

#: Columns in a tile, bytes of moments a task holds, rows a column that a task should see, and blocks added at once.
TILE, MOMENT_BYTES, ROWS_PER_COLUMN, FAN_IN = 512, 64 << 20, 12, 8

#: Sums over the rows where both columns of a pair are present.
MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]

#: Kendall: points per bucket aimed at, and grid cells per feature handled by one call.
BUCKET_POINTS = 1_000_000
GRID_CELLS = 2_000_000


def _x(column: str) -> Column:
    return F.col(f"`{column}`").cast("double")


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are present; null if either is constant there.

    The variances are covariances of a column with itself, so equal columns correlate at exactly 1. Constants are
    recognised by their range: merging partial variances can leave them a trace of rounding.
    """
    both = a.isNotNull() & b.isNotNull()
    left, right = F.when(both, a), F.when(both, b)
    varies = (F.min(left) < F.max(left)) & (F.min(right) < F.max(right))
    corr = F.try_divide(
        F.covar_pop(left, right), F.sqrt(F.covar_pop(left, left) * F.covar_pop(right, right))
    )
    return F.when(varies, corr)


# ---------------------------------------------------------------- pairs of columns


def pair_correlations(
    df: DataFrame, cols: Sequence[str] | None = None, *, in_aggregate: int = PAIRS_IN_AGGREGATE
) -> DataFrame:
    """Every unordered pair once: ``col_a, col_b, corr, abs_corr``, with ``col_a`` the earlier column."""
    names = list(cols) if cols is not None else numerical_columns(df)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if len(pairs) <= in_aggregate:
        found = _pairs_by_aggregate(df, names, pairs)
    else:
        found = _pairs_by_moments(df, names)
    return found.withColumn("abs_corr", F.abs("corr"))


def _pairs_by_aggregate(df: DataFrame, names: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(names[i]).alias("col_a"),
            F.lit(names[j]).alias("col_b"),
            pearson(_x(names[i]), _x(names[j])).alias("corr"),
        )
        for i, j in pairs
    ]
    return df.agg(F.array(*entries).alias("pairs")).select(F.inline("pairs"))


def tile_groups(p: int, tile: int, bytes_: int) -> list[list[tuple[int, int]]]:
    """Pairs of tiles (i <= j) in groups that share their first tile and whose moments fit in ``bytes_``."""
    tiles = -(-p // tile)
    width = min(tile, p)
    fit = max(1, bytes_ // (8 * len(MOMENTS) * width * width))
    return [
        [(i, j) for j in range(low, min(low + fit, tiles))] for i in range(tiles) for low in range(i, tiles, fit)
    ]


def _pairs_by_moments(
    df: DataFrame, names: list[str], *, tile: int = TILE, bytes_: int = MOMENT_BYTES, fan_in: int = FAN_IN
) -> DataFrame:
    """Masked moment matrices by tiles of columns, summed over the tasks by a tree.

    The columns are cut into tiles. A group of tile pairs reads the columns of its own tiles only, and a task holds the
    moments of one group: ``bytes_`` and a batch of rows, however many columns there are. Tasks are merged until each
    has ``ROWS_PER_COLUMN`` rows a column, so the moments that leave it stay a part of what it read. A matrix travels as
    one block, and each step of the tree adds ``fan_in`` of them.

    Values are shifted by the column means first, which keeps the sums of squares well conditioned; a constant
    column is shifted by its value and becomes exact zeros.
    """
    narrow = df.select(*[_x(c).alias(f"c{i}") for i, c in enumerate(names)])
    known = narrow.withColumn("_part", F.spark_partition_id()).agg(F.count(F.lit(1)), F.max("_part"), *[
        F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)) for c in narrow.columns
    ]).first()
    shift = np.array([0.0 if m is None else m for m in known[2:]])
    p, parts = len(names), (known[1] or 0) + 1
    tasks = max(1, min(parts, -(-known[0] // (ROWS_PER_COLUMN * p))))
    scans = [
        _tile_moments(narrow, group, tile, shift, tasks if tasks < parts else None)
        for group in tile_groups(p, tile, bytes_)
    ]
    blocks = union_all(scans)
    while tasks > fan_in + 1:  # the numbers of a group's tasks follow one another, from any number on
        tasks = -(-tasks // fan_in) + 1
        up = blocks.withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
        blocks = up.groupBy("i", "j", "part").applyInPandas(_added, blocks.schema)
    blocks = blocks.groupBy("i", "j").applyInPandas(_added, blocks.schema)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                width = min(tile, p - row.i * tile), min(tile, p - row.j * tile)
                m = np.frombuffer(row.moments).reshape(len(MOMENTS), *width)
                x, y = np.triu_indices(width[0], 1) if row.i == row.j else np.indices(width).reshape(2, -1)
                yield pd.DataFrame(
                    {"i": x + row.i * tile, "j": y + row.j * tile} | {c: m[k][x, y] for k, c in enumerate(MOMENTS)}
                )

    total = blocks.mapInPandas(unpack, "i int, j int, " + ", ".join(f"{c} double" for c in MOMENTS))
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    label = F.array(*[F.lit(c) for c in names])
    corr = F.when((vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx * vy)))
    return total.select(
        label[F.col("i")].alias("col_a"), label[F.col("j")].alias("col_b"), corr.alias("corr")
    )


def _tile_moments(
    narrow: DataFrame, group: list[tuple[int, int]], tile: int, shift: np.ndarray, tasks: int | None
) -> DataFrame:
    """(i, j, part, moments): the sums of one group of tile pairs over the rows of each task."""
    p = len(shift)
    tiles = sorted({t for pair in group for t in pair})
    columns = {t: np.arange(t * tile, min(p, (t + 1) * tile)) for t in tiles}
    order = np.concatenate([columns[t] for t in tiles])
    begin = dict(zip(tiles, np.cumsum([0] + [len(columns[t]) for t in tiles])))
    own = narrow.select(*[f"c{c}" for c in order])
    own = own.coalesce(tasks) if tasks else own

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {(i, j): np.zeros((len(MOMENTS), len(columns[i]), len(columns[j]))) for i, j in group}
        any_ = False
        for batch in batches:
            any_ = True
            x = batch.to_numpy(dtype=float)
            present = ~np.isnan(x)
            x = np.where(present, x - shift[order], 0.0)
            mask = present.astype(float)

            def part(of, t):
                return of[:, begin[t]:begin[t] + len(columns[t])]

            for (i, j), m in sums.items():
                xi, xj, mi, mj = part(x, i), part(x, j), part(mask, i), part(mask, j)
                m += np.stack([mi.T @ mj, xi.T @ mj, mi.T @ xj, (xi * xi).T @ mj, mi.T @ (xj * xj), xi.T @ xj])
        if any_:
            number = TaskContext.get().partitionId()
            rows = [(i, j, number, m.tobytes()) for (i, j), m in sums.items()]
            yield pd.DataFrame(rows, columns=["i", "j", "part", "moments"])

    return own.mapInPandas(moments, "i int, j int, part int, moments binary")


def _added(blocks: pd.DataFrame) -> pd.DataFrame:
    """The sum of the moments of some tasks, in the order of their numbers."""
    first = blocks.iloc[0]
    total = sum(np.frombuffer(m) for m in blocks.moments)
    return pd.DataFrame([(first.i, first.j, first.part, total.tobytes())], columns=["i", "j", "part", "moments"])


def prune_correlated(
    df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.95, *, include_perfect: bool = False
) -> list[str]:
    """Columns left after repeatedly dropping the later column of the strongest pair above ``threshold``.

    Pairs at exactly 1 do not count unless ``include_perfect``. Dropping a column changes no other pair, so the pairs
    are computed once; ``later_of_strongest`` decides them in rounds, and only names of dropped columns leave Spark.
    """
    names = list(cols) if cols is not None else numerical_columns(df)
    strong = pair_correlations(df, names).where(F.col("abs_corr") > threshold)
    if not include_perfect:
        strong = strong.where(F.col("abs_corr") < 1.0)
    place = F.create_map(*[F.lit(v) for i, c in enumerate(names) for v in (c, i)]) if names else F.lit(None)
    edges = strong.select(place[F.col("col_a")].alias("a"), place[F.col("col_b")].alias("b"), "abs_corr")
    dropped = {names[r.b] for r in later_of_strongest(edges).collect()}
    return [c for c in names if c not in dropped]


def later_of_strongest(edges: DataFrame) -> DataFrame:
    """(b): what a pass over the edges (a < b, abs_corr), strongest first, drops: b, if a and b are still there.

    An edge is decided as soon as its own fate is certain: no undecided stronger edge could drop ``a``. It drops ``b`` if
    no decided stronger edge has dropped ``a``, and is void otherwise. All such edges are decided in one round, among
    them always the strongest one left; an edge weaker than the one that drops its ``b`` is of no use any more. The
    rounds follow the longest chain of ever weaker edges, not the number of edges.
    """
    key = F.struct((-F.col("abs_corr")).alias("weak"), "a", "b")
    state = edges.select("a", "b", key.alias("key"), F.lit(False).alias("sure"))
    while True:
        state = settle(state)
        if state.where("NOT sure").isEmpty():
            return state.select("b").distinct()
        # One row per column of the table, so a small table by its nature.
        fate = F.broadcast(state.groupBy("b").agg(
            F.min(F.when(F.col("sure"), F.col("key"))).alias("at"), F.min(F.when(~F.col("sure"), F.col("key"))).alias("threat")
        ))
        of_a = fate.select(F.col("b").alias("a"), F.col("at").alias("_gone"), F.col("threat").alias("_threat"))
        of_b = fate.select("b", F.col("at").alias("_done"))
        judged = state.join(of_a, "a", "left").join(of_b, "b", "left")
        void = ~F.col("sure") & (F.coalesce(F.col("_gone") < F.col("key"), F.lit(False)) | (F.col("_done") < F.col("key")))
        sure = F.col("sure") | F.col("_threat").isNull() | (F.col("_threat") > F.col("key"))
        state = judged.where(~F.coalesce(void, F.lit(False))).select("a", "b", "key", sure.alias("sure"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], *, corner: bool = True) -> DataFrame:
    """Pearson matrix in long form; ``corner`` keeps the lower triangle without the diagonal."""
    pairs = pair_correlations(df, cols).select(
        F.col("col_b").alias("row"), F.col("col_a").alias("col"), "corr"
    )
    if corner:
        return pairs
    mirrored = pairs.select(F.col("col").alias("row"), F.col("row").alias("col"), "corr")
    spark = df.sparkSession
    diagonal = spark.createDataFrame([(c, c, 1.0) for c in cols], pairs.schema)
    return pairs.unionByName(mirrored).unionByName(diagonal)


# ---------------------------------------------------------------- columns against a target


def target_correlations(
    df: DataFrame,
    cols: Sequence[str],
    target: str,
    method: str = "pearson",
    *,
    group_rows: int = GROUP_ROWS,
    slices: int | None = None,
    points: DataFrame | None = None,
) -> DataFrame:
    """``feature, method, abs_corr`` below 1, for each column against ``target``.

    Spearman and Kendall work on the value counts of ``target_points``; pass the same ``points`` to both.
    """
    if method == "pearson":
        entries = [
            F.struct(F.lit(c).alias("feature"), pearson(_x(c), _x(target)).alias("corr")) for c in cols
        ]
        found = df.agg(F.array(*entries).alias("all")).select(F.inline("all"))
    elif method in ("spearman", "kendall"):
        points = target_points(df, cols, target) if points is None else points
        found = _spearman(points, group_rows) if method == "spearman" else _kendall(points, slices or slices_of(df))
    else:
        raise ValueError("method must be pearson, spearman or kendall")
    return found.select(
        "feature", F.lit(method).alias("method"), F.abs("corr").alias("abs_corr")
    ).where(F.col("abs_corr") < 1.0)


def target_points(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """``feature, x, y, n``: how often each pair of values occurs, computed once."""
    return settle(_pairs_with_target(df, cols, target).groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n")))


def _pairs_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Long form ``feature, x, y`` over the rows where both are present."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), _x(c).alias("x")) for c in cols])
    long = df.select(_x(target).alias("y"), F.explode(entries).alias("e"))
    return long.select("e.feature", "e.x", "y").where("x IS NOT NULL AND y IS NOT NULL")


def _spearman(points: DataFrame, group_rows: int) -> DataFrame:
    """Pearson over average ranks, from value counts: ranks are prefix sums of counts, moments are weighted by them.

    While the points of a feature fit a task, both ranks come from windows over one partitioning by feature. Otherwise
    the counts of the distinct values are summed over range-partitioned slices, and the ranks are joined back.
    """
    if group_rows and largest_group(points, ["feature"]) <= group_rows:
        ranked = points
        for axis in ("x", "y"):
            up = Window.partitionBy("feature").orderBy(axis)  # up to and with the equal values
            ties = Window.partitionBy("feature", axis)
            ranked = ranked.withColumn(
                f"r{axis}", F.sum("n").over(up) - (F.sum("n").over(ties) - 1) / F.lit(2.0)
            )
    else:
        ranked = points
        for axis in ("x", "y"):
            runs = points.groupBy("feature", axis).agg(F.sum("n").alias("_t"))
            above = running_total(runs, ["feature"], [F.col(axis).asc()], F.col("_t"), "_above")
            ranks = above.select("feature", axis, (F.col("_above") + (F.col("_t") + 1) / F.lit(2.0)).alias(f"r{axis}"))
            ranked = attach(ranked, ranks, ["feature", axis])
    middle = points.groupBy("feature").agg(((F.sum("n") + 1) / F.lit(2.0)).alias("_middle"))
    centred = ranked.join(F.broadcast(middle), "feature").select(  # one row per column of the table
        "feature", "n", (F.col("rx") - F.col("_middle")).alias("a"), (F.col("ry") - F.col("_middle")).alias("b")
    )
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    sums = centred.groupBy("feature").agg(
        F.sum(n * a * b).alias("ab"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb")
    )
    norm = F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))
    return sums.select("feature", F.when(norm > 0, F.col("ab") / norm).alias("corr"))


def signed_pairs(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Concordant minus discordant weighted pairs, in O(m log² m) array steps.

    Two different y-ranks first differ at exactly one bit, counted from the top. So for each bit, within the rows
    that share the higher bits, the rows with a 0 are compared by x with those with a 1: every pair is met once.
    """
    if len(x) < 2:
        return 0.0
    rx = np.unique(x, return_inverse=True)[1]
    ry = np.unique(y, return_inverse=True)[1]
    total = 0.0
    for bit in range(int(ry.max()).bit_length()):
        prefix, one = ry >> (bit + 1), (ry >> bit) & 1
        order = np.lexsort((rx, prefix))
        p, r = prefix[order], rx[order]
        high = one[order].astype(bool)
        w = weight[order].astype(float)
        low = np.concatenate(([0.0], np.cumsum(np.where(high, 0.0, w))))
        new_p = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        new_r = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (r[1:] != r[:-1])])
        sizes_p = np.diff(np.r_[new_p, len(p)])
        sizes_r = np.diff(np.r_[new_r, len(p)])
        before = low[np.repeat(new_r, sizes_r)] - low[np.repeat(new_p, sizes_p)]
        after = low[np.repeat(new_p + sizes_p, sizes_p)] - low[np.repeat(new_r + sizes_r, sizes_r)]
        total += float(np.sum(np.where(high, w * (before - after), 0.0)))
    return total


def _kendall(points: DataFrame, slices: int, *, grid_cells: int = GRID_CELLS) -> DataFrame:
    """Tau-b without listing pairs: signed pairs over the square root of the untied pairs of either side."""
    def tied(axis: str) -> DataFrame:
        t = F.col("t").cast("double")
        runs = points.groupBy("feature", axis).agg(F.sum("n").alias("t"))
        return runs.groupBy("feature").agg(
            F.sum(t * (t - 1) / 2).alias(f"ties_{axis}"), F.sum(t).alias("rows")
        )

    signed = union_all(_signed_parts(points, slices, grid_cells)).groupBy("feature").agg(F.sum("s").alias("s"))
    ties = tied("x").join(tied("y").drop("rows"), "feature")
    all_pairs = F.col("rows") * (F.col("rows") - 1) / 2
    norm = F.sqrt((all_pairs - F.col("ties_x")) * (all_pairs - F.col("ties_y")))
    return signed.join(ties, "feature").select("feature", F.try_divide(F.col("s"), norm).alias("corr"))


def _signed_parts(points: DataFrame, slices: int, grid_cells: int) -> list[DataFrame]:
    """Tables ``feature, s`` whose sum per feature is the signed pairs of ``feature, x, y, n``.

    Each axis is cut at approximate quantiles; a cut value is a bucket of its own and the open range between two
    cuts is another, so a bucket stays small unless it holds one value. Every pair is of one kind:

    * same x bucket: counted inside the bucket, with the exact x and y;
    * same y bucket only: counted inside that bucket, with the x bucket standing in for x;
    * both buckets differ: the bucket counts form a grid, which is again a set of weighted points. It is small
      enough for one call per feature, or it is cut once more, more coarsely.

    One-value buckets hold ties only and are skipped, so a value shared by most rows costs nothing.
    """
    parts = []
    count = max(points.count(), 1)
    cuts = max(slices, math.ceil(count / BUCKET_POINTS))
    while True:
        located = settle(_locate(points, cuts))
        parts.append(
            located.where("bx % 2 = 0").groupBy("feature", "bx")
            .applyInPandas(_signed_score("x", "y"), "feature string, s double")
        )
        parts.append(
            located.where("by % 2 = 0").groupBy("feature", "by", "bx", "y")
            .agg(F.sum("n").alias("n")).groupBy("feature", "by")
            .applyInPandas(_signed_score("bx", "y"), "feature string, s double")
        )
        grid = settle(located.groupBy("feature", "bx", "by").agg(F.sum("n").alias("n")))
        if cuts <= 2 or largest_group(grid, ["feature"]) <= grid_cells:
            parts.append(
                grid.groupBy("feature").applyInPandas(_signed_score("bx", "by"), "feature string, s double")
            )
            return parts
        points = grid.select(
            "feature", F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y"), "n"
        )
        cuts = max(2, min(cuts // 2, max(slices, math.ceil(grid.count() / BUCKET_POINTS))))


def _locate(points: DataFrame, slices: int) -> DataFrame:
    """Add the bucket numbers ``bx`` and ``by``: odd for a cut value, even for the range between two cuts."""
    shares = F.array(*[F.lit(k / slices) for k in range(1, max(slices, 2))])
    accuracy = F.lit(slices * 20)
    bounds = points.groupBy("feature").agg(
        F.percentile_approx("x", shares, accuracy).alias("x"),
        F.percentile_approx("y", shares, accuracy).alias("y"),
    )
    # One row of cut values per feature.
    edges = {r.feature: (np.unique(r.x), np.unique(r.y)) for r in bounds.collect()}

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = np.zeros((2, len(batch)), dtype=np.int64)
            for feature, at in batch.groupby("feature", sort=False).indices.items():
                for axis, name in enumerate(("x", "y")):
                    edge = edges[feature][axis]
                    value = batch[name].to_numpy()[at]
                    below = np.searchsorted(edge, value, side="left")
                    exact = below < len(edge)
                    exact[exact] = edge[below[exact]] == value[exact]
                    codes[axis, at] = 2 * below + exact
            yield batch.assign(bx=codes[0], by=codes[1])

    return points.mapInPandas(locate, "feature string, x double, y double, n long, bx long, by long")


def _signed_score(x: str, y: str):
    """:func:`signed_pairs` for one group of points."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        s = signed_pairs(group[x].to_numpy(), group[y].to_numpy(), group["n"].to_numpy())
        return pd.DataFrame({"feature": [group["feature"].iloc[0]], "s": [s]})

    return run


def select_features(
    correlations: DataFrame, *, threshold: float | None = None, top_n: int | None = None
) -> list[str]:
    """Names from a ``feature, abs_corr`` table: strictly above ``threshold``, or the ``top_n`` strongest."""
    if (threshold is None) == (top_n is None):
        raise ValueError("give either threshold or top_n")
    ordered = correlations.orderBy(F.col("abs_corr").desc(), "feature")
    kept = ordered.where(F.col("abs_corr") > threshold) if threshold is not None else ordered.limit(top_n)
    return [r.feature for r in kept.select("feature").collect()]
