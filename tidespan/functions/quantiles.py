"""Exact quantiles of large groups, without gathering a group's values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of up to so many values are left to the built-in percentile, which keeps a group's distinct values in a task.
GATHERED = 1_000_000
#: Cells that a range is cut into in each round, and values from which on a range is sorted instead.
CELLS, SORTED = 256, 4096


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], gathered: int = GATHERED) -> DataFrame:
    """by, q0, q1, ...: the quantile of each share with linear interpolation, null for a group without values.

    Where a group has more than `gathered` values, the two values round each quantile are found by rounds of histograms
    over a narrowing range.  What reaches the driver is a range per group and share; groups are features or whole
    columns here, thousands at most.
    """
    sizes = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    plain = lambda x: x.groupBy(*by).agg(*[F.percentile(value, F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(shares)])
    if not (sizes.agg(F.max("n")).first()[0] or 0) > gathered:
        return plain(df)
    found: list[tuple] = []
    for r in sizes.collect():
        key, n = tuple(r[c] for c in by), r["n"]
        for i, p in enumerate(shares):
            at = (n - 1) * p
            found += [(*key, i, side, min(math.floor(at) + side, n - 1), 0, n, r["lo"], r["hi"]) for side in (0, 1)] if n else []
    names = [f"_{c}" for c in by]
    kinds = ", ".join(f"_{c} {dict(df.dtypes)[c]}" for c in by)
    done: dict[tuple, float] = {}
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    while found:
        # (group, share, side): rank wanted, values below the range, values in it, its ends
        table = df.sparkSession.createDataFrame(found, (kinds + ", " if by else "") + "share int, side int, want long, below long, n long, lo double, hi double")
        inside = rows.join(F.broadcast(table), [*match, F.col("_v").between(F.col("lo"), F.col("hi"))])
        key = [*names, "share", "side"]
        state = {tuple(x[: len(by) + 2]): x for x in found}
        small = {k for k, x in state.items() if x[-3] <= SORTED}
        flat = {k for k, x in state.items() if x[-2] == x[-1]}
        done |= {k: state[k][-2] for k in flat}
        found = []
        values: dict[tuple, list[float]] = {}
        for r in inside.where(F.col("n") <= SORTED).where("lo < hi").select(*key, "_v").collect() if small - flat else ():
            values.setdefault(tuple(r[c] for c in key), []).append(r["_v"])
        for k, v in values.items():
            x = state[k]
            done[k] = sorted(v)[x[-5] - x[-4]]
        if len(small | flat) < len(state):
            cell = F.least(F.floor((F.col("_v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / CELLS)), F.lit(CELLS - 1))
            cells = inside.where((F.col("n") > SORTED) & (F.col("lo") < F.col("hi"))).groupBy(*key, cell.alias("c")).agg(F.count("*").alias("m"), F.min("_v").alias("a"), F.max("_v").alias("b"))
            below: dict[tuple, int] = {}
            placed: set[tuple] = set()
            for r in cells.orderBy(*key, "c").collect():  # CELLS rows per group, share and side at most
                k = tuple(r[c] for c in key)
                x = state[k]
                start = below.get(k, x[-4])
                below[k] = start + r["m"]
                if k not in placed and x[-5] < start + r["m"]:
                    placed.add(k)
                    found.append((*k, x[-5], start, r["m"], r["a"], r["b"]))
    out = []
    for r in sizes.select(*by, "n").collect():
        key, n = tuple(r[c] for c in by), r["n"]
        q = []
        for i, p in enumerate(shares):
            if not n:
                q.append(None)
                continue
            a, b, part = done[*key, i, 0], done[*key, i, 1], (n - 1) * p - math.floor((n - 1) * p)
            q.append(a + (b - a) * part)
        out.append((*key, *q))
    return df.sparkSession.createDataFrame(out, ", ".join([f"{c} {dict(df.dtypes)[c]}" for c in by] + [f"q{i} double" for i in range(len(shares))]))
