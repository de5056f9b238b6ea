"""Greedy packing of ordered rows into bounded packs, in parallel.

Greedy packing is sequential: where a pack starts depends on all packs before it.  But a pack holds at
most ``bound`` rows, so inside a block of consecutive rows only ``bound`` entry points are possible.
Each block works out, for every entry point, where its last pack ends in the next block and how many
packs it makes; chaining these small tables gives every block its true entry point; a second pass then
numbers the rows.  No group is read by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from granary.operators.ordering import with_position

BLOCK_ROWS = 50_000
Reach = Callable[[dict[str, np.ndarray], int], int]
Ends = Callable[[dict[str, np.ndarray]], np.ndarray]


def packed(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    reach: Reach | None,
    bound: int,
    name: str = "pack",
    block_rows: int = BLOCK_ROWS,
    ends: Ends | None = None,
) -> DataFrame:
    """Number the packs of each group from zero.

    ``reach(columns, start)`` returns the index after the last row of the pack that starts at ``start``;
    it may look at most ``bound`` rows ahead.  ``ends(columns)`` may be given in its place and returns these for all
    starts at once; in the rows that only look ahead they are not used.  Group columns must not be null.
    """
    if block_rows < bound:
        raise ValueError("a block must hold at least one pack")
    group, columns = list(group), list(columns)
    placed = with_position(df, group, order, "_at")
    index = F.col("_at") - 1
    own = F.floor(index / block_rows)
    blocks = F.when((index % block_rows < bound) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = placed.select(*group, "_at", *columns, F.explode(blocks).alias("_block"))
    keys = [*group, "_block"]

    def key_schema() -> T.StructType:
        fields = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name in keys]
        return T.StructType(sorted(fields, key=lambda f: keys.index(f.name)))

    def arrays(pdf: pd.DataFrame) -> tuple[dict[str, np.ndarray], int]:
        """Columns in order and the number of the block's own rows (the rest looks ahead)."""
        pdf.sort_values("_at", inplace=True)
        first = int(pdf["_block"].iloc[0]) * block_rows
        return {c: pdf[c].to_numpy() for c in columns}, int((pdf["_at"] <= first + block_rows).sum())

    def steps(values: dict[str, np.ndarray]) -> Callable[[int], int]:
        return partial(reach, values) if ends is None else ends(values).tolist().__getitem__

    def explore(pdf: pd.DataFrame) -> pd.DataFrame:
        values, size = arrays(pdf)
        step = steps(values)
        known: dict[int, tuple[int, int]] = {}
        for entry in range(min(bound + 1, size)):
            path, at = [], entry
            while at < size and at not in known:
                path.append(at)
                at = step(at)
            end, count = known.get(at, (at, 0))
            for start in reversed(path):
                count += 1
                known[start] = (end, count)
        entries = range(min(bound + 1, size))
        out = {k: [pdf[k].iloc[0]] for k in keys}
        out["_exits"] = [[max(0, known[e][0] - block_rows) for e in entries]]
        out["_counts"] = [[known[e][1] for e in entries]]
        return pd.DataFrame(out)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        entry, base, entries, bases = 0, 0, [], []
        for exits, counts in zip(pdf["_exits"], pdf["_counts"]):
            entries.append(entry)
            bases.append(base)
            if entry < len(exits):  # a short last block may lie wholly inside the pack before it
                base += int(counts[entry])
                entry = int(exits[entry])
        return pdf[keys].assign(_entry=entries, _base=bases)

    def number(pdf: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        values, size = arrays(pdf)
        step = steps(values)
        at, pack = int(entered["_entry"].iloc[0]), int(entered["_base"].iloc[0])
        packs = np.full(size, pack - 1, dtype="int64")
        while at < size:
            end = step(at)
            packs[at:end] = pack
            at, pack = end, pack + 1
        return pdf.iloc[:size][[*group, "_at"]].assign(**{name: packs})

    schema = key_schema()
    tables = T.StructType(schema.fields + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("_exits", "_counts")])
    starts = T.StructType(schema.fields + [T.StructField(n, T.LongType()) for n in ("_entry", "_base")])
    numbered = T.StructType(
        [f for f in schema.fields if f.name != "_block"] + [T.StructField(n, T.LongType()) for n in ("_at", name)]
    )
    explored = rows.groupBy(*keys).applyInPandas(explore, tables)
    entered = explored.groupBy(*group).applyInPandas(chain, starts)
    # both passes read the rows as dealt over blocks once
    result = rows.groupBy(*keys).cogroup(entered.groupBy(*keys)).applyInPandas(number, numbered)
    return placed.join(result, [*group, "_at"]).drop("_at")
