"""Distinct counts over huge sets by mergeable registers of minimum exponential hash values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTERS = 2048
#: Registers hold whole numbers of this fraction, so that sums are the same in any order.
UNIT = 2.0**56
EMPTY = np.iinfo(np.int64).max
#: A row of a sketch holds so many registers or items, so that no batch of rows is large.
WIDTH = 128
#: A set of at most so many items in a task is given out as its items, which are fewer bytes than registers.
SPARSE = 1024
#: A task gives out what it has when it has registers of so many groups, or so many items; partial results merge.
HELD, PENDING = 1000, 1 << 20
#: Arrivals drawn at once.
DRAW = 1 << 16
SIGMA = 1 / math.sqrt(REGISTERS - 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fill(registers: np.ndarray, group: np.ndarray, item: np.ndarray) -> None:
    """Lowers ``registers`` (groups x m) by the items (hashes) of each group.

    An item is a Poisson process of rate m, seeded by its hash; every arrival falls into a random register. So the first
    arrival in each register is exponential with rate 1, independent of the others, and n items leave the minimum of n in
    each. Arrivals come in order of time; an item ends when it is later than all registers of its group.
    """
    m = registers.shape[1]
    flat = registers.reshape(-1)
    step = np.uint64(0x9E3779B97F4A7C15)
    at, drawn = np.zeros(len(item), np.int64), 0
    with np.errstate(over="ignore"):
        while len(item):
            width = int(np.clip(DRAW // len(item), 1, m))
            k = (np.arange(drawn, drawn + width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * step
            bits = item[:, None] + k[None, :]
            u = ((_mix(bits) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            times = at[:, None] + np.cumsum((-np.log(u) * (UNIT / m)).astype(np.int64), axis=1)
            slot = (_mix(bits + step) >> np.uint64(32)) % np.uint64(m)
            latest = registers.max(axis=1)
            useful = times < latest[group][:, None]
            where = (group[:, None] * m + slot.astype(np.int64))[useful]
            np.minimum.at(flat, where, times[useful])
            at, drawn = times[:, -1], drawn + width
            alive = at < registers.max(axis=1)[group]
            item, group, at = item[alive], group[alive], at[alive]


def _rows(keys: list[tuple], parts: list[int], values: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows (groups, part, values)."""
    for i in range(0, len(keys), 4096):
        some = slice(i, i + 4096)
        columns = [pa.array([k[c] for k in keys[some]], schema.field(c).type) for c in range(len(schema) - 2)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values[some]])]), pa.int32()), pa.array(np.concatenate(values[some])))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(parts[some], pa.int32()), lists.cast(schema.field("values").type)], schema=schema)


class _Held:
    """What a task knows of its groups: the items of small sets, the registers of large ones."""

    def __init__(self, schema: pa.Schema, m: int):
        self.schema, self.m = schema, m
        self.reset()

    def reset(self) -> None:
        self.codes: dict[tuple, int] = {}
        self.dense: dict[int, int] = {}
        self.registers = np.full((0, self.m), EMPTY, np.int64)
        self.groups, self.items, self.n = [], [], 0

    def add(self, code: np.ndarray, keys: list[tuple], item: np.ndarray) -> None:
        own = np.array([self.codes.setdefault(k, len(self.codes)) for k in keys], np.int64)
        self.groups.append(own[code])
        self.items.append(item)
        self.n += len(item)

    def squeeze(self) -> tuple[np.ndarray, np.ndarray]:
        """Each item of a group once; those of sets that are large go to registers."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        g, x = np.concatenate(self.groups), np.concatenate(self.items)
        order = np.lexsort((x, g))
        g, x = g[order], x[order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        g, x = g[first], x[first]
        large = np.bincount(g, minlength=len(self.codes)) > SPARSE
        large[list(self.dense)] = True
        new = [c for c in np.flatnonzero(large).tolist() if c not in self.dense]
        self.dense.update({c: len(self.dense) + i for i, c in enumerate(new)})
        self.registers = np.vstack([self.registers, np.full((len(new), self.m), EMPTY, np.int64)])
        row = np.full(len(self.codes), -1, np.int64)
        row[list(self.dense)] = list(self.dense.values())
        hit = large[g]
        fill(self.registers, row[g[hit]], x[hit])
        g, x = g[~hit], x[~hit]
        self.groups, self.items, self.n = [g], [x], len(g)
        return g, x

    def out(self) -> Iterator[pa.RecordBatch]:
        g, x = self.squeeze()
        named = list(self.codes)
        keys, parts, values = [], [], []
        for c, row in self.dense.items():
            for p in range(0, self.m, WIDTH):
                keys.append(named[c])
                parts.append(p // WIDTH)
                values.append(self.registers[row, p : p + WIDTH])
        starts = np.flatnonzero(np.diff(g, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(g)]):
            for p in range(a, b, WIDTH):
                keys.append(named[g[a]])
                parts.append(-1)
                values.append(x[p : min(b, p + WIDTH)].view(np.int64))
        yield from _rows(keys, parts, values, self.schema)
        self.reset()


def _partial(groups: list[str], schema: pa.Schema, m: int):
    def run(batches):
        held = _Held(schema, m)
        for batch in batches:
            table = batch.to_pandas(types_mapper=pd.ArrowDtype)
            code, keys = pd.MultiIndex.from_frame(table[groups].astype(object)).factorize(use_na_sentinel=False)
            keys = [tuple(None if x is None or x is pd.NA or x != x else x for x in k) for k in keys]
            held.add(code, keys, table["_item"].to_numpy(np.int64).view(np.uint64))
            if held.n > PENDING:
                held.squeeze()
                if held.n > PENDING // 2 or len(held.dense) > HELD:
                    yield from held.out()
        if held.codes:
            yield from held.out()

    return run


def _fold(groups: list[str], schema: pa.Schema, m: int):
    """Merges rows that are sorted by group; one group is held at a time."""

    def run(batches):
        key, registers, items, n = None, np.full((1, m), EMPTY, np.int64), [], 0

        def settle():
            nonlocal items, n
            if items:
                fill(registers, np.zeros(len(x := np.unique(np.concatenate(items))), np.int64), x)
                items, n = [], 0

        def done():
            settle()
            yield from _rows([key] * (m // WIDTH), list(range(m // WIDTH)), list(registers.reshape(-1, WIDTH).copy()), schema)
            registers.fill(EMPTY)

        for batch in batches:
            lists = batch.column("values")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            parts = batch.column("part").to_pylist()
            for i, k in enumerate(zip(*[batch.column(g).to_pylist() for g in groups], strict=True)):
                if k != key:
                    if key is not None:
                        yield from done()
                    key = k
                own = flat[offsets[i] : offsets[i + 1]]
                if parts[i] < 0:
                    items.append(own.view(np.uint64))
                    n += len(own)
                    if n > PENDING:
                        settle()
                else:
                    at = registers[0, parts[i] * WIDTH : parts[i] * WIDTH + WIDTH]
                    np.minimum(at, own, out=at)
        if key is not None:
            yield from done()

    return run


def _schema(sketches: DataFrame, groups: list[str]) -> tuple[pa.Schema, str]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = sketches.select(*groups).schema
    arrow = to_arrow_schema(kept).append(pa.field("part", pa.int32())).append(pa.field("values", pa.list_(pa.int64())))
    return arrow, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", part int, values array<bigint>"


def merge(sketches: DataFrame, groups: list[str], m: int = REGISTERS) -> DataFrame:
    """One sketch per group: the least value of each register. The rows of a group pass one after the other, so neither their
    number nor that of groups is bounded by memory."""
    arrow, declared = _schema(sketches, groups)
    rows = sketches.select(*groups, "part", "values").repartition(*groups).sortWithinPartitions(*groups)
    return rows.mapInArrow(_fold(groups, arrow, m), declared)


def partial_sketches(rows: DataFrame, groups: list[str], item: str, m: int = REGISTERS) -> DataFrame:
    """(groups, part, values) of each task: rows with part -1 hold items of a small set, others the registers of a part of all
    m. Rows of one group merge in any order and number, also with those of other tables."""
    rows = rows.where(F.col(item).isNotNull()).select(*groups, F.xxhash64(item).alias("_item"))
    arrow, declared = _schema(rows, groups)
    return rows.mapInArrow(_partial(groups, arrow, m), declared)


def sketch(rows: DataFrame, groups: list[str], item: str, m: int = REGISTERS) -> DataFrame:
    """(groups, part, values): a mergeable sketch of the distinct ``item`` of each group, m registers in parts of WIDTH.

    Null items do not count; null group values are a group. Equal items count once, wherever they are. Extra columns are left
    out. An empty table gives an empty one.
    """
    return merge(partial_sketches(rows, groups, item, m), groups, m)


def roll_up(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """``sketches`` with those of all combinations of ``groups``; a column that a combination leaves out is null, and the
    column ``level`` has the number of the combination: bit i is set if groups[i] is left out."""
    n = len(groups)
    levels = sketches.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(2**n)])))
    for i, g in enumerate(groups):
        levels = levels.withColumn(g, F.when(F.col("level").bitwiseAND(1 << i) == 0, F.col(g)))
    return merge(levels.select(*groups, "level", "part", "values"), [*groups, "level"])


def _gamma_quantile(m: int, z: float) -> float:
    """Of Gamma(m, 1), by the cube of a normal variable (Wilson and Hilferty), to some 1e-6 at this m."""
    return m * (1 - 1 / (9 * m) + z / math.sqrt(9 * m)) ** 3


def estimates(sketches: DataFrame, z: float = 1.96, m: int = REGISTERS) -> DataFrame:
    """The groups of merged ``sketches`` with estimate, low and high.

    The registers of n items add up to a Gamma(m, n) variable S, so (m - 1) / S is unbiased, with a relative standard
    deviation of 1 / sqrt(m - 2), and n lies between the gamma quantiles over S with the probability of ``z``.
    """
    kept = [c for c in sketches.columns if c not in ("part", "values")]
    exact = "decimal(38,0)"
    of_part = F.aggregate("values", F.lit(0).cast(exact), lambda a, x: (a + x).cast(exact))
    s = sketches.groupBy(*kept).agg((F.sum(of_part).cast("double") / F.lit(UNIT)).alias("_s"))
    return s.select(*kept, *[(F.lit(q) / F.col("_s")).alias(name) for name, q in (("estimate", m - 1.0), ("low", _gamma_quantile(m, -z)), ("high", _gamma_quantile(m, z)))])


def at_least_twice_the_median(counted: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (group, ..., low, high) that bound a number: those whose number surely is at least twice the median of their
    group, and those whose number has to be known to tell; ``decides`` says which of these are in doubt themselves, the others
    may be the median.

    A median lies between those of the lower and of the upper bounds, and a middle value's interval meets the interval from
    the lesser middle of the lower to the greater middle of the upper bounds.
    """
    middle = counted.groupBy(F.col(group).alias("_group")).agg(
        F.percentile("low", F.lit(0.5)).alias("m_low"), F.percentile("high", F.lit(0.5)).alias("m_high"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY low)").alias("from"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY high DESC)").alias("to"),
    )
    rows = counted.join(middle, F.col(group).eqNullSafe(F.col("_group")))
    sure = rows.where(F.col("low") >= 2 * F.col("m_high")).select(*counted.columns)
    doubt = (F.col("low") < 2 * F.col("m_high")) & (F.col("high") >= 2 * F.col("m_low"))
    in_doubt = rows.where(doubt).select(F.col(group).alias("_open")).distinct()
    needed = rows.join(in_doubt, F.col(group).eqNullSafe(F.col("_open")), "left_semi").where(doubt | ((F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from"))))
    return sure, needed.select(*counted.columns, doubt.alias("decides"))
