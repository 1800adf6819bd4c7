"""Seeded draws of transform methods: one row for each output ordinal, the same in every class.

The random stream does not depend on images, so the plan is a table that joins on the ordinal; results do not depend on
partitions or retries. It has as many rows as the class that needs most. The stream can't be entered in the middle, so
the driver walks it once for its state at every ``BLOCK`` draws, and tasks make the rows from there."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Methods that a random output combines, and draws from one state of the stream.
K, BLOCK = 2, 100_000
SCHEMA = "ordinal long, crop_seed long, methods array<string>, steps array<struct<name:string,values:map<string,double>>>"


class Method(NamedTuple):
    name: str
    ranges: dict[str, tuple[float, float]]
    kernel: Callable | None = None


#: The methods in the order in which they are drawn, and the ranges of their magnitudes.
POOL = [
    Method("Flip", {}),
    Method("Rotate", {"angle": (-25.0, 25.0)}),
    Method("Shear", {"kx": (-0.2, 0.2), "ky": (-0.2, 0.2)}),
    Method("Skew", {"skx": (-0.3, 0.3), "sky": (-0.3, 0.3)}),
    Method("Crop", {"scale": (0.7, 1.0)}),
    Method("Distortion", {"k": (-0.2, 0.2)}),
]
#: Wider ranges for looking at a method: least, most, default and step of each magnitude.
SWEEPS = {
    "Rotate": {"angle": (-180.0, 180.0, 25.0, 1.0)},
    "Skew": {"skx": (-0.4, 0.4, 0.15, 0.01), "sky": (-0.4, 0.4, 0.15, 0.01)},
    "Shear": {"kx": (-0.5, 0.5, 0.2, 0.01), "ky": (-0.5, 0.5, 0.0, 0.01)},
    "Crop": {"scale": (0.1, 1.0, 0.5, 0.01)},
    "Distortion": {"k": (0.0, 0.5, 0.3, 0.01)},
}


def lookup(names: str | list[str] | None, pool: list[Method] | None = None) -> list[Method] | None:
    """Methods by name, whatever the case, in the order given; None or blank draws at random. All unknown names are told."""
    pool = POOL if pool is None else pool
    parts = [x.strip() for x in (names.split(",") if isinstance(names, str) else names or [])]
    parts = [x for x in parts if x]
    known = {m.name.lower(): m for m in pool}
    if unknown := [x for x in parts if x.lower() not in known]:
        raise ValueError(f"unknown methods: {', '.join(unknown)}; there are {', '.join(m.name for m in pool)}")
    return [known[x.lower()] for x in parts] or None


def draws(n: int, seed: int | None = 42, fixed: list[Method] | None = None, pool: list[Method] | None = None, random: np.random.Generator | None = None, first: int = 0) -> Iterator[tuple]:
    """Rows of the plan, from ``first`` on. A negative seed or None is replaced by a fresh one."""
    pool = POOL if pool is None else pool
    if fixed is None and len(pool) < K:
        raise ValueError(f"a pool of {len(pool)} methods is too small for K={K}")
    random = random or np.random.default_rng(secrets.randbits(63) if seed is None or seed < 0 else seed)
    for ordinal in range(first, first + n):
        chosen = fixed or [pool[at] for at in random.choice(len(pool), size=K, replace=False)]
        crop_seed = int(random.integers(0, 2**31 - 1))
        steps = [(m.name, {name: float(random.uniform(lo, hi)) for name, (lo, hi) in m.ranges.items()}) for m in chosen]
        yield ordinal, crop_seed, [m.name for m in chosen], steps


def draw_plan(spark: SparkSession, n: int, seed: int | None = 42, fixed: list[Method] | None = None, pool: list[Method] | None = None, block: int = BLOCK) -> DataFrame:
    # Tasks need no kernels, only names and ranges.
    bare = lambda methods: None if methods is None else [m._replace(kernel=None) for m in methods]
    fixed, pool = bare(fixed), bare(POOL if pool is None else pool)
    random = np.random.default_rng(secrets.randbits(63) if seed is None or seed < 0 else seed)
    states = []
    for first in range(0, n, block):
        states.append((first, min(block, n - first), json.dumps(random.bit_generator.state)))
        if first + block < n:
            for _ in draws(block, None, fixed, pool, random):
                pass
    if not states:
        next(draws(1, seed, fixed, pool))  # a pool that is too small is told all the same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.struct([("name", pa.string()), ("values", pa.map_(pa.string(), pa.float64()))])
        kinds = pa.schema([("ordinal", pa.int64()), ("crop_seed", pa.int64()), ("methods", pa.list_(pa.string())), ("steps", pa.list_(step))])
        for batch in batches:
            for first, size, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                random = np.random.default_rng(0)
                random.bit_generator.state = json.loads(state)
                rows = list(draws(size, None, fixed, pool, random, first))
                for at in range(0, size, 10_000):
                    part = zip(*rows[at : at + 10_000], strict=True)
                    ordinals, seeds, methods, steps = map(list, part)
                    steps = [[{"name": name, "values": list(values.items())} for name, values in row] for row in steps]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind.type) for x, kind in zip((ordinals, seeds, methods, steps), kinds, strict=True)], schema=kinds)

    rows = spark.createDataFrame(states, "first long, size long, state string")
    return rows.repartition(max(1, len(states))).mapInArrow(run, SCHEMA)


def sweep(spark: SparkSession, method: str | None = None, values: str | None = None) -> DataFrame:
    """``method, name, value``: the values of one magnitude, or of all, from its least to its most."""
    wanted = [(m, name, *spec) for m, specs in SWEEPS.items() for name, spec in specs.items() if method in (None, m) and values in (None, name)]
    rows = spark.createDataFrame([(m, name, lo, step, round((hi - lo) / step)) for m, name, lo, hi, _, step in wanted], "method string, name string, least double, step double, n int")
    return rows.select("method", "name", "least", "step", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k")).selectExpr("method", "name", "least + k * step AS value")
