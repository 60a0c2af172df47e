"""User-defined aggregates with partial states: updated where rows are, merged after a shuffle of states alone."""

from __future__ import annotations

import pickle
import sys
from abc import ABC, abstractmethod
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Workers get this module with the functions, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: States that a task holds at once; more are sent on and begun anew. Parts in which the states of a key are merged first.
STATES, PARTS = 50_000, 32


class Aggregate(ABC):
    """What a user gives. A state is anything that can be pickled and should stay small; merging must not depend on order, but for rounding."""

    @abstractmethod
    def init(self) -> Any: ...

    @abstractmethod
    def update(self, state: Any, *columns: pa.Array) -> Any:
        """The state with some rows of one key."""

    @abstractmethod
    def merge(self, one: Any, other: Any) -> Any: ...

    @abstractmethod
    def finish(self, state: Any) -> tuple:
        """The values of the result's columns."""


def aggregate_by(rows: DataFrame, key: str, columns: list[str], how: Aggregate, result: str) -> DataFrame:
    """``key`` and the columns of ``result`` (a schema as text), one row per key.

    Tasks update a state for each key and batch, and send on one row for each key. A key's states are merged
    in ``PARTS`` parts, then together, so a key with most of the rows is merged by many tasks. Null is a
    key of its own; what null values mean is the aggregate's. An empty table gives no rows. Other columns are not read.
    """
    kind = rows.schema[key].dataType
    if kind.simpleString() in ("map", "array", "struct"):
        raise ValueError("a key is a plain value")
    chosen = rows.select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)))
    told = T.StructType([T.StructField("key", kind), T.StructField("state", T.BinaryType()), T.StructField("part", T.IntegerType())])

    def update(batches):
        states: dict = {}
        part = TaskContext.get().partitionId() % PARTS  # the same when a task is run again

        def sent(key_type):
            return pa.record_batch([pa.array(list(states), key_type), pa.array([pickle.dumps(s) for s in states.values()], pa.binary()), pa.array([part] * len(states), pa.int32())], ["key", "state", "part"])

        for batch in batches:
            key_type = batch.schema.field("key").type
            codes = batch.column("key").dictionary_encode(null_encoding="encode")
            names = codes.dictionary.to_pylist()
            order = pa.compute.sort_indices(codes.indices)
            batch = batch.take(order)
            runs = pa.compute.run_end_encode(codes.indices.take(order))
            at = 0
            for code, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                name = names[code]
                state = states[name] if name in states else how.init()
                states[name] = how.update(state, *(batch.column(f"c{k}").slice(at, end - at) for k in range(len(columns))))
                at = end
            if len(states) >= STATES:
                yield sent(key_type)
                states.clear()
        if states:
            yield sent(key_type)

    def merged(table: pa.Table) -> Any:
        state = None
        for blob in table.column("state"):
            one = pickle.loads(blob.as_py())
            state = one if state is None else how.merge(state, one)
        return state

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"key": table.column("key").slice(0, 1), "state": pa.array([pickle.dumps(merged(table))], pa.binary())})

    out = T.StructType([T.StructField("key", kind), *T.StructType.fromDDL(result).fields])
    arrow = to_arrow_schema(out)

    def finish(table: pa.Table) -> pa.Table:
        values = how.finish(merged(table))
        return pa.table([table.column("key").slice(0, 1), *(pa.array([v], f.type) for v, f in zip(values, list(arrow)[1:]))], arrow.names)

    partial = chosen.mapInArrow(update, told)
    held = partial.groupBy("key", "part").applyInArrow(merge, T.StructType(told.fields[:2]))
    return held.groupBy("key").applyInArrow(finish, out).withColumnRenamed("key", key)


class Moments(Aggregate):
    """n, mean, variance and skewness (of the values as a population), from central moments that merge without loss of digits. Nulls are left out."""

    def init(self):
        return (0, 0.0, 0.0, 0.0)

    def update(self, state, values):
        x = values.drop_null().to_numpy(zero_copy_only=False).astype(float)
        if not len(x):
            return state
        mean = float(x.mean())
        off = x - mean
        return self.merge(state, (len(x), mean, float((off**2).sum()), float((off**3).sum())))

    def merge(self, one, other):
        (a, mean_a, two_a, three_a), (b, mean_b, two_b, three_b) = one, other
        if not a or not b:
            return one if a else other
        n, gap = a + b, mean_b - mean_a
        two = two_a + two_b + gap**2 * a * b / n
        three = three_a + three_b + gap**3 * a * b * (a - b) / n**2 + 3 * gap * (a * two_b - b * two_a) / n
        return (n, mean_a + gap * b / n, two, three)

    def finish(self, state):
        n, mean, two, three = state
        if not n:
            return (0, None, None, None)
        return (n, mean, two / n, (three / n) / (two / n) ** 1.5 if two > 0 else None)
