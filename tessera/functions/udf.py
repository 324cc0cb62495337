"""User functions: vectorised scalars, asynchronous scalars, aggregates, window and table functions."""

from __future__ import annotations

import asyncio
import functools
import hashlib
import pickle
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scalar(returns: str, function: Callable[..., pd.Series], volatile: bool = False):
    """A vectorised scalar function; a volatile one is not folded or moved."""
    made = F.pandas_udf(function, returns)
    return made.asNondeterministic() if volatile else made


def asynchronous(returns: str, function: Callable[[object], Awaitable[object]], at_once: int = 32):
    """A scalar function that waits (for a service, say): ``at_once`` calls of a batch are in flight together."""

    async def batch(values: pd.Series) -> list:
        gate = asyncio.Semaphore(at_once)

        async def one(v):
            async with gate:
                return await function(v)

        return await asyncio.gather(*(one(v) for v in values))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(asyncio.run(batch(values)), index=values.index)

    return F.pandas_udf(run, returns)


def aggregate(returns: str, function: Callable[[pd.Series], object]):
    """An aggregate over a group's values, also over whole-partition windows."""

    def run(values: pd.Series) -> float:
        return function(values)

    run.__annotations__ = {"values": pd.Series, "return": float}
    return F.pandas_udf(run, returns)


class Merging:
    """A user aggregate with a state: subclasses say how it starts, takes values, merges and ends.

    States are pickled on their way between tasks; ``merge`` may come in any order.
    """

    def zero(self):
        raise NotImplementedError

    def update(self, state, values: pd.DataFrame):
        """The state after a group's values of one batch, one column to an argument."""
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def evaluate(self, state):
        raise NotImplementedError


#: Groups that a task holds states of before it hands them on.
_STATES = 50_000


def merged(df: DataFrame, keys: list[str], arguments: list[str], made: Merging, name: str, returns: str) -> DataFrame:
    """``keys`` and the aggregate: each task updates one state to a group, and only states are shuffled.

    A group of any size reaches its merging task as a state to each task that met it.
    """
    kinds = dict(df.dtypes)
    listed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, object] = {}

        def hand_on():
            rows = [(*(None if v is _NULL else v for v in k), pickle.dumps(s)) for k, s in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "state"])

        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]:
                key = tuple(_NULL if v is None or v != v else v for v in key)
                held[key] = made.update(held[key] if key in held else made.zero(), rows[arguments])
            if len(held) > _STATES:
                yield hand_on()
        if held:
            yield hand_on()

    def final(group: pd.DataFrame) -> pd.DataFrame:
        state = functools.reduce(made.merge, map(pickle.loads, group["state"]))
        return pd.DataFrame([(*(group[k].iloc[0] for k in keys), made.evaluate(state))], columns=[*keys, name])

    states = df.select(*keys, *(a for a in arguments if a not in keys)).mapInPandas(partial, f"{listed + ', ' if keys else ''}state binary")
    return states.groupBy(*keys).applyInPandas(final, f"{listed + ', ' if keys else ''}`{name}` {returns}")


_NULL = "\0null"


def digest_function():
    """blake2b, blake2s (and blake3 where its module is there) of binary values."""

    def run(values: pd.Series, names: pd.Series) -> pd.Series:
        def one(v, n):
            if v is None:
                return None
            if n == "blake3":
                import blake3

                return blake3.blake3(v).digest()
            return hashlib.new(n, v).digest()

        return pd.Series([one(v, n) for v, n in zip(values, names)])

    return F.pandas_udf(run, "binary")
