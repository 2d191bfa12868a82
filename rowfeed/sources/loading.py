"""Row groups read by the process that trains: Spark plans (manifest, pruning, shards), each process reads its own row groups.

A plan is small and can be pickled: a line for each row group of the shard, the columns, and which rows to keep. Its threads read and decode row
groups ahead, in the order of the epoch, as long as what they hold and are about to hold is within a budget of bytes; so memory is bounded
by the budget, or by one row group where that is larger.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any, TypeVar

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle

from rowfeed.operators.batching import exact_tables, shuffled_batches, to_batches
from rowfeed.schema import Schema
from rowfeed.sources.decoding import decoded_table
from rowfeed.sources.rowgroups import GroupReader

X = TypeVar("X")
AHEAD_BYTES, THREADS = 256 << 20, 4


def reachable(url: str) -> bool:
    """Whether Arrow has a file system for the URL, here; one with a scheme."""
    if url.startswith("file:"):
        return True
    try:
        pafs.FileSystem.from_uri(url)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


@dataclass(frozen=True)
class ReadPlan:
    """reader: how a row group is read. groups: rg, path, group, bytes, and the partitions' values, a row each. seed, shuffle_rows: as of the scan."""

    reader: GroupReader
    groups: pa.Table
    seed: int | None = None
    shuffle_rows: bool = False

    def __len__(self) -> int:
        return self.groups.num_rows

    def dumps(self) -> bytes:
        """For another process, with the functions of its predicates."""
        return cloudpickle.dumps(self)

    def order(self, epoch: int) -> list[int]:
        """Rows of `groups` in the order of the epoch: as they are, or by the hash of seed, epoch and number."""
        numbers = self.groups["rg"].to_pylist()
        if self.seed is None:
            return list(range(len(numbers)))
        return sorted(range(len(numbers)), key=lambda i: (hashlib.md5(f"{self.seed}:{epoch}:{numbers[i]}".encode()).hexdigest(), numbers[i]))

    def _ahead(self, make: Callable[[pa.Table], X], size_of: Callable[[X], int], epoch: int, ahead_bytes: int, threads: int) -> Iterator[X]:
        """What `make` makes of each row group's rows, in order, made ahead by threads within the budget."""
        reader = replace(self.reader, shuffle=f"{self.seed}:{epoch}" if self.shuffle_rows and self.seed is not None else None)
        columns = [c.combine_chunks() for c in self.groups.columns]
        parts = {n: columns[4 + k] for k, n in enumerate(reader.parts)}

        def load(i: int) -> X | None:
            table, at, _ = reader.read(columns[0][i].as_py(), columns[1][i].as_py(), columns[2][i].as_py(), {n: v.slice(i, 1) for n, v in parts.items()})
            return make(table) if len(at) else None

        sizes, factor, held = columns[3].to_pylist(), 1.0, 0.0
        waiting: deque[tuple[int, Future]] = deque()
        with ThreadPoolExecutor(threads) as pool:
            try:
                for i in self.order(epoch):
                    # What is read but not yet given counts as it is expected to be: bytes before compression, by the largest growth seen.
                    while waiting and (len(waiting) > 2 * threads or held + sizes[i] * factor > ahead_bytes):
                        j, future = waiting.popleft()
                        out = future.result()
                        if out is not None:
                            factor = max(factor, size_of(out) / max(1, sizes[j]))
                            yield out
                        held = sum(sizes[k] for k, _ in waiting) * factor
                    waiting.append((i, pool.submit(load, i)))
                    held += sizes[i] * factor
                while waiting:
                    out = waiting.popleft()[1].result()
                    if out is not None:
                        yield out
            finally:
                for _, future in waiting:
                    future.cancel()

    def tables(self, epoch: int = 0, ahead_bytes: int = AHEAD_BYTES, threads: int = THREADS) -> Iterator[pa.Table]:
        """A table for each row group."""
        yield from self._ahead(lambda t: t, lambda t: t.nbytes, epoch, ahead_bytes, threads)

    def batches(self, size: int, num_epochs: int | None = 1, keep_partial: bool = True, shuffle_capacity: int = 0, ahead_bytes: int = AHEAD_BYTES, threads: int = THREADS) -> Iterator[dict[str, np.ndarray]]:
        """Batches as numpy columns of types that torch takes, epoch after epoch (None: without end), drawn from a shuffle buffer if it has a capacity."""
        epoch = 0
        while num_epochs is None or epoch < num_epochs:
            found = to_batches(exact_tables(self.tables(epoch, ahead_bytes, threads), size, keep_partial))
            yield from shuffled_batches(found, size, shuffle_capacity, None if self.seed is None else self.seed + epoch) if shuffle_capacity else found
            epoch += 1

    def rows(self, schema: Schema, epoch: int = 0, ahead_bytes: int = AHEAD_BYTES, threads: int = THREADS) -> Iterator[dict[str, Any]]:
        """Rows as dicts of numpy and Python values, decoded by the threads."""
        for rows in self._ahead(lambda t: decoded_table(t, schema), bytes_of, epoch, ahead_bytes, threads):
            names, columns = rows
            for row in zip(*columns, strict=True):
                yield dict(zip(names, row, strict=True))


def bytes_of(decoded: tuple[list[str], list[list[Any]]]) -> int:
    """About the bytes of decoded columns: of arrays what they hold, of other values a few words."""
    return sum(sum(v.nbytes if isinstance(v, np.ndarray) else 64 for v in column) for column in decoded[1])
