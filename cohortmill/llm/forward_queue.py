"""Time-forward processing of trees: subtree totals from the leaves to the root, by messages in spilling queues.

Nodes of a fragment come in reverse level order from Spark's external sort. Each takes the messages sent to it from a
priority queue, adds them to its own values and sends the totals on to its parent, which comes later. The queue holds a
bounded number of messages in memory and keeps the others in sorted runs on the executor's scratch disk.
"""

from __future__ import annotations

import heapq
import os
import random
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Messages that a queue holds in memory.
BUDGET = 1 << 15
_RECORD = struct.Struct(">5q")
_READ = 4_096


class SpillingQueue:
    """A priority queue of (level, name1, name2, leaves, gain), least first; never more than `budget` of them in its heap.

    A run's file has no name once it is open, so nothing is left behind when a worker is lost, and its space goes with it.
    """

    def __init__(self, budget: int = BUDGET):
        self.budget, self.heap, self.heads, self.runs = budget, [], [], 0

    def push(self, message: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.budget:
            self._spill()

    def _spill(self) -> None:
        """The later half of the heap becomes a run."""
        self.heap.sort()
        keep = len(self.heap) // 2
        out, self.heap = self.heap[keep:], self.heap[:keep]
        # The scratch folders that Spark names for this executor's own shuffle and spill files.
        scratch = random.choice(os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(","))
        file = tempfile.TemporaryFile(dir=scratch if os.path.isdir(scratch) else None)
        for at in range(0, len(out), _READ):
            file.write(b"".join(_RECORD.pack(*m) for m in out[at:at + _READ]))
        file.seek(0)
        self.runs += 1
        self._advance(self.runs, self._records(file))

    @staticmethod
    def _records(file) -> Iterator[tuple[int, ...]]:
        with file:
            while block := file.read(_RECORD.size * _READ):
                yield from _RECORD.iter_unpack(block)

    def _advance(self, run: int, records: Iterator[tuple[int, ...]]) -> None:
        head = next(records, None)
        if head is not None:
            heapq.heappush(self.heads, (head, run, records))

    def take(self, name: tuple[int, int, int]) -> tuple[int, int]:
        """The sums of the messages to `name`, (level, name1, name2); no message to an earlier one may be left."""
        leaves = gain = 0
        while self.heap and self.heap[0][:3] == name:
            found = heapq.heappop(self.heap)
            leaves, gain = leaves + found[3], gain + found[4]
        while self.heads and self.heads[0][0][:3] == name:
            found, run, records = heapq.heappop(self.heads)
            leaves, gain = leaves + found[3], gain + found[4]
            self._advance(run, records)
        return leaves, gain

    def __bool__(self) -> bool:
        return bool(self.heap or self.heads)


def fragment_totals(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(name1, name2, parent1, parent2, is_top, leaves, gain): each node's values summed over its subtree in its fragment.

    `nodes`: (top1, top2, depth, name1, name2, parent1, parent2, leaves, gain); a fragment is a part of a tree that hangs
    together, named by its topmost node. A fragment is one task's work and memory holds `budget` messages of it.
    """
    def run(batches):
        top, queue = None, SpillingQueue(budget)
        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(9)])
            out = [[], [], [], [], [], [], []]
            for top1, top2, depth, name1, name2, parent1, parent2, leaves, gain in rows:
                if (top1, top2) != top:
                    if queue:
                        raise ValueError("a message was sent to a node that its fragment doesn't hold")
                    top = (top1, top2)
                more = queue.take((-depth, name1, name2))
                leaves, gain = leaves + more[0], gain + more[1]
                is_top = (name1, name2) == top
                if not is_top:
                    queue.push((1 - depth, parent1, parent2, leaves, gain))
                for column, value in zip(out, (name1, name2, parent1, parent2, is_top, leaves, gain)):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=["name1", "name2", "parent1", "parent2", "is_top", "leaves", "gain"])

    names = ["top1", "top2", "depth", "name1", "name2", "parent1", "parent2", "leaves", "gain"]
    # Smallest level first is the deepest first, as in the queue's own order.
    ordered = nodes.select(*names).repartition("top1", "top2").sortWithinPartitions("top1", "top2", F.col("depth").desc(), "name1", "name2")
    return ordered.mapInArrow(run, "name1 long, name2 long, parent1 long, parent2 long, is_top boolean, leaves long, gain long")
