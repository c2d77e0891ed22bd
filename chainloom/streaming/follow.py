"""Following a source's heads: backfill of buried heights, catching up, forks, and a stop that loses nothing.

Blocks are read by ``chain_blocks``, so executors fetch them, one task for each range; the driver holds heads and
headers only, a window of them at most. What is applied goes through ``runner.Pipeline``, whose ring decides.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators.chain import Deep
from chainloom.plans.fetch import Limits
from chainloom.sources.blocks import open_store
from chainloom.sources.node import Inconsistent
from chainloom.streaming.runner import Pipeline

#: Seconds without a head after which the source is asked for one.
QUIET = 30.0
#: Seconds before a head is asked about again: the first wait, doubled up to the longest.
FIRST_WAIT, LONGEST_WAIT = 0.1, 2.0
#: Seconds that a commit under way has to end once a stop was asked for.
FLUSH = 15.0


class Unstable(Inconsistent):
    """The source no longer serves the branch that it announced."""


@dataclass(frozen=True)
class Head:
    height: int
    hash: str


class Follower:
    """Keeps a pipeline at the heads of the source that ``options`` describe (those of ``chain_blocks``)."""

    def __init__(self, spark: SparkSession, pipeline: Pipeline, options: dict[str, str], start: int = 0, limits: Limits | None = None):
        self.spark, self.pipeline, self.options, self.start = spark, pipeline, options, start
        self.source, self.limits = open_store(options), limits or Limits()
        self.heads: queue.Queue[Head] = queue.Queue(self.limits.blocks)
        self.stopping, self.thread, self.failure = threading.Event(), None, None

    # Reading

    def frame(self, low: int, high: int) -> DataFrame:
        return self.spark.read.format("chain_blocks").options(**self.options).option("from", low).option("to", high).load()

    def pieces(self, low: int, high: int) -> Iterator[tuple[int, int, DataFrame]]:
        """(first, last, blocks) of a range, cut where a commit is full; a block is never split."""
        for a in range(low, high + 1, self.limits.blocks):
            b = min(high, a + self.limits.blocks - 1)
            blocks = self.frame(a, b).persist()
            try:
                logs = F.coalesce(F.json_array_length(F.get_json_object("json", "$.logs")), F.lit(0))
                sizes = sorted(blocks.select("height", logs.alias("n"), F.length("json").alias("size")).collect())  # a commit's blocks at most
                first, records, size = a, 0, 0
                for h, n, s in sizes:
                    records, size = records + n, size + s
                    if self.limits.full(records, size, h - first + 1, 0.0) or h == b:
                        yield first, h, blocks.where(F.col("height").between(first, h))
                        first, records, size = h + 1, 0, 0
            finally:
                blocks.unpersist()

    def apply(self, blocks: DataFrame) -> None:
        try:
            self.pipeline.apply(blocks.orderBy("height"))
        except Deep:
            raise
        except ValueError as error:
            raise Unstable(str(error)) from error

    # Buried heights

    def backfill(self, finality: int, stop: int | None = None) -> int:
        """Applies every height that is ``finality`` below the head, or up to ``stop``; the head is asked for again until it is reached.

        Returns the next height.
        """
        while True:
            at = self.start if self.pipeline.ring.tip is None else self.pipeline.ring.tip + 1
            bound = self.source.head() - finality
            bound = bound if stop is None else min(bound, stop)
            if at > bound or self.stopping.is_set():
                return at
            for _, _, blocks in self.pieces(at, bound):
                self.apply(blocks)
                if self.stopping.is_set():
                    break

    # Heads

    def sample(self) -> Head:
        found = self.source.header(self.source.head())
        return Head(found["height"], found["hash"])

    def process(self, head: Head) -> None:
        """Brings the pipeline to a head: known, ahead, below the window, or a fork."""
        ring = self.pipeline.ring
        if (head.height, head.hash) in ring.blocks:
            return
        if ring.tip is None:
            at = min(self.start, head.height)
            for _, _, blocks in self.pieces(at, head.height):
                self.apply(blocks)
        elif head.height > ring.tip:
            self.catch_up(head)
        elif not self.behind(head):
            self.fork(head)

    def catch_up(self, head: Head) -> None:
        """Heights above the tip up to the head, each linked to the one before; a tip that was replaced makes it a fork."""
        ring = self.pipeline.ring
        tip = ring.blocks[-1]
        if self.source.header(tip[0] + 1)["parent_hash"] != tip[1]:
            return self.fork(head)
        for _, _, blocks in self.pieces(tip[0] + 1, head.height):
            self.apply(blocks)
        if (head.height, head.hash) not in self.pipeline.ring.blocks:
            raise Unstable(f"block {head.height} is no longer {head.hash}")
        return None

    def behind(self, head: Head) -> bool:
        """Whether a head below the window is an ancestor of its oldest block: the source is behind then, nothing forked."""
        ring = self.pipeline.ring
        low, oldest = ring.blocks[0]
        if head.height >= low or low - head.height > ring.window:
            return False
        ledger = self.pipeline.store.read("accepted_blocks").where((F.col("height") == low) & (F.col("hash") == oldest))
        wanted = ledger.first()["parent_hash"]
        for h in range(low - 1, head.height - 1, -1):
            found = self.source.header(h)
            if found["hash"] != wanted:
                return False
            wanted = found["parent_hash"]
            if h == head.height:
                return found["hash"] == head.hash
        return False

    def fork(self, head: Head) -> None:
        """Replaces accepted blocks by the head's branch, from the newest block that both have."""
        if self.source.header(head.height)["hash"] != head.hash:
            raise Unstable(f"block {head.height} is no longer {head.hash}")
        ring = self.pipeline.ring
        held = dict(ring.blocks)
        low, h, top = ring.blocks[0][0], min(head.height, ring.tip + 1), None
        while h >= low:
            found = self.source.header(h)
            if top is not None and found["hash"] != top:
                raise Unstable(f"block {h} changed under the walk")
            if held.get(h) == found["hash"]:
                break
            h, top = h - 1, found["parent_hash"]
        # without history below it, the first accepted block itself may be replaced
        if h < low and (ring.history or head.height < low):
            raise Deep(f"the branch of {head.height} parts below the undo window")
        self.apply(self.frame(h + 1, head.height))

    # The loop

    def announce(self, head: Head) -> None:
        """A head from a subscription; waits while the queue is full."""
        self.heads.put(head)

    def _newest(self, wait: float) -> Head | None:
        """The newest head that is waiting, which covers the older ones."""
        try:
            head = self.heads.get(timeout=wait)
            while True:
                try:
                    head = self.heads.get_nowait()
                except queue.Empty:
                    return head
        except queue.Empty:
            return None

    def run(self) -> None:
        """Follows heads until a stop. A head that the source does not serve is asked about again, sooner than the next comes."""
        again, wait, quiet = None, FIRST_WAIT, 0.0
        while not self.stopping.is_set():
            step = min(wait, LONGEST_WAIT) if again else 0.2
            head = self._newest(step)
            quiet = 0.0 if head else quiet + step
            try:
                if head is None and again is None:
                    if quiet < QUIET:
                        continue
                    head, quiet = self.sample(), 0.0
                attempted = head or again
                self.process(attempted)
                again, wait = None, FIRST_WAIT
            except (Inconsistent, OSError):
                wait = FIRST_WAIT if head else min(LONGEST_WAIT, wait * 2)
                again = head or again

    def begin(self) -> None:
        """Runs in a thread of its own."""

        def guarded() -> None:
            try:
                self.run()
            except Exception as error:  # the caller gets it at the stop
                self.failure = error

        self.thread = threading.Thread(target=guarded, daemon=True)
        self.thread.start()

    def stop(self, flush: float = FLUSH) -> None:
        """No new commit begins; the one under way has ``flush`` seconds to end. A cut one is repaired at the next start."""
        self.stopping.set()
        if self.thread is not None:
            self.thread.join(flush)
            if self.thread.is_alive():
                raise TimeoutError(f"a commit took more than {flush} seconds")
        if self.failure is not None:
            raise self.failure
