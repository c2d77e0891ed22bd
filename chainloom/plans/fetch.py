"""Driver-side plans: how ranges are cut, read ahead and retried."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

#: Bytes that one read of stored files covers, about.
READ_BYTES = 256 << 20
#: A commit of a backfill holds at most so many heights and logs; a block is never split.
COMMIT_HEIGHTS, COMMIT_LOGS = 10_000, 50_000
#: Receipts that one request asks for.
RECEIPTS = 10


@dataclass
class Span:
    """Heights to ask for at once: half of a range that failed, doubled after 20 successes in a row."""

    now: int = 100
    most: int = 100
    good: int = 0

    def failed(self, heights: int) -> int:
        """Notes that a range of so many heights failed, and says how many to ask for instead.

        A range wider than the span was cut before the span shrank, so it says nothing new.
        """
        if heights <= self.now:
            self.now, self.good = max(1, -(-heights // 2)), 0
        return self.now

    def succeeded(self) -> None:
        self.good += 1
        if self.good == 20:
            self.now, self.good = min(self.most, self.now * 2), 0


@dataclass
class Pace:
    """Waits between retries: from 250 ms, doubled to 30 s at most; a success takes an eighth off.

    Requests under way together fail together, so one that was sent before the last doubling does not double again.
    """

    wait: float = 0.0
    first: float = 0.25
    most: float = 30.0
    doubled: float = float("-inf")

    def failed(self, retry_after: float | None = None, sent: float | None = None, now: float = 0.0) -> float:
        if sent is None or sent >= self.doubled:
            self.wait, self.doubled = min(self.most, max(self.first, self.wait * 2)), now
        return min(self.most, max(self.wait, retry_after or 0.0))

    def succeeded(self) -> None:
        self.wait = self.wait * 7 / 8 if self.wait > self.first else 0.0


def retried[T](call: Callable[[], T], pace: Pace, tries: int = 10, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> T:
    """The answer of ``call``, after as many retries as allowed."""
    for k in range(tries + 1):
        sent = clock()
        try:
            out = call()
        except OSError as error:
            if k == tries:
                raise
            sleep(pace.failed(getattr(error, "retry_after", None), sent, clock()))
        else:
            pace.succeeded()
            return out
    raise AssertionError


def halved[T](fetch: Callable[[int, int], list[T]], low: int, high: int) -> list[T]:
    """A range's answer; one that fails is asked again in halves, down to single heights."""
    try:
        return fetch(low, high)
    except OSError:
        if low == high:
            raise
        mid = (low + high) // 2
        return halved(fetch, low, mid) + halved(fetch, mid + 1, high)


def spanned[T](fetch: Callable[[int, int], list[T]], low: int, high: int, span: Span) -> Iterator[tuple[int, int, list[T]]]:
    """(first, last, answer) over a range, in pieces that the span allows; a piece that fails is asked again in smaller ones."""
    while low <= high:
        last = min(high, low + span.now - 1)
        try:
            got = fetch(low, last)
        except OSError:
            if last == low:
                raise
            span.failed(last - low + 1)
            continue
        span.succeeded()
        yield low, last, got
        low = last + 1


def ordered_prefetch[T](jobs: Iterator[Callable[[], T]], ahead: int) -> Iterator[T]:
    """Answers in the order of the jobs, with at most ``ahead`` of them under way; leaving stops the rest."""
    with ThreadPoolExecutor(ahead) as pool:
        waiting: list[Future[T]] = []
        try:
            for job in jobs:
                waiting.append(pool.submit(job))
                if len(waiting) == ahead:
                    yield waiting.pop(0).result()
            while waiting:
                yield waiting.pop(0).result()
        finally:
            for w in waiting:
                w.cancel()


def read_ranges(files: list[tuple[int, int, int]], low: int, high: int, size: int = READ_BYTES) -> list[tuple[int, int]]:
    """Height ranges for reading files (low, high, bytes): overlapping files stay together, up to about ``size`` bytes."""
    out: list[list[int]] = []
    for a, b, n in sorted(f for f in files if f[0] <= high and f[1] >= low):
        if out and (a <= out[-1][1] or out[-1][2] + n <= size):
            out[-1] = [out[-1][0], max(out[-1][1], b), out[-1][2] + n]
        else:
            out.append([a, b, n])
    clipped = [(max(low, a), min(high, b)) for a, b, _ in out]
    return [r for r in clipped if r[0] <= r[1]]


def commit_parts(counts: list[tuple[int, int]], heights: int = COMMIT_HEIGHTS, logs: int = COMMIT_LOGS) -> list[tuple[int, int]]:
    """Ranges of heights for commits from (height, logs) of blocks in order."""
    out: list[tuple[int, int]] = []
    first, held, last = None, 0, None
    for h, n in counts:
        if first is not None and (h - first >= heights or held + n > logs):
            out.append((first, last))
            first, held = None, 0
        first = h if first is None else first
        held, last = held + n, h
    if first is not None:
        out.append((first, last))
    return out


def chunks[T](items: list[T], n: int = RECEIPTS) -> Iterator[list[T]]:
    for i in range(0, len(items), n):
        yield items[i : i + n]


@dataclass
class Limits:
    """When a batch is full: records, bytes, blocks or seconds."""

    records: int = 131_072
    size: int = 256 << 20
    blocks: int = 1_024
    seconds: float = 30.0

    def full(self, records: int, size: int, blocks: int, seconds: float) -> bool:
        return records >= self.records or size >= self.size or blocks >= self.blocks or seconds >= self.seconds
