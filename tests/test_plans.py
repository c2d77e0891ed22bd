import pytest
from hypothesis import given
from hypothesis import strategies as st

from chainloom.plans import fetch, route
from chainloom.schema import DATASETS, TableDef

TABLES = DATASETS | {n: TableDef(n, (), kind=k) for n, k in (("dex_swap", "event"), ("dex_burn", "event"), ("dex_fills", "derived"))}


def test_globs():
    assert route.glob("*", "x") and route.glob("a*c*e", "abcde") and route.glob("a.c", "a.c")
    assert not route.glob("a.c", "abc") and not route.glob("ab*", "a") and not route.glob("a*a", "a")


def test_selection_ignores_order():
    assert route.resolve(["!dex_burn", "dex_*", "blocks"], TABLES) == {"blocks", "dex_swap", "dex_fills"}
    assert route.resolve(["contract_events"], TABLES) == {"dex_swap", "dex_burn"}
    for entries, message in ((["nothing*"], "matches no table"), (["reorgs"], "every store"), ([], "no table"), (["!nothing", "blocks"], "matches no table")):
        with pytest.raises(route.RouteError, match=message):
            route.resolve(entries, TABLES)
    with pytest.raises(route.RouteError, match="reserved"):
        route.resolve(["blocks"], TABLES | {"contract_events": TableDef("contract_events", ())})


def test_needs():
    assert route.needed({"a": {"dex_swap"}}, TABLES) == {"logs"}
    assert route.needed({"a": {"dex_fills"}, "b": {"blocks"}}, TABLES) == {"logs", "transactions", "blocks"}
    assert route.fetch_plan({"logs"})["logs_only"]


def test_span_and_pace():
    s = fetch.Span()
    for _ in range(20):
        s.succeeded()
    assert s.now == 100  # never more
    assert s.failed(100) == 50 and s.failed(100) == 50  # a range wider than the span says nothing new
    assert s.failed(25) == 13
    for _ in range(20):
        s.succeeded()
    assert s.now == 26
    assert [s.failed(s.now) for _ in range(6)] == [13, 7, 4, 2, 1, 1]
    p = fetch.Pace()
    assert [p.failed() for _ in range(9)] == [0.25, 0.5, 1, 2, 4, 8, 16, 30, 30]
    assert p.failed(40) == 30
    burst = fetch.Pace()
    assert [burst.failed(None, 1.0, 2.0), burst.failed(None, 1.5, 2.1), burst.failed(None, 2.2, 3.0)] == [0.25, 0.25, 0.5]
    p.succeeded()
    assert p.wait == 26.25


def test_a_span_learns_what_is_served():
    asked = []

    def fetch_range(low, high):
        asked.append(high - low + 1)
        if high - low + 1 > 30:
            raise OSError
        return list(range(low, high + 1))

    span = fetch.Span()
    got = [h for _, _, part in fetch.spanned(fetch_range, 5, 204, span) for h in part]
    assert got == list(range(5, 205))
    assert asked[:3] == [100, 50, 25] and max(asked[3:]) <= 25

    def never(low, high):
        raise OSError

    with pytest.raises(OSError):
        list(fetch.spanned(never, 1, 9, fetch.Span()))


def test_retries_end():
    calls, waits = [], []

    def call():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        fetch.retried(call, fetch.Pace(), 3, waits.append)
    assert (len(calls), waits) == (4, [0.25, 0.5, 1.0])


def test_a_failing_range_is_halved():
    asked = []

    def get(a, b):
        asked.append((a, b))
        if b - a > 2:
            raise OSError
        return list(range(a, b + 1))

    assert fetch.halved(get, 0, 9) == list(range(10))
    assert asked[0] == (0, 9)


def test_prefetch_keeps_order():
    assert list(fetch.ordered_prefetch(iter([lambda i=i: i for i in range(9)]), 3)) == list(range(9))


@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 40), st.integers(1, 60)), max_size=20))
def test_read_ranges_cover_the_files(files):
    files = [(a, a + n, size) for a, n, size in files]
    ranges = fetch.read_ranges(files, 50, 400, 100)
    assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))
    covered = {h for a, b in ranges for h in range(a, b + 1)}
    assert covered >= {h for a, b, _ in files for h in range(max(a, 50), min(b, 400) + 1)}


@given(st.lists(st.integers(0, 70), min_size=1, max_size=60))
def test_commits_split_between_blocks(counts):
    blocks = list(enumerate(counts))
    parts = fetch.commit_parts(blocks, 10, 100)
    assert [h for a, b in parts for h in range(a, b + 1)] == [h for h, _ in blocks]
    for a, b in parts:
        assert b - a < 10
        assert a == b or sum(counts[a : b + 1]) <= 100


def test_a_batch_is_full():
    limits = fetch.Limits()
    assert not limits.full(1, 1, 1, 1)
    assert limits.full(131_072, 1, 1, 1) and limits.full(1, 1, 1_024, 1) and limits.full(1, 1, 1, 31)
