import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainloom.functions import abi, abi_values, prices
from chainloom.functions import words as W
from chainloom.functions.keccak import keccak256, keccak_hex
from chainloom.functions.names import fit_identifier, snake_case, unique


def test_keccak_of_known_signatures():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak_hex("Transfer(address,address,uint256)") == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert keccak_hex("Swap(address,address,int256,int256,uint160,uint128,int24)") == "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67"
    assert len({keccak256(b"a" * n) for n in (135, 136, 137, 300)}) == 4


@pytest.mark.parametrize(("name", "snake"), [("sqrtPriceX96", "sqrt_price_x96"), ("tokenID", "token_id"), ("URLValue", "url_value"), ("__owner", "owner"), ("amount0", "amount0")])
def test_snake_case(name, snake):
    assert snake_case(name) == snake


@given(st.text(min_size=1, max_size=200))
def test_identifiers_fit_and_differ(name):
    fitted = fit_identifier(name)
    assert len(fitted.encode()) <= 63
    assert fit_identifier(name + "x") != fitted


def test_names_that_collide_get_suffixes():
    assert unique(["a", "A", "", "a"]) == ["a", "a_2", "arg2", "a_3"]


def test_words_are_exact(spark):
    rng = random.Random(7)
    values = [0, 1, 10**19 - 1, 10**19, 2**64, 2**127 - 1, 2**128 - 1, 2**255, 2**256 - 1, *(rng.getrandbits(rng.randrange(1, 257)) for _ in range(40))]
    df = spark.createDataFrame([(f"{v:064x}",) for v in values], "h string")
    rows = df.select("h", W.decimal_text(F.col("h")).alias("u"), W.signed_text(F.col("h")).alias("s"), W.signed_text(F.substring("h", 33, 32), 128).alias("s128"), W.decimal_text(F.substring("h", 33, 32), 128).alias("u128")).collect()
    for r in rows:
        n = int(r.h, 16)
        low = n & (2**128 - 1)
        assert r.u == str(n)
        assert r.s == str(n - 2**256 if n >> 255 else n)
        assert r.u128 == str(low)
        assert r.s128 == str(low - 2**128 if low >> 127 else low)


def test_exact_sums_pass_256_bits(spark):
    values = [2**256 - 1, 2**255, 12345, 10**77]
    df = spark.createDataFrame([(str(v),) for v in values], "t string")
    assert df.agg(W.exact_sum(F.col("t")).alias("s")).first().s == str(sum(values))


def test_exact_sums_of_negative_numbers(spark):
    for values in ([-5, 3], [5, -3], [-(2**255), 2**255], [-(2**256) + 1, 10**77, -12, 7], [10**19, -1], [-(10**38), 10**19], [-1], [0]):
        df = spark.createDataFrame([(str(v),) for v in values] + [(None,)], "t string")
        assert df.agg(W.exact_sum(F.col("t")).alias("s")).first().s == str(sum(values))


def test_quantities(spark):
    df = spark.createDataFrame([("0x01",), ("0x0000",), ("0x",), ("12",), ("0xzz",), ("0x" + "f" * 64,), (None,)], "t string")
    assert [r.q for r in df.select(W.quantity(F.col("t")).alias("q")).collect()] == ["1", "0", None, "12", None, str(2**256 - 1), None]


def test_codebook_is_whole():
    book = W.codebook()
    assert len(book) == 256
    assert (book[64], book[128], book[192], book[250], book[255]) == (123, 448, 1228, 9928, 10000)


def _log(e, topics, data):
    return {"topic0": e.topic0, **{f"topic{i + 1}": t for i, t in enumerate(topics)}, "data": data}


def _w(n, bits=256):
    return f"{n % 2**bits:0{bits // 4}x}"


TWO_WAYS = "Mixed(address indexed who, string indexed label, int24 tick, uint128 big, bool yes, bytes4 tag, string text, uint256[] many, (int256,int256)[] pairs)"


def _mixed(e, text=b"hello", tick=-5, yes=1, tag="aabbccdd" + "0" * 56, many=(1, 2**200)):
    head = 7 * 32
    raw = text + b"\0" * (-len(text) % 32)
    tail1 = _w(len(text)) + raw.hex()
    tail2 = _w(len(many)) + "".join(map(_w, many))
    tail3 = _w(1) + _w(-3) + _w(4)
    offsets = [head, head + len(tail1) // 2, head + (len(tail1) + len(tail2)) // 2]
    data = "0x" + _w(tick) + _w(2**127) + _w(yes) + tag + "".join(map(_w, offsets)) + tail1 + tail2 + tail3
    return _log(e, ["0x" + "0" * 24 + "11" * 20, "0x" + "ab" * 32], data)


def _decode(spark, e, logs):
    df = spark.createDataFrame([tuple(x.get(k) for k in ("topic0", "topic1", "topic2", "topic3", "data")) for x in logs], "topic0 string, topic1 string, topic2 string, topic3 string, data string")
    topics = [F.col(f"topic{i}") for i in range(4)]
    columns, problem = abi.decode_columns(e, topics, F.col("data"))
    native = df.select(*[v.alias(f"v_{c}") for c, v in columns.items()], problem.alias("problem")).collect()
    docs = df.select(abi_values.document(e, topics, F.col("data")).alias("d")).select("d.*").collect()
    return native, docs


def test_both_decoders_read_all_kinds(spark):
    e = abi.parse_signature(TWO_WAYS)
    good = _mixed(e)
    bad = [_mixed(e, yes=2), _mixed(e, tick=2**30), _mixed(e, tag="aabbccdd" + "0" * 55 + "1"), good | {"data": good["data"][:-64]}, good | {"topic2": None}, good | {"topic1": "0x" + "1" + "0" * 63}]
    unreadable_text = _mixed(e, text=b"\xff\xfe")
    native, docs = _decode(spark, e, [good, *bad, unreadable_text])
    r = native[0]
    assert r.problem is None
    assert (r.v_who, r.v_tick, r.v_big, r.v_yes, r.v_tag, r.v_text) == ("0x" + "11" * 20, -5, str(2**127), True, "0xaabbccdd", "hello")
    assert r.v_many == ["1", str(2**200)]
    assert [tuple(p) for p in r.v_pairs] == [("-3", "4")]
    assert '"text":"hello"' in docs[0].value
    for n, d, want in zip(native[1:7], docs[1:7], [abi.BOOL, abi.INT, abi.PADDING, abi.SHORT, abi.TOPICS, abi.ADDRESS], strict=True):
        assert n.problem == want
        assert d.error == want
    assert native[7].problem is None and native[7].v_text is None
    assert '"text":null' in docs[7].value


def test_signatures_and_conflicts():
    e = abi.parse_signature(TWO_WAYS)
    assert e.signature == "Mixed(address,string,int24,uint128,bool,bytes4,string,uint256[],(int256,int256)[])"
    assert e.topics == 3
    same = abi.parse_signature("T(address indexed a, uint b)")
    assert len(abi.merge([same, abi.parse_signature("T(address indexed a, uint256 b)")])) == 1
    with pytest.raises(ValueError, match="two definitions"):
        abi.merge([same, abi.parse_signature("T(address indexed c, uint256 b)")])
    with pytest.raises(ValueError, match="width"):
        abi.parse_signature("T(uint7 a)")


def _update(feed, price, exponent, spread, micros, cut=0):
    body = feed.to_bytes(4, "big") + bytes([4, 0]) + price.to_bytes(8, "big", signed=True) + bytes([4]) + exponent.to_bytes(2, "big", signed=True) + bytes([5]) + spread.to_bytes(8, "big") + bytes([12, 1]) + micros.to_bytes(8, "big")
    payload = prices.PAYLOAD_MAGIC + bytes(8) + b"\1\1" + body
    return prices.UPDATE_MAGIC + bytes(65) + len(payload).to_bytes(2, "big") + payload[: len(payload) - cut]


def test_signed_updates():
    two = (2).to_bytes(32, "big")
    new = _update(2, 123456, -3, 7, 5_000_000)
    assert prices.stored(two, b"xx" + new + b"yyy") == (123456 * 10**5, 57, 5000)
    assert prices.stored(two, _update(2, 1, -3, 7, 4_000_000) + new) == (123456 * 10**5, 57, 5000)
    assert prices.stored(two, _update(2, 123456, -3, 7, 5_000_000, cut=1)) is None
    assert prices.stored(two, b"") is None
    assert prices.stored(two, _update(3, 1, 0, 0, 9_000)) is None
    assert prices.stored(two, _update(2, 5, 57, 0, 9_000)) is None


def test_reports():
    stream = bytes.fromhex("0003") + bytes(29) + b"\7"
    words = [1, 1_700_000_000, 1, 1, 2, 10**12, 10**12 - 5, 10**12 + 10**7]
    report = stream + b"".join(w.to_bytes(32, "big") for w in words)
    assert prices.stored(stream, b"\1" * 61 + report) == (100, 10, 1_700_000_000_000)
    assert prices.stored(stream, report[:-1]) is None
    assert prices.stored(bytes.fromhex("0005") + stream[2:], report) is None
