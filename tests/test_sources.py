import json

import pytest
from pyspark.sql import functions as F

from chainloom.sources import blocks, manifest, wire


def _string(s):
    return len(s).to_bytes(8, "little") + s.encode()


def _some(b):
    return b"\1" + b


def test_binary_lists():
    one = (1).to_bytes(8, "little")
    item = _some(_string("0x0a")) + _some(_string("0x1")) + _some(_string("0x" + "ab" * 20)) + _some(_string("0x02"))
    assert wire.withdrawals(one + item) == [{"index": "0xa", "validatorIndex": "0x1", "address": "0x" + "ab" * 20, "amount": "0x2"}]
    auth = _string("0x1") + _string("0x" + "cd" * 20) + _string("0x0") + _string("0x1b") + _string("0x5") + _string("0x6")
    assert wire.authorization_list(one + auth)[0]["yParity"] == "0x1b"
    keys = _some(_string("0x" + "ab" * 20)) + _some((1).to_bytes(8, "little") + _string("0x" + "ef" * 32))
    assert wire.access_list(one + keys) == [{"address": "0x" + "ab" * 20, "storageKeys": ["0x" + "ef" * 32]}]
    for bad in (one + item[:-1], one + item + b"x", one + b"\2", one + b"\0"):
        with pytest.raises(wire.Malformed):
            wire.withdrawals(bad)


def test_lists_and_hashes_in_columns(spark):
    df = spark.createDataFrame([(bytearray((0).to_bytes(8, "little")), "0x" + "ab" * 64), (None, "0x")], "b binary, h string")
    rows = df.select(wire.list_json(F.col("b"), "withdrawals").alias("l"), wire.hashes(F.col("h")).alias("h")).collect()
    assert [(r.l, len(r.h)) for r in rows] == [("[]", 2), (None, 0)]


MANIFEST = """
protocol = "dex"
[[contract]]
name = "Factory"
events = ["PoolCreated(address indexed token, address pool)"]
addresses = { base = ["0xFAfafafafafafafafafafafafafafafafafafafa"] }
indexes = { PoolCreated = [["chain", "pool"]] }
before_lake = ["PoolCreated"]
[[contract]]
name = "Pool"
events = ["Swap(address indexed sender, int256 amount0, string note, uint64[] ids)"]
created_by = [{ contract = "Factory", event = "PoolCreated", param = "pool" }]
"""


def test_a_catalog(spark):
    catalog = manifest.build(manifest.parse(MANIFEST, "base"))
    assert sorted(catalog.tables()) == ["dex_factory_pool_created", "dex_pool_swap"]
    columns = {c: (k, n) for c, k, n in catalog.tables()["dex_pool_swap"].columns}
    assert columns["amount0"] == ("bigint", False)
    assert columns["note"] == ("text", True)
    assert columns["ids"] == ("list:uint", False)
    assert catalog.seeds(spark).first().address == "0x" + "fa" * 20
    assert manifest.build(manifest.parse(MANIFEST, "other")).contracts[0].seeds == []


@pytest.mark.parametrize(
    ("old", "new", "message"),
    [
        ("before_lake", "before_lakes", "unknown keys"),
        ('param = "pool"', 'param = "pools"', "no address"),
        ('event = "PoolCreated", param', 'event = "Nothing", param', "no event"),
        ('[["chain", "pool"]]', '[["chain", "pond"]]', "no columns"),
        ('name = "Pool"', 'name = "Factory"', "declared twice"),
        ("0xFAfafafafafafafafafafafafafafafafafafafa", "0x12", "no addresses"),
    ],
)
def test_what_a_manifest_must_not_say(old, new, message):
    with pytest.raises(manifest.ManifestError, match=message):
        manifest.build(manifest.parse(MANIFEST.replace(old, new), "base"))


def test_manifest_files(tmp_path):
    folder = tmp_path / "a" / "b"
    folder.mkdir(parents=True)
    (folder / "protocol.toml").write_text('protocol = "x"\n[[contract]]\nname = "C"\nabi = "c.json"\n')
    with pytest.raises(manifest.ManifestError, match="no ABI file"):
        manifest.load(str(tmp_path), "base")
    (folder / "c.json").write_text(json.dumps([{"type": "event", "name": "E", "inputs": [{"name": "p", "type": "tuple", "components": [{"name": "a", "type": "uint8"}]}]}, {"type": "function", "name": "f"}]))
    assert next(iter(manifest.load(str(tmp_path), "base").contracts[0].events.values())).signature == "E((uint8))"


def _blocks(path, low, high, salt="a"):
    lines = [{"height": h, "hash": f"{salt}{h}", "parent_hash": f"{salt}{h - 1}", "timestamp": 1_700_000_000 + h, "logs": []} for h in range(low, high + 1)]
    path.write_text("\n".join(map(json.dumps, lines)) + "\n")


def test_block_source(spark, tmp_path):
    _blocks(tmp_path / "000.ndjson", 0, 9)
    _blocks(tmp_path / "010.ndjson", 10, 24)
    blocks.register(spark)
    df = spark.read.format("chain_blocks").option("path", str(tmp_path)).option("from", "3").option("span", "5").load()
    assert df.rdd.getNumPartitions() == 5
    assert [r.height for r in df.orderBy("height").collect()] == list(range(3, 25))
    missing = spark.read.format("chain_blocks").option("path", str(tmp_path)).option("to", "30").load()
    with pytest.raises(Exception, match="no blocks"):
        missing.count()
