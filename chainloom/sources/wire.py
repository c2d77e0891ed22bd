"""Compact lists of a bulk API: concatenated hashes and length-prefixed binary lists.

Lengths are little-endian 64-bit integers, an option is a byte 0 or 1 before its value, and a string is its length
and its bytes. Numbers inside are 0x strings.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Malformed(ValueError):
    pass


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Malformed("ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def length(self) -> int:
        return int.from_bytes(self.take(8), "little")

    def some(self) -> bool:
        tag = self.take(1)[0]
        if tag > 1:
            raise Malformed("has an option tag that is neither 0 nor 1")
        return tag == 1

    def text(self) -> str:
        try:
            return self.take(self.length()).decode()
        except UnicodeDecodeError:
            raise Malformed("has a string that is not UTF-8") from None

    def hexed(self, size: int) -> str:
        s = self.text()
        if len(s) != 2 + 2 * size or not s.startswith("0x"):
            raise Malformed(f"has {s!r}, which does not parse")
        return s.lower()

    def number(self) -> int:
        return number(self.text())

    def needed(self, name: str) -> int:
        if not self.some():
            raise Malformed(f"has an item with no {name}")
        return self.number()

    def end(self, out):
        if self.at != len(self.data):
            raise Malformed("has bytes past its end")
        return out


def number(text: str) -> int:
    """0x digits, leading zeros allowed."""
    if not text.startswith("0x") or len(text) < 3:
        raise Malformed(f"{text!r} is not 0x hex")
    try:
        n = int(text[2:], 16)
    except ValueError:
        raise Malformed(f"{text!r} is not a quantity") from None
    if n >> 256:
        raise Malformed(f"{text!r} is not a 256-bit quantity")
    return n


def access_list(data: bytes) -> list[dict]:
    """Addresses with their storage keys; either may be left out."""
    r = _Reader(data)
    out = []
    for _ in range(r.length()):
        address = r.hexed(20) if r.some() else None
        keys = [r.hexed(32) for _ in range(r.length())] if r.some() else []
        if address is None:
            raise Malformed("has an item with no address")
        out.append({"address": address, "storageKeys": keys})
    return r.end(out)


def authorization_list(data: bytes) -> list[dict]:
    r = _Reader(data)
    out = []
    for _ in range(r.length()):
        item = {"chainId": hex(r.number()), "address": r.hexed(20), "nonce": hex(r.number())}
        parity = r.number()
        if parity > 255:
            raise Malformed("authorization y_parity is above 255")
        out.append(item | {"yParity": hex(parity), "r": hex(r.number()), "s": hex(r.number())})
    return r.end(out)


def withdrawals(data: bytes) -> list[dict]:
    r = _Reader(data)
    out = []
    for _ in range(r.length()):
        item = {"index": hex(r.needed("index")), "validatorIndex": hex(r.needed("validator_index"))}
        if not r.some():
            raise Malformed("has a withdrawal with no address")
        out.append(item | {"address": r.hexed(20), "amount": hex(r.needed("amount"))})
    return r.end(out)


LISTS = {"access_list": access_list, "authorization_list": authorization_list, "withdrawals": withdrawals}


def list_json(binary: Column, kind: str) -> Column:
    """A binary list as JSON text; null stays null, and a malformed one fails the job."""
    parse = LISTS[kind]

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda b: None if b is None else json.dumps(parse(bytes(b)), separators=(",", ":")))

    return run(binary)


def hashes(joined: Column, size: int = 32) -> Column:
    """0x hex of concatenated hashes as an array of 0x hex; text that does not divide fails."""
    digits = F.regexp_replace(joined, "^0x", "")
    n = (F.length(digits) / (2 * size)).cast("int")
    parts = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("0x"), digits.substr(i * 2 * size + 1, F.lit(2 * size)))))
    return F.when(F.length(digits) % (2 * size) != 0, F.raise_error(F.lit("hashes do not divide")).cast("array<string>")).otherwise(parts)


def padded_quantity(text: Column) -> Column:
    """A quantity without its leading zeros: 0x01 as 0x1, 0x00 as 0x0."""
    return F.concat(F.lit("0x"), F.coalesce(F.nullif(F.ltrim(F.regexp_replace(text, "^0x", ""), F.lit("0")), F.lit("")), F.lit("0")))
