"""256-bit words as lower-case hex columns, without Python on the executors.

Integers beyond 64 bits leave as decimal text. They are computed in base 10^19 from 32-bit limbs:
every product and sum fits a 38-digit decimal, so results are exact to 256 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE = 10**19
_HEX, _FLIPPED = "0123456789abcdef", "fedcba9876543210"


def word(data: Column, index: int | Column) -> Column:
    """Word ``index`` of hex ``data`` that has no 0x."""
    if isinstance(index, int):
        return F.substring(data, 64 * index + 1, 64)
    return data.substr((index * 64 + 1).cast("int"), F.lit(64))


def strip(data: Column) -> Column:
    """Hex without its 0x, in lower case."""
    return F.lower(F.regexp_replace(data, "^0[xX]", ""))


def field(hexed: Column, low: int, length: int, size: int = 256) -> Column:
    """``length`` bits from bit ``low`` of a hex word, as hex; both are multiples of four."""
    if low % 4 or length % 4:
        raise ValueError("a hex field starts and ends at a digit")
    return F.substring(hexed, (size - low - length) // 4 + 1, length // 4)


def small(hexed: Column) -> Column:
    """Hex of at most 15 digits as a long; empty text is null."""
    return F.conv(F.nullif(hexed, F.lit("")), 16, 10).cast("long")


def signed_small(hexed: Column, bits: int) -> Column:
    """Two's complement of ``bits`` (at most 56) as a long."""
    value = small(hexed)
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def u64(hexed: Column) -> Column:
    """Hex of at most 16 digits as decimal(20, 0)."""
    return F.conv(F.nullif(hexed, F.lit("")), 16, 10).cast("decimal(20,0)")


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums(hexed: Column, bits: int) -> Column:
    """The number's parts in base 10^19, lowest first, before carrying.

    Each part is the sum over 32-bit limbs of limb times the limb's weight in that place.
    """
    n = bits // 32
    places = next(p for p in range(1, 9) if _BASE**p >= 1 << bits)
    weights = F.array(*[F.array(*[F.lit(str((1 << (32 * i)) // _BASE**j % _BASE)).cast("decimal(20,0)") for i in range(n)]) for j in range(places)])
    pieces = once(F.lpad(hexed, 8 * n, "0"), lambda h: F.array(*[F.substring(h, 8 * (n - i) - 7, 8) for i in range(n)]))
    limbs = F.transform(pieces, lambda p: F.conv(p, 16, 10).cast("decimal(10,0)"))

    def part(held: Column) -> Column:
        times = lambda row: F.zip_with(held, row, lambda a, b: (a * b).cast("decimal(38,0)"))
        return F.transform(weights, lambda row: F.aggregate(times(row), F.lit(0).cast("decimal(38,0)"), lambda x, y: (x + y).cast("decimal(38,0)")))

    return once(limbs, part)


def _carried(sums: Column, plus: Column | None = None) -> Column:
    """Decimal text of an array of sums in base 10^19; ``plus`` is added to the lowest."""
    base = F.lit(str(_BASE)).cast("decimal(20,0)")
    first = F.lit(0).cast("decimal(38,0)") if plus is None else plus.cast("decimal(38,0)")

    def step(acc: Column, s: Column) -> Column:
        now = (s + acc["carry"]).cast("decimal(38,0)")
        low = F.pmod(now, base).cast("decimal(20,0)")
        return F.struct(F.call_function("div", (now - low).cast("decimal(38,0)"), base).cast("decimal(38,0)").alias("carry"), F.concat(F.lpad(low.cast("string"), 19, "0"), acc["text"]).alias("text"))

    start = F.struct(first.alias("carry"), F.lit("").alias("text"))
    text = F.aggregate(sums, start, step, lambda acc: F.concat(acc["carry"].cast("string"), acc["text"]))
    return F.regexp_replace(text, "^0+(?=.)", "")


def _two_limbs(hexed: Column, plus: Column | None = None) -> Column:
    """Hex of 30 digits as decimal text, in one 38-digit multiplication; ``plus`` is added."""
    high, low = F.conv(F.substring(hexed, 1, 14), 16, 10).cast("decimal(17,0)"), F.conv(F.substring(hexed, 15, 16), 16, 10).cast("decimal(20,0)")
    value = high * F.lit(str(1 << 64)).cast("decimal(20,0)") + low
    return (value if plus is None else value + plus.cast("decimal(1,0)")).cast("decimal(38,0)").cast("string")


def decimal_text(hexed: Column, bits: int = 256) -> Column:
    """Unsigned hex of at most ``bits`` (a multiple of 32) as decimal text; what fits 64 or 120 bits is read at once."""
    rest, top = max(0, bits // 4 - 16), max(0, bits // 4 - 30)

    def read(h: Column) -> Column:
        short = F.when(F.substring(h, 1, rest) == "0" * rest, F.conv(F.substring(h, rest + 1, 16), 16, 10))
        if top:
            short = short.when(F.substring(h, 1, top) == "0" * top, _two_limbs(F.substring(h, top + 1, 30)))
        return short.otherwise(_carried(_sums(h, bits)))

    return once(F.lpad(hexed, bits // 4, "0"), read)


def signed_text(hexed: Column, bits: int = 256) -> Column:
    """Two's complement hex of exactly ``bits`` (a multiple of 32) as decimal text; what fits 64 or 120 bits is read at once."""
    rest, top = max(0, bits // 4 - 16), max(0, bits // 4 - 30)

    def read(h: Column) -> Column:
        negative = F.substring(h, 1, 1) >= "8"
        one = F.when(negative, 1).otherwise(0)
        fits = F.substring(h, 1, rest) == F.when(F.substring(h, rest + 1, 1) >= "8", "f" * rest).otherwise("0" * rest)

        def magnitude(m: Column) -> Column:
            text = _carried(_sums(m, bits), one)
            if top:
                text = F.when(F.substring(m, 1, top) == "0" * top, _two_limbs(F.substring(m, top + 1, 30), one)).otherwise(text)
            return F.concat(F.when(negative, "-").otherwise(""), text)

        flipped = F.when(negative, F.translate(h, _HEX, _FLIPPED)).otherwise(h)
        return F.when(fits, F.conv(F.substring(h, rest + 1, 16), 16, -10)).otherwise(once(flipped, magnitude))

    return once(hexed, read)


def exact_sum(text: Column) -> Column:
    """Sum over a group of decimal texts of at most 78 digits, negative ones included, as decimal text."""
    negative = text.startswith("-")
    padded = F.lpad(F.when(negative, F.substring(text, 2, 78)).otherwise(text), 95, "0")
    signed = [F.substring(padded, 95 - 19 * (j + 1) + 1, 19).cast("decimal(19,0)") for j in range(5)]
    parts = F.array(*[F.sum(F.when(negative, -s).otherwise(s)).cast("decimal(38,0)") for s in signed])
    # parts of a negative total borrow from the next, and the last borrow is what stays negative
    base = F.lit(str(_BASE)).cast("decimal(20,0)")
    top = lambda s: F.aggregate(s, F.lit(0).cast("decimal(38,0)"), lambda c, x: F.call_function("div", (x + c - F.pmod(x + c, base)).cast("decimal(38,0)"), base).cast("decimal(38,0)"))
    turned = lambda s: F.transform(s, lambda x: (-x).cast("decimal(38,0)"))
    return once(parts, lambda s: F.when(top(s) < 0, F.concat(F.lit("-"), _carried(turned(s)))).otherwise(_carried(s)))


def quantity(text: Column) -> Column:
    """A 0x quantity, leading zeros allowed, or a decimal number, as decimal text; else null."""
    digits = F.regexp_extract(text, r"^0[xX]0*([0-9a-fA-F]{1,64})$", 1)
    plain = F.regexp_extract(text, r"^0*([0-9]+)$", 1)
    return F.when(digits != "", decimal_text(F.lower(digits))).when(plain != "", plain)


def to_quantity(number: Column) -> Column:
    """A non-negative long as a 0x quantity without leading zeros."""
    return F.concat(F.lit("0x"), F.lower(F.hex(number.cast("long"))))


def to_hex(binary: Column) -> Column:
    """Bytes as lower-case 0x hex."""
    return F.concat(F.lit("0x"), F.lower(F.hex(binary)))


def address_slot(hexed: Column) -> Column:
    """The address in a word whose high twelve bytes are zero; else null."""
    return F.when((F.length(hexed) == 64) & (F.substring(hexed, 1, 24) == "0" * 24), F.concat(F.lit("0x"), F.substring(hexed, 25, 40)))


def pseudo_float(hexed: Column) -> Column:
    """A 32-bit price: a 27-bit mantissa shifted left by a 5-bit exponent."""
    packed = small(hexed)
    shift = F.shiftrightunsigned(packed, 27).cast("int")
    return F.call_function("shiftleft", packed.bitwiseAND(F.lit((1 << 27) - 1).cast("long")), shift)


#: The codebook of spreads in millionths. It has 256 entries, so it is stated by its rule: first value, step and
#: number of entries of each stretch, in order of index.
SPREADS = (
    (0, 1, 10),
    (12, 2, 54),
    (123, 5, 64),
    (448, 10, 64),
    (1228, 150, 59),
    (10_000, 0, 5),
)


def codebook() -> list[int]:
    """Spreads in millionths by their index."""
    return [first + step * k for first, step, entries in SPREADS for k in range(entries)]


def spread(index: Column, book: list[int] | None = None) -> Column:
    """The spread of an index, by the codebook or by another one."""
    return F.element_at(F.array(*[F.lit(v) for v in book or codebook()]), (index + 1).cast("int"))
