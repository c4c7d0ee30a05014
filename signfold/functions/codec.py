"""Column functions for label keys and binary fingerprints.

Keys and fingerprints of up to 64 bits are BIGINT bit patterns: the first bit is the most significant, so the
big-endian bytes of the number are the packed bits. Equality, xor and popcount do not mind the sign; ordering and
division do, so label spaces stay below 2**63.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = (1 << 32) - 1


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _zero() -> Column:
    return F.lit(0).cast("bigint")


# --- label keys ------------------------------------------------------------------------------------


def fits_key(base: Column, digits: Column) -> Column:
    """Whether numbers of so many digits of a base are all below 2**63, as check_capacity() has it."""
    return F.pow(base.cast("double"), digits) <= F.lit(float(1 << 63))


def check_capacity(base: int, digits: int) -> int:
    """Number of keys of so many base-`base` digits; an error unless all are nonnegative BIGINTs."""
    if base < 1 or digits < 0:
        raise ValueError("base must be positive and digits nonnegative")
    if (size := base**digits) > 1 << 63:
        raise OverflowError(f"{digits} digits of base {base} do not fit a signed 64-bit key")
    return size


def key_to_bytes(x: Column | str) -> Column:
    """The 8 big-endian bytes as ARRAY<BIGINT>."""
    x = _col(x)
    return F.array(*[F.shiftrightunsigned(x, 56 - 8 * i).bitwiseAND(F.lit(255)).cast("bigint") for i in range(8)])


def key_to_binary(x: Column | str) -> Column:
    """The 8 big-endian bytes as BINARY."""
    return F.unhex(F.lpad(F.hex(_col(x)), 16, "0"))


def bytes_to_key(x: Column | str) -> Column:
    """Inverse of key_to_bytes."""
    return F.aggregate(_col(x), _zero(), lambda acc, b: F.shiftleft(acc, 8).bitwiseOR(b.cast("bigint")))


def key_to_digits(x: Column | str, base: int, digits: int) -> Column:
    """Base-`base` digits, the most significant first."""
    check_capacity(base, digits)
    x = _col(x)
    out = []
    for i in range(digits):
        p = base ** (digits - 1 - i)
        out.append(F.call_function("div", x, F.lit(p).cast("bigint")) % F.lit(base))
    return F.array(*out)


def digits_to_key(x: Column | str, base: int) -> Column:
    """Inverse of key_to_digits."""
    return F.aggregate(_col(x), _zero(), lambda acc, d: acc * F.lit(base).cast("bigint") + d)


def key_to_mosaic(x: Column | str, base: int, height: int, width: int) -> Column:
    """The grid of cell ids, an array of rows."""
    flat = key_to_digits(x, base, height * width)
    return F.array(*[F.slice(flat, 1 + r * width, width) for r in range(height)])


def mosaic_to_key(x: Column | str, base: int) -> Column:
    return digits_to_key(F.flatten(_col(x)), base)


def has_repeats(x: Column | str) -> Column:
    """Whether any value occurs twice in the array."""
    x = _col(x)
    return F.size(F.array_distinct(x)) < F.size(x)


# --- fingerprints ----------------------------------------------------------------------------------


def binarize(logits: Column | str) -> Column:
    """ARRAY<BOOLEAN>: 0 < logit, strictly, so 0 gives 0."""
    return F.transform(_col(logits), lambda x: x > 0)


def pack(logits: Column | str, bits: int = 64, offset: int = 0) -> Column:
    """Fingerprint of `bits` logits from `offset` on as one BIGINT."""
    if not 0 < bits <= 64:
        raise ValueError("a word holds 1 to 64 bits")
    part = F.slice(_col(logits), offset + 1, bits)
    return F.aggregate(part, _zero(), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def pack_words(logits: Column | str, bits: int) -> Column:
    """Fingerprint of any number of bits as ARRAY<BIGINT>, 64 bits a word."""
    return F.array(*[pack(logits, min(64, bits - at), at) for at in range(0, bits, 64)])


def bit(fp: Column | str, index: int | Column, bits: int = 64) -> Column:
    """Bit `index`, the first being the most significant of `bits`."""
    fp = _col(fp)
    if isinstance(index, int):
        return F.shiftrightunsigned(fp, bits - 1 - index).bitwiseAND(F.lit(1)).cast("int")
    return F.call_function("shiftrightunsigned", fp, (F.lit(bits - 1) - index).cast("int")).bitwiseAND(F.lit(1)).cast("int")


def unpack(fp: Column | str, bits: int = 64) -> Column:
    """ARRAY<BOOLEAN> of the bits, the first being the most significant."""
    return F.array(*[bit(fp, i, bits) == 1 for i in range(bits)])


def popcount(fp: Column | str) -> Column:
    return F.bit_count(_col(fp))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Distance of two packed codes."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def hamming_words(a: Column | str, b: Column | str) -> Column:
    """Distance of two codes of several words."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def hamming_bools(a: Column | str, b: Column | str) -> Column:
    """Distance of two boolean codes."""
    return F.size(F.filter(F.zip_with(_col(a), _col(b), lambda x, y: x != y), lambda d: d))


def halves(x: Column | str) -> tuple[Column, Column]:
    """Upper and lower 32 bits, nonnegative."""
    x = _col(x)
    return F.shiftrightunsigned(x, 32).cast("bigint"), x.bitwiseAND(F.lit(MASK32))


def fnv1(x: Column | str) -> tuple[Column, Column]:
    """64-bit FNV-1 of the 8 big-endian bytes of a key, as upper and lower 32 bits.

    The state is kept in halves, since a 64-bit product would overflow: the prime is 2**40 + 435.
    """
    begin = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))

    def step(s: Column, byte: Column) -> Column:
        low = s.lo * 435
        high = s.hi * 435 + F.shiftright(low, 32) + F.shiftleft(s.lo, 8)
        return F.struct(high.bitwiseAND(F.lit(MASK32)).alias("hi"), low.bitwiseAND(F.lit(MASK32)).bitwiseXOR(byte).alias("lo"))

    state = F.aggregate(key_to_bytes(x), begin, step)
    return state.hi, state.lo


def slot(x: Column | str, log2_slots: int) -> Column:
    """Hash-table slot of a key in a table of a power of two."""
    hi, lo = fnv1(x)
    if log2_slots <= 32:
        return lo.bitwiseAND(F.lit((1 << log2_slots) - 1))
    return F.shiftleft(hi.bitwiseAND(F.lit((1 << (log2_slots - 32)) - 1)), 32).bitwiseOR(lo)


def slot_of(x: Column | str, slots: int) -> Column:
    """Hash-table slot of a key in a table of any size below 2**31: the unsigned hash modulo it."""
    if not 0 < slots < 1 << 31:
        raise ValueError("1 to 2**31 - 1 slots are supported")
    hi, lo = fnv1(x)
    # hi * 2**32 + lo modulo slots, in steps that stay within 63 bits.
    return (F.pmod(F.pmod(hi, F.lit(slots)) * F.lit((1 << 32) % slots) + F.pmod(lo, F.lit(slots)), F.lit(slots))).cast("bigint")


def saturated(logits: Column | str, threshold: float) -> Column:
    """Share of logits beyond the threshold in absolute value."""
    logits = _col(logits)
    return F.size(F.filter(logits, lambda x: F.abs(x) > F.lit(threshold))) / F.size(logits)


def format_id(x: Column | str) -> Column:
    """Nine digits in groups of three."""
    s = F.lpad(_col(x).cast("string"), 9, "0")
    return F.concat_ws("-", F.substring(s, 1, 3), F.substring(s, 4, 3), F.substring(s, 7, 3))
