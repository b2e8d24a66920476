"""Grid functions over Columns: Euclidean division, blocks, tiles, and the coordinate hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE, HALO = 256, 2
U32 = 4294967296
# The noise hash's factors and the generator's odd constants.
NOISE_X, NOISE_Y, NOISE_C = 374761393, 668265263, 1274126177
GLITCH_X, GLITCH_Y = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def emod(x: Column, n: int) -> Column:
    return F.pmod(x, F.lit(n))


def ediv(x: Column, n: int) -> Column:
    return F.floor(x / F.lit(n)).cast("long")


def aligned(x: Column, n: int) -> Column:
    return ediv(x, n) * n


def fmod_floor(x: Column, n: float) -> Column:
    return x - F.floor(x / n) * n


def hash01(x: Column, y: Column, channel: int = 0) -> Column:
    """A 32-bit hash of whole coordinates as 0 to 1. Products stay below 2^63."""
    u = lambda c: F.pmod(c, F.lit(U32))
    n = u(u(x.cast("long") * NOISE_X) + u(y.cast("long") * NOISE_Y) + channel * NOISE_C)
    n = _mul32(n.bitwiseXOR(F.shiftright(n, 13)), NOISE_C)
    n = n.bitwiseXOR(F.shiftright(n, 16))
    return n.cast("double") / float(U32 - 1)


def _mul32(n: Column, k: int) -> Column:
    """n * k modulo 2^32 for n below 2^32 and k below 2^31, from two halves that cannot overflow."""
    high, low = F.shiftright(n, 16), n.bitwiseAND(F.lit(0xFFFF))
    return F.pmod(F.shiftleft(F.pmod(high * k, F.lit(1 << 16)), 16) + low * k, F.lit(U32))


def bound(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f writes it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _wrapped(x: Column, k: int) -> Column:
    """x * k modulo 2^64 as a signed long, for whole x within 2^30 of zero: products of x and the four 16-bit parts of k."""
    part = [x.cast("long") * (k >> 16 * i & 0xFFFF) for i in range(4)]
    low, high = part[0] + F.shiftleft(part[1], 16), part[2] + F.shiftleft(part[3], 16)
    return bound(low, lambda a: F.shiftleft(F.shiftright(a, 32) + high, 32).bitwiseOR(a.bitwiseAND(F.lit(0xFFFFFFFF))))


def xorshift_state(gx: Column, gy: Column, seed: int, level: int = 0) -> Column:
    s = F.lit(seed).cast("long").bitwiseXOR(_wrapped(gx, GLITCH_X)).bitwiseXOR(_wrapped(gy, GLITCH_Y)).bitwiseXOR(F.lit(level).cast("long"))
    return bound(s, lambda x: F.when(x == 0, F.lit(1).cast("long")).otherwise(x))


def xorshift_step(s: Column) -> Column:
    s = bound(s, lambda x: x.bitwiseXOR(F.shiftleft(x, 13)))
    s = bound(s, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 7)))
    return bound(s, lambda x: x.bitwiseXOR(F.shiftleft(x, 17)))


def xorshift_unit(s: Column) -> Column:
    """0 to 1 from a state's upper half."""
    return F.shiftrightunsigned(s, 32).cast("double") / float(U32 - 1)


def away(x: Column) -> Column:
    """Rounded half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)
