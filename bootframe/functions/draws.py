"""Seeded, partition-independent random draws as column expressions.

Every random number is a pure function of ``(seed, replicate, position)`` or
``(seed, replicate, row key)``. A lost partition therefore recomputes to the
same values, and the result does not depend on how the data is split.

Two hash families:

* ``"xxhash64"``: fast, JVM-native; the production default.
* ``"md5"``: slower, but any SQL engine with ``md5`` reproduces the draws
  exactly, which lets an external SQL oracle check a bootstrap value for value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from bootframe.functions.normal import norm_ppf

HASHES = ("xxhash64", "md5")

_TWO_POW_52 = float(2**52)
_TWO_POW_53 = float(2**53)


def _check_hash(hash: str) -> None:
    if hash not in HASHES:
        raise ValueError(f"hash must be one of {HASHES}, got {hash!r}")


def key_string(seed: int, parts: Sequence[Column]) -> Column:
    """``'seed|p1|p2|…'``: the text hashed by the ``md5`` family."""
    return F.concat_ws("|", F.lit(str(int(seed))), *[p.cast("string") for p in parts])


def hash_bits(seed: int, parts: Sequence[Column], hash: str = "xxhash64") -> Column:
    """A non-negative BIGINT hash of ``(seed, *parts)``.

    md5: the first 15 hex digits (60 bits). xxhash64: the top 63 bits.
    """
    _check_hash(hash)
    if hash == "md5":
        hexed = F.substring(F.md5(key_string(seed, parts)), 1, 15)
        return F.conv(hexed, 16, 10).cast("bigint")
    return F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)).cast("bigint"), *parts), 1)


#: MD5 (RFC 1321): bits that each step turns its sum by, and constants.
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: Numbers that are hashed at once: those that differ in their last digits only.
_TOGETHER = 10_000


def _md5_head(words: list[int | np.ndarray], size: int) -> np.ndarray:
    """First eight bytes, as a number, of the MD5 of many messages of one 64-byte block: its words, arrays of ``size`` where messages differ."""
    begin = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(size, x, np.uint32) for x in begin)
    f, g = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            k = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            k = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            k = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            k = 7 * i % 16
        f += a
        if isinstance(words[k], np.ndarray):
            f += words[k]
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + words[k]) % 2**32)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=g)
        f <<= np.uint32(_TURNS[i])
        f |= g
        f += b
        # a's array takes the next sum
        a, b, c, d, f = d, f, b, c, a
    head = [(x + np.uint32(y)).byteswap().astype(np.uint64) for x, y in ((a, begin[0]), (b, begin[1]))]
    return head[0] << np.uint64(32) | head[1]


def md5_bits(seed: int, r: int, first: int, last: int) -> np.ndarray:
    """:func:`hash_bits` (md5) of (seed, r, s) for every ``s`` from ``first`` to ``last`` (not included), all from 0 up."""
    out, prefix = [np.empty(0, np.int64)], f"{int(seed)}|{int(r)}|".encode()
    while first < last:
        # numbers of one length that differ in their last digits only
        end = min(last, first // _TOGETHER * _TOGETHER + _TOGETHER, 10 ** len(str(first)))
        text = prefix + str(first).encode()
        if len(text) > 55:
            raise ValueError("seed, replicate and draw are too long for one block of MD5")
        block = bytearray(text + b"\x80" + bytes(55 - len(text)) + (8 * len(text)).to_bytes(8, "little"))
        digits = min(len(str(first)), len(str(_TOGETHER - 1)))
        s = np.arange(first, end)
        block[len(text) - digits : len(text)] = bytes(digits)
        words: list = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
        for i in range(digits):
            at = len(text) - 1 - i
            digit = (s // 10**i % 10 + 48).astype(np.uint32) << np.uint32(8 * (at % 4))
            words[at // 4] = digit | words[at // 4] if isinstance(words[at // 4], np.ndarray) else digit | np.uint32(words[at // 4])
        out.append((_md5_head(words, len(s)) >> np.uint64(4)).astype(np.int64))
        first = end
    return np.concatenate(out)


def draw_index(seed: int, r: Column, s: Column, n: int, hash: str = "xxhash64") -> Column:
    """Row index 0..n-1 picked by draw ``s`` of replicate ``r`` (uniform, with replacement).

    Declared non-null (it never is), so a join on it infers no extra
    ``isnotnull`` filter that would evaluate the hash a second time.
    """
    return F.coalesce(F.pmod(hash_bits(seed, [r, s], hash), F.lit(int(n)).cast("bigint")), F.lit(0).cast("bigint"))


def uniform(seed: int, parts: Sequence[Column], hash: str = "xxhash64") -> Column:
    """A uniform double in [0, 1) from ``(seed, *parts)``, exact in binary."""
    _check_hash(hash)
    if hash == "md5":
        hexed = F.substring(F.md5(key_string(seed, parts)), 1, 13)
        return F.conv(hexed, 16, 10).cast("bigint") / F.lit(_TWO_POW_52)
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)).cast("bigint"), *parts), 11)
    return bits / F.lit(_TWO_POW_53)


def poisson_thresholds(rate: float) -> list[float]:
    """Cumulative Poisson(rate) probabilities P(X <= k), k = 0, 1, …, as long as they grow below 1.0."""
    out: list[float] = []
    term = math.exp(-float(rate))
    cum, k = term, 0
    while cum < 1.0 and (k <= rate or not out or cum > out[-1]):
        out.append(cum)
        k += 1
        term *= rate / k
        cum += term
    return out


def poisson1_thresholds() -> list[float]:
    """:func:`poisson_thresholds` of rate 1."""
    return poisson_thresholds(1.0)


def poisson_weight(u: Column, rate: float = 1.0) -> Column:
    """Poisson(rate) count by inverse CDF of the uniform ``u`` (a plain CASE chain, for small rates)."""
    thresholds = poisson_thresholds(rate)
    expr = None
    for k, c in enumerate(thresholds):
        cond = u < F.lit(c)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return (F.lit(0) if expr is None else expr.otherwise(F.lit(len(thresholds)))).cast("bigint")


def poisson_weight_sql(u_sql: str, rate: float = 1.0) -> str:
    """The same CASE chain as SQL text (used by oracle queries)."""
    thresholds = poisson_thresholds(rate)
    arms = " ".join(f"WHEN {u_sql} < CAST('{c!r}' AS DOUBLE) THEN {k}" for k, c in enumerate(thresholds))
    return f"(CASE {arms} ELSE {len(thresholds)} END)" if thresholds else "0"


#: counts from here on are drawn by the normal expansion, smaller ones by their binary digits
LARGE_COUNT = 64


def poisson_large(mean: Column, z: Column) -> Column:
    """Poisson(mean) count for means of some 50 and more, from the standard normal ``z``.

    The normal expansion of the inverse Poisson CDF to order 1/mean (M. Giles, Algorithm 955, ACM
    TOMS 42, 2016), rounded down. It differs from the exact inverse for about two in 10^5 uniforms at a mean of
    60, and for fewer at larger ones; the work doesn't grow with the mean.
    """
    s = F.sqrt(mean)
    q = mean + s * z + (F.lit(1 / 3) + z * z / 6) + (-z / 36 - z * z * z / 72) / s + (F.lit(-8 / 405) + z * z * 7 / 810 + z * z * z * z / 270) / mean
    return F.greatest(F.floor(q), F.lit(0)).cast("bigint")


def poisson_pieces(count: Column) -> Column:
    """An array of (size, tag): sizes that add up to ``count`` and have a quick Poisson draw each.
    The binary digits of a count below ``LARGE_COUNT``, else the count itself (tag z)."""
    digits = [F.when(count.bitwiseAND(F.lit(1 << b).cast("bigint")) != 0, F.struct(F.lit(1 << b).cast("bigint").alias("size"), F.lit(f"b{b}").alias("tag"))) for b in range(LARGE_COUNT.bit_length() - 1)]
    whole = F.array(F.struct(count.alias("size"), F.lit("z").alias("tag")))
    return F.when(count >= LARGE_COUNT, whole).otherwise(F.filter(F.array(*digits), lambda x: x.isNotNull()))


def normal_of_piece(size: Column, u: Column) -> Column:
    """The standard normal that a count drawn whole is made from (null for digits)."""
    return F.when(size >= LARGE_COUNT, norm_ppf(F.greatest(u, F.lit(2.0**-54))))


def poisson_of_piece(size: Column, rate: float, u: Column, z: Column) -> Column:
    """Poisson(rate * size) for one of :func:`poisson_pieces`, by inverse CDF of the uniform column
    ``u`` (``z``: :func:`normal_of_piece`; both are read many times, so let them be columns)."""
    # how many thresholds the uniform reaches: a list keeps the code small enough to be compiled
    steps = F.when(F.lit(False), F.array(F.lit(0.0)))
    for b in range(LARGE_COUNT.bit_length() - 1):
        steps = steps.when(size == 1 << b, F.expr(f"array({', '.join(f'{t!r}D' for t in poisson_thresholds(rate * 2**b) or [0.0])})"))
    small = F.size(F.filter(steps, lambda t: t <= u)).cast("bigint")
    return F.when(size >= LARGE_COUNT, poisson_large(size * F.lit(float(rate)), z)).otherwise(small)


def zero_below(size: Column, rate: float) -> Column:
    """The uniform below which :func:`poisson_of_piece` is 0 (0 for counts drawn whole)."""
    cut = F.when(size >= LARGE_COUNT, F.lit(0.0))
    for b in range(LARGE_COUNT.bit_length() - 1):
        cut = cut.when(size == 1 << b, F.lit((poisson_thresholds(rate * 2**b) or [1.0])[0]))
    return cut
