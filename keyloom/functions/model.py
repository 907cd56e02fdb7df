"""The hash algebra on plain Python integers: what the column expressions and numpy kernels are tested against."""

from __future__ import annotations

M32, M64 = (1 << 32) - 1, (1 << 64) - 1
FINGERPRINT_FACTOR = PILOT_FACTOR = 0x517CC1B727220A95


def split_key(key: bytes) -> tuple[int, int, int]:
    """(prefix, k0, k1) of a key: the first eight bytes big-endian, then both halves little-endian."""
    return int.from_bytes(key[:8], "big"), int.from_bytes(key[:8], "little"), int.from_bytes(key[8:16], "little")


def fast_range(h: int, n: int) -> int:
    return (h * n) >> 64


def wymix(a: int, b: int) -> int:
    p = a * b
    return (p >> 64) ^ (p & M64)


def mixed_slot(k0: int, k1: int, global_seed: int, seed: int, size: int) -> int:
    return 0 if size <= 1 else fast_range(wymix(k0 ^ global_seed ^ seed, k1 ^ global_seed), size)


def cubic_bucket(x: int, buckets: int) -> int:
    if buckets <= 1:
        return 0
    squared = (x * x) >> 64
    cubed = (squared * ((x >> 1) | (1 << 63))) >> 64
    return fast_range((cubed >> 8) * 255 + (x >> 8), buckets)


def pilot_hash(pilot: int, global_seed: int) -> int:
    x = PILOT_FACTOR * (pilot ^ global_seed) & M64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return (x ^ (x >> 31)) | 1


def folded(k0: int, k1: int) -> int:
    h = k0 ^ k1
    return h ^ (h >> 32)


def pilot_slot(fold: int, hashed_pilot: int, slots: int) -> int:
    return fast_range(fold * hashed_pilot & M64, slots)


def fingerprint(k0: int, k1: int, size: int) -> int:
    return ((k0 ^ (k1 * FINGERPRINT_FACTOR & M64)) >> 32) & ((1 << (8 * size)) - 1)


def signed(u: int) -> int:
    """The bigint with the bits of an unsigned 64-bit integer."""
    return u - (1 << 64) if u >> 63 else u
