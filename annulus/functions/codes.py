"""Codecs of vectors over numpy matrices: rotations, PCA, product and one-bit quantisation; distances on codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def round_up(a: int, b: int) -> int:
    return ceil_div(a, b) * b


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def unpack_nibbles(packed: np.ndarray, dim: int) -> np.ndarray:
    """4-bit codes of packed bytes, the first in the high half."""
    out = np.stack([packed >> 4, packed & 15], axis=-1)
    return out.reshape(*packed.shape[:-1], -1)[..., :dim]


def code_distance(metric: str, codes: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray, levels: int) -> np.ndarray:
    """Squared distance or negative product of decoded scalar codes and a query; packed 4-bit codes if levels is 15 and they are half as wide."""
    if levels == 15 and codes.shape[-1] < len(low):
        codes = unpack_nibbles(codes, len(low))
    x = low + codes / levels * (high - low)
    return ((x - query) ** 2).sum(axis=-1) if metric == "l2" else -(x * query).sum(axis=-1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, not normalised."""
    n = x.shape[-1]
    if not is_power_of_two(n):
        raise ValueError("the length must be a power of two")
    y, half = np.array(x, dtype=np.float64), 1
    while half < n:
        v = y.reshape(*y.shape[:-1], n // (2 * half), 2, half)
        a, b = v[..., 0, :].copy(), v[..., 1, :].copy()
        v[..., 0, :], v[..., 1, :] = a + b, a - b
        half *= 2
    return y


def random_rotation(dim: int, seed: int = 0) -> np.ndarray:
    """Orthogonal matrix from the QR factors of a Gaussian one, signs fixed by the diagonal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))[None, :]


def sign_rotation(x: np.ndarray, seed: int = 0, rounds: int = 4) -> np.ndarray:
    """Random sign flips and Hadamard transforms in turns, rows padded to a power of two; keeps lengths."""
    n = 1 << max(0, x.shape[-1] - 1).bit_length()
    y = np.zeros((*x.shape[:-1], n))
    y[..., : x.shape[-1]] = x
    signs = np.random.default_rng(seed).integers(0, 2, (rounds, n)) * 2 - 1
    for s in signs:
        y = hadamard(y * s) / np.sqrt(n)
    return y


@dataclass
class PCA:
    mean: np.ndarray
    components: np.ndarray  # rows, by falling variance
    variance: np.ndarray

    @classmethod
    def from_moments(cls, n: int, total: np.ndarray, products: np.ndarray, k: int) -> "PCA":
        """From the count, the sum and the sum of outer products of the rows."""
        mean = total / n
        value, vector = np.linalg.eigh(products / max(n - 1, 1) - np.outer(mean, mean) * n / max(n - 1, 1))
        order = np.argsort(-value, kind="stable")[:k]
        return cls(mean, canonical_signs(vector[:, order].T), value[order])

    def transform(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components.T

    def inverse(self, y: np.ndarray) -> np.ndarray:
        return y @ self.components + self.mean


def canonical_signs(rows: np.ndarray) -> np.ndarray:
    """Each row with a sum of at least 0; where that is almost 0, with its largest component positive."""
    s = rows.sum(axis=1)
    top = rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]
    flip = np.where(np.abs(s) > 1e-9, s < 0, top < 0)
    return np.where(flip[:, None], -rows, rows)


def lloyd(x: np.ndarray, k: int, seed: int = 0, rounds: int = 10, tol: float = 1e-5) -> np.ndarray:
    """k-means in memory, of a bounded sample: k-means++ start, empty centres stay."""
    r = np.random.default_rng(seed)
    centres = [x[r.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, min(k, len(x))):
        p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        centres.append(x[r.choice(len(x), p=p)])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(axis=1))
    c, last = np.array(centres), np.inf
    for _ in range(rounds):
        d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T
        at = d.argmin(axis=1)
        cost = d[np.arange(len(x)), at].sum()
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if last - cost <= tol * max(abs(cost), 1e-12):
            break
        last = cost
    return c


@dataclass
class ProductQuantizer:
    """Vectors as one byte a chunk: the nearest of up to 256 centres of the chunk's residual to the mean."""

    mean: np.ndarray
    cuts: np.ndarray
    centres: list[np.ndarray]

    @classmethod
    def train(cls, sample: np.ndarray, chunks: int, seed: int = 0, size: int = 256) -> "ProductQuantizer":
        mean = sample.mean(axis=0)
        cuts = np.linspace(0, sample.shape[1], chunks + 1).astype(int)
        rest = sample - mean
        return cls(mean, cuts, [lloyd(rest[:, a:b], min(size, len(sample)), seed + k) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))])

    def encode(self, x: np.ndarray) -> np.ndarray:
        rest, out = x - self.mean, np.empty((len(x), len(self.centres)), dtype=np.uint8)
        for k, c in enumerate(self.centres):
            part = rest[:, self.cuts[k] : self.cuts[k + 1]]
            out[:, k] = ((c * c).sum(axis=1)[None, :] - 2 * part @ c.T).argmin(axis=1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, k]] for k, c in enumerate(self.centres)], axis=1) + self.mean

    def query_table(self, query: np.ndarray) -> list[np.ndarray]:
        """Squared distance of the query's chunks to their centres."""
        rest = query - self.mean
        return [((c - rest[a:b]) ** 2).sum(axis=1) for c, a, b in zip(self.centres, self.cuts[:-1], self.cuts[1:])]

    def distances(self, table: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances, by table entries."""
        return sum(t[codes[:, k]] for k, t in enumerate(table))

    def symmetric(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(((c[a[:, k]] - c[b[:, k]]) ** 2).sum(axis=1) for k, c in enumerate(self.centres))


@dataclass
class OneBit:
    """One sign a rotated component of the residual to a centre, with the factors that make the estimate unbiased."""

    centre: np.ndarray
    rotation: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, residual lengths, and the cosine of each residual with its sign vector."""
        rest = (x - self.centre) @ self.rotation.T
        length = np.linalg.norm(rest, axis=1)
        unit = rest / np.maximum(length, 1e-300)[:, None]
        return np.packbits(rest > 0, axis=1), length, np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])

    def estimate(self, query: np.ndarray, bits: np.ndarray, length: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Estimated squared distances."""
        rest = (query - self.centre) @ self.rotation.T
        signs = (np.unpackbits(bits, axis=1)[:, : len(rest)].astype(np.float64) * 2 - 1) / np.sqrt(len(rest))
        product = length * (signs @ rest) / np.maximum(cosine, 1e-12)
        return length**2 + rest @ rest - 2 * np.where(length > 0, product, 0.0)
