"""Driver-side choice between exact and approximate plans, and validation of arguments."""

from __future__ import annotations

import math

HINTS = ("auto", "disable", "bitset_prefilter", "iterative_filter")
DTYPES, METRICS, QUANTISERS, KINDS = ("float32", "int8", "uint8"), ("l2", "ip", "cos"), ("none", "sq8", "sq4", "rabitq"), ("hnsw", "nsg", "fusion", "flat")
IDS = ("uint32", "uint64")


def normalize_hint(hint: str | None) -> str:
    h = (hint or "auto").strip().lower()
    if h not in HINTS:
        raise ValueError(f"Unsupported filter hint: {hint}")
    return "bitset_prefilter" if h == "disable" else h


def exact_is_cheaper(k: int, rows: int, matched: int) -> bool:
    """k is half of the table or of the matches, or at most 7 % of the rows match."""
    return k >= 0.5 * rows or rows - matched >= 0.93 * rows or k >= 0.5 * matched


def pool_size(k: int, rows: int, matched: int, least: int) -> int:
    """Candidates to fetch so that k survive a filter."""
    return max(least, -(-3 * k * rows // (2 * max(matched, 1))))


def search_mode(k: int, rows: int, matched: int, hint: str | None, filtered: bool) -> str:
    """plain, exact, bitset_prefilter or iterative_filter."""
    h = normalize_hint(hint)
    if not filtered:
        return "plain"
    if h == "auto":
        return "exact" if exact_is_cheaper(k, rows, matched) else "bitset_prefilter"
    return h


def _one_of(what: str, value: str, allowed: tuple[str, ...]) -> str:
    v = str(value).strip().lower()
    if v not in allowed:
        raise ValueError(f"Unsupported {what}: {value}")
    return v


def valid_dtype(x: str) -> str:
    return _one_of("dtype", x, DTYPES)


def valid_id_type(x: str) -> str:
    return _one_of("id type", x, IDS)


def valid_metric(x: str) -> str:
    return _one_of("metric", {"euclidean": "l2", "cosine": "cos", "inner_product": "ip"}.get(str(x).lower(), x), METRICS)


def valid_quantiser(x: str | None) -> str:
    return _one_of("quantization", x or "none", QUANTISERS)


def valid_index(x: str) -> str:
    return _one_of("index type", x, KINDS)


def valid_neighbours(x: int) -> int:
    if not 0 < x < 1000:
        raise ValueError("max_nbrs must be between 1 and 999")
    return x


def valid_capacity(x: int) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x <= 0:
        raise ValueError("capacity must be a positive integer")
    return x


def valid_threads(x: int) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x <= 0:
        raise ValueError("num_threads must be positive")
    return x


def valid_vectors(vectors, dim: int | None, metric: str = "l2", allow_one: bool = True) -> list[list[float]]:
    """Rows of finite floats of one dimension; normalised for cosine (a zero vector stays)."""
    rows = [vectors] if allow_one and len(vectors) and not hasattr(vectors[0], "__len__") else list(vectors)
    if not len(rows):
        raise ValueError("vectors must not be empty")
    out = []
    for r in rows:
        if dim is not None and len(r) != dim:
            raise ValueError(f"Vector dimension mismatch: expected {dim}, got {len(r)}")
        v = [float(x) for x in r]
        n = math.sqrt(sum(x * x for x in v)) if metric == "cos" else 1.0
        out.append([x / (n or 1.0) for x in v])
    if len({len(v) for v in out}) > 1:
        raise ValueError("vectors must have one dimension")
    return out
