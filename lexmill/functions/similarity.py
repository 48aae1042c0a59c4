"""String similarity kernels: normalised Indel ratios by bit-parallel LCS, many windows at once in NumPy."""

from __future__ import annotations

import numpy as np


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    # One step for each character of the shorter string.
    codes = _codes(a)
    places = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _share(common: int, total: int) -> float:
    return 100.0 if total == 0 else 200.0 * common / total


def ratio(a: str, b: str) -> float:
    """200 LCS / (len a + len b); 100 for two empty strings."""
    return _share(lcs(a, b), len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best of comparing the shared tokens with either side and the sides with each other."""
    return token_sets_ratio(set(a.split()), set(b.split()))


def token_sets_ratio(x: set[str], y: set[str], least: float = 0.0) -> float:
    """token_set_ratio() of token sets; where it can't be over least, some number that isn't either."""
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    common, p, q = " ".join(both), " ".join(left), " ".join(right)
    gap = 1 if common else 0
    np_, nq = len(common) + gap + len(p), len(common) + gap + len(q)
    best = max(_share(len(common), len(common) + np_), _share(len(common), len(common) + nq)) if common else 0.0
    # Both whole sides start with the shared tokens, so only the rest need comparing; and that only where it can matter.
    most = _share(len(common) + gap + min(len(p), len(q)), np_ + nq)
    return max(best, _share(len(common) + gap + lcs(p, q), np_ + nq)) if most > max(best, least) else best


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _windows(needle: str, texts: list[str]) -> np.ndarray:
    """For each text, the best ratio of needle with a window of its length, or shorter at either end."""
    m = len(needle)
    lanes = -(-m // 64)
    codes = _codes(needle)
    alphabet = np.unique(codes)
    masks = np.zeros((lanes, len(alphabet) + 1), np.uint64)
    for i, k in enumerate(np.searchsorted(alphabet, codes).tolist()):
        masks[i // 64, k + 1] |= np.uint64(1) << np.uint64(i % 64)
    # All texts in a row with m - 1 blanks before and after each; a blank matches nothing.
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 2 * (m - 1)) - sizes - (m - 1)
    total = int((sizes + 2 * (m - 1)).sum())
    at = np.zeros(total, np.int64)
    inside = np.zeros(total + 1, np.int64)
    for t, s in zip(texts, starts.tolist(), strict=True):
        c = _codes(t)
        k = np.minimum(np.searchsorted(alphabet, c), len(alphabet) - 1)
        at[s : s + len(c)] = np.where(alphabet[k] == c, k + 1, 0)
        inside[s : s + len(c)] = 1
    inside = np.concatenate(([0], np.cumsum(inside[:-1])))
    n = total - m + 1
    seen = masks[:, at]
    row = np.full((lanes, n), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(m):
        carry = np.zeros(n, np.uint64)
        for lane in range(lanes):
            hit = row[lane] & seen[lane, j : j + n]
            up = row[lane] + hit
            over = up < hit
            up2 = up + carry
            carry = (over | (up2 < up)).astype(np.uint64)
            row[lane] = up2 | (row[lane] - hit)
    common = np.zeros(n, np.int64)
    for lane in range(lanes):
        bits = min(64, m - 64 * lane)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) if bits == 64 else np.uint64((1 << bits) - 1)
        common += np.bitwise_count(~row[lane] & keep).astype(np.int64)
    width = inside[m : m + n] - inside[:n]
    score = 200.0 * common / (m + width)
    return np.array([score[s - (m - 1) : s + k].max() if k else 0.0 for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)])


def partial_ratios(query: str, texts: list[str], most_chars: int = 1 << 15) -> np.ndarray:
    """partial_ratio(query, t) of each text: the shorter string against the best window of the longer."""
    out = np.zeros(len(texts))
    long = []
    for i, t in enumerate(texts):
        if not query and not t:
            out[i] = 100.0
        elif query and len(t) > len(query):
            long.append(i)
        elif query and t:
            out[i] = _windows(t, [query])[0]
            if len(t) == len(query):
                out[i] = max(out[i], _windows(query, [t])[0])
    held: list[int] = []
    size = 0
    for k, i in enumerate(long):
        held.append(i)
        size += len(texts[i])
        if size >= most_chars or k == len(long) - 1:
            out[held] = _windows(query, [texts[j] for j in held])
            held, size = [], 0
    return out
