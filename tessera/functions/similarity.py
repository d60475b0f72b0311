"""String similarities: plain functions, vectorised by the callers."""

from __future__ import annotations


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length)."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best indel ratio among the common tokens and the common tokens with each side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    common, with_left, with_right = (" ".join(part) for part in (both, both + left, both + right))
    best = indel_ratio(with_left, with_right)
    return max(best, indel_ratio(common, with_left), indel_ratio(common, with_right)) if both else best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by up to four common leading characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, from_a = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                from_a.append(x)
                break
    m = len(from_a)
    if not m:
        return 0.0
    from_b = [y for y, taken in zip(b, used, strict=True) if taken]
    swapped = sum(x != y for x, y in zip(from_a, from_b, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)
