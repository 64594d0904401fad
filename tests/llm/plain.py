"""Plain versions of what the corpus operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import xxhash

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by kind and start."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p.lstrip("0")[:4] or 0) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def pii_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def simhash(text: str | None, width: int = 4) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints: dict, radius: int = 4) -> dict:
    """Smallest key that each key reaches; a graph search over all pairs."""
    left, out = sorted(fingerprints), {}
    for key in left:
        if key in out:
            continue
        queue = [key]
        out[key] = key
        while queue:
            at = queue.pop()
            for other in left:
                if other not in out and (fingerprints[at] ^ fingerprints[other]).bit_count() <= radius:
                    out[other] = key
                    queue.append(other)
    return out


def winnow(text: str | None, hashed, gram: int, window: int) -> list[tuple[int, int]]:
    """(hash, place) of the rightmost least hash of each window, by going through all windows."""
    text = text or ""
    if not text:
        return []
    gram = min(gram, len(text))
    hashes = [hashed(text[i : i + gram]) for i in range(len(text) - gram + 1)]
    chosen = []
    for at in range(max(1, len(hashes) - window + 1)):
        part = hashes[at : at + window]
        place = at + max(i for i, h in enumerate(part) if h == min(part))
        if (hashes[place], place) not in chosen[-1:]:
            chosen.append((hashes[place], place))
    return chosen


def least_padding(lengths: list[int], buckets: int) -> int:
    """Least padding over all choices of bucket bounds."""
    distinct = sorted(set(lengths))
    best = None
    for k in range(1, min(buckets, len(distinct)) + 1):
        for inner in combinations(distinct[:-1], k - 1):
            bounds = [*inner, distinct[-1]]
            cost = sum(next(b for b in bounds if b >= n) - n for n in lengths)
            best = cost if best is None else min(best, cost)
    return best or 0


def edit_distance_within(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def nearest(examples: list[tuple[int, dict]], query: dict, k: int) -> list[tuple[float, int]]:
    """(cosine, place) of the k nearest unit vectors, by computing all cosines."""
    found = [(sum(v * query.get(w, 0.0) for w, v in vector.items()), i) for i, vector in examples]
    return sorted([(c, i) for c, i in found if c > 0], key=lambda x: (-round(x[0], 12), x[1]))[:k]


def alike(documents: list[str | None], width: int = 5) -> list[int]:
    """The first document of each one's group: likeness of word shingle sets of 0.8 or more, over all pairs."""
    words = [(t or "").encode().lower().split() for t in documents]
    sets = [{tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} for w in words]
    group = list(range(len(sets)))

    def top(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((top(i), top(j)))
                group[high] = low
    return [top(i) for i in range(len(sets))]
