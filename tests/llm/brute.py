"""Plain versions of the operators, for small inputs."""

from __future__ import annotations


class Groups:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a

    def least(self, ids: list) -> list:
        out = {}
        for i, x in enumerate(ids):
            if x is not None:
                r = self.root(i)
                out[r] = min(out.get(r, x), x)
        return [out.get(self.root(i)) for i in range(len(ids))]


def shingles(text: str | None, width: int = 3) -> set:
    words = (text or "").encode().lower().split()
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def jaccard(rows: list[tuple], percent: int = 90) -> list[tuple]:
    """``(doc_id, n_shingles, component_id)`` of rows ``(doc_id, text)``."""
    sets, groups = [shingles(t) for _, t in rows], Groups(len(rows))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                groups.join(i, j)
    least = groups.least([d for d, _ in rows])
    return [(d, len(s), c if s else d) for (d, _), s, c in zip(rows, sets, least, strict=True)]
