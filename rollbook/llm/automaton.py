"""A trie of words and a parametric Levenshtein automaton that walks it.

Distances count insertions, deletions, substitutions and swaps of neighbours (optimal string alignment). A state is a set of
(offset, errors, swap pending) relative to a base position of the query; its transitions depend only on which of the next few
query characters equal the trie's character, so they are computed once and shared by all queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

State = tuple[tuple[int, int, int], ...]

# States by number, and the steps of each limit by (state, hits, left) in one number; shared by all queries.
_STATES: list[State] = [((0, 0, 0),)]
_NUMBERS: dict[State, int] = {_STATES[0]: 0}
_STEPS: dict[int, dict[int, tuple[int, int]]] = {}


def _reduce(states: set[tuple[int, int, int]]) -> tuple[int, State]:
    """Base shift and state without positions that another one covers."""
    kept = []
    for i, e, t in states:
        if not any((j, f, u) != (i, e, t) and f < e and u == 0 and abs(i - j) <= e - f - t for j, f, u in states):
            kept.append((i, e, t))
    if not kept:
        return 0, ()
    base = min(i for i, _, _ in kept)
    return base, tuple(sorted((i - base, e, t) for i, e, t in kept))


def _step(limit: int, number: int, hits: int, left: int) -> tuple[int, int]:
    """Base shift and number of the next state, -1 if it is empty; bit k of hits: query[base+k] equals the character; left: query characters from base on."""
    state = _STATES[number]
    out: set[tuple[int, int, int]] = set()
    for i, e, t in state:
        if t:
            if i < left and hits >> i & 1:
                out.add((i + 2, e, 0))
            continue
        if i < left and hits >> i & 1:
            out.add((i + 1, e, 0))
            continue
        if e < limit:
            out.add((i, e + 1, 0))
            if i < left:
                out.add((i + 1, e + 1, 0))
            for j in range(1, limit - e + 1):
                if i + j < left and hits >> (i + j) & 1:
                    out.add((i + j + 1, e + j, 0))
            if i + 1 < left and hits >> (i + 1) & 1:
                out.add((i, e + 1, 1))
    shift, nxt = _reduce(out)
    if not nxt:
        return 0, -1
    if nxt not in _NUMBERS:
        _NUMBERS[nxt] = len(_STATES)
        _STATES.append(nxt)
    return shift, _NUMBERS[nxt]


def _bit(c: str) -> int:
    return 1 << ord(c) % 61


def _with_needs(node: dict) -> tuple[dict, int]:
    """The node with, beside each child, the letters that all words below it still need, and those of the node itself."""
    out, need = {}, -1
    for c, child in node.items():
        below, rest = (child, 0) if isinstance(child, str) else _with_needs(child)
        out[c] = (rest, below)
        need &= rest | _bit(c)
    return out, need


class WordTrie:
    """Words with their characters as paths, one trie for each length of word."""

    def __init__(self, words: Iterable[str]) -> None:
        plain: dict[int, dict] = {}
        self.words = {w for w in words if w}
        for word in sorted(self.words):
            node = plain.setdefault(len(word), {})
            for c in word[:-1]:
                node = node.setdefault(c, {})
            node[word[-1]] = word
        self.roots = {size: _with_needs(root)[0] for size, root in plain.items()}

    def search(self, query: str, limit: int, allowed: Callable[[int], int] | None = None) -> list[tuple[str, int]]:
        """All words within the distance, with their distances; allowed: the distance allowed to words of a length, if less."""
        n = len(query)
        out = []
        for size in range(max(1, n - limit), n + limit + 1):
            if root := self.roots.get(size):
                most = limit if allowed is None else min(limit, allowed(size))
                if most == 0:
                    if size == n and query in self.words:
                        out.append((query, 0))
                elif abs(n - size) <= most:
                    self._walk(root, size, query, most, out)
        return out

    @staticmethod
    def _walk(root: dict, size: int, query: str, limit: int, out: list[tuple[str, int]]) -> None:
        n, span = len(query), 2 * limit + 2
        bits: dict[str, int] = {}
        missing = -1
        for k, c in enumerate(query):
            bits[c] = bits.get(c, 0) | 1 << k
            missing &= ~_bit(c)
        steps, wide = _STEPS.setdefault(limit, {}), 2 * span
        stack: list[tuple[dict, int, int, int, int]] = [(root, size - 1, 0, 0, limit)]
        mask = (1 << span) - 1
        while stack:
            node, rest, base, state, errors = stack.pop()
            left = n - base if n - base < span else span
            for c, (need, child) in node.items():
                if (need & missing).bit_count() > errors:  # each letter that the query lacks is an error
                    continue
                hits = bits.get(c, 0) >> base & mask
                key = (state << wide | left << span) + hits
                if (known := steps.get(key)) is None:
                    known = steps[key] = _step(limit, state, hits, left)
                shift, number = known
                if number < 0:
                    continue
                nxt = _STATES[number]
                if rest:
                    # What is left of both must not differ by more than the errors left.
                    gap = n - base - shift - rest
                    spare = [limit + t - e for i, e, t in nxt if e + abs(gap - i) <= limit + t]
                    if spare:
                        stack.append((child, rest - 1, base + shift, number, max(spare)))
                elif (best := min((e + n - base - shift - i for i, e, t in nxt if t == 0), default=limit + 1)) <= limit:
                    out.append((child, best))


def distance(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance, or limit + 1 if it is larger."""
    if a == b:
        return 0
    # Every letter that one side lacks costs an error of its own.
    if abs(len(a) - len(b)) > limit or len(set(a).difference(b)) > limit or len(set(b).difference(a)) > limit:
        return limit + 1
    start, m, n = 0, len(a), len(b)
    while start < m and start < n and a[start] == b[start]:
        start += 1
    while m > start and n > start and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[start:m], b[start:n]
    m, n, far = len(a), len(b), limit + 1
    before: list[int] = []
    row = [min(j, far) for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        # Cells further than the limit from the diagonal are out of reach.
        low, high = max(1, i - limit), min(n, i + limit)
        older, before = before, row
        row = [far] * (n + 1)
        row[0] = min(i, far)
        least = row[low - 1]
        for j in range(low, high + 1):
            y = b[j - 1]
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row[j] = v
            least = min(least, v)
        if least > limit and min(before) > limit:
            return far
    return min(row[-1], far)
