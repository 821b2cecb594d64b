"""Floating structure searches over columns of the Gram matrix.

A set of terms is scored by the share of y'y that it explains.  What a further term would add follows for all
candidates at once from the columns of the terms already taken, so a search needs these columns only, be the
candidates six or a hundred thousand; what a set loses without one of its terms needs the set's own block.

Every search walks by single terms and remembers the best score met at each size.  A step up is followed by steps down as
long as these beat what is remembered, and the other way round; terms of a protected base never leave.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .gram import Gram

#: Scores this near, relative to the larger, are equal; the first candidate is taken.
TIE = 1e-9
#: Share of a column's own square under which nothing is left of it.
NONE = 1e-13


class Dense:
    """The columns of a Gram matrix that is there as a whole."""

    def __init__(self, q: Gram):
        self.q, self.m, self.d, self.b, self.yy, self.n = q, len(q.b), np.diag(q.g), q.b, q.yy, q.n

    def fetch(self, wanted: list[int]) -> None:
        pass

    def column(self, i: int) -> np.ndarray:
        return self.q.g[i]

    def gram(self, chosen: list[int]) -> Gram:
        return self.q.sub(chosen)


@dataclass
class Book:
    """Best score, and the terms that reached it, by number of terms."""

    scores: dict[int, float] = field(default_factory=dict)
    terms: dict[int, tuple[int, ...]] = field(default_factory=dict)

    def better(self, size: int, score: float) -> bool:
        held = self.scores.get(size, -np.inf)
        return score > held + TIE * max(abs(held), TIE) if np.isfinite(held) else True

    def enter(self, terms: tuple[int, ...], score: float) -> None:
        self.scores[len(terms)], self.terms[len(terms)] = score, terms


def first_best(values: np.ndarray) -> int:
    """Place of the largest value, of nearly equal ones the first."""
    top = values.max()
    return int(np.flatnonzero(values >= top - TIE * max(abs(top), TIE))[0])


class Floating:
    """``osf`` adds and drops, ``oif`` also swaps, ``oos`` oscillates about the wanted number of terms with growing depth."""

    #: Candidates whose columns are fetched together, as the likely next ones.
    ahead = 16

    def __init__(self, q):
        self.q = Dense(q) if isinstance(q, Gram) else q
        self.m = self.q.m
        self.scored: dict[tuple[int, ...], float] = {}

    def _block(self, terms: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns of the terms, inverse of their block, their products with y)."""
        self.q.fetch(list(terms))
        columns = np.array([self.q.column(i) for i in terms]).reshape(len(terms), self.m)
        at = list(terms)
        return columns, np.linalg.pinv(columns[:, at], rcond=1e-12, hermitian=True), self.q.b[at]

    def score(self, terms) -> float:
        """Share of y'y that the terms explain."""
        key = tuple(sorted(terms))
        if not key:
            return 0.0
        if key not in self.scored:
            _, inverse, b = self._block(key)
            self.scored[key] = float(b @ inverse @ b / self.q.yy) if self.q.yy > 0 else 0.0
        return self.scored[key]

    def gains(self, terms: tuple[int, ...]) -> np.ndarray:
        """What each candidate would add to the score; 0 for one of which the terms leave nothing."""
        d, b = self.q.d, self.q.b
        if terms:
            columns, inverse, own = self._block(terms)
            d = d - np.einsum("ij,ij->j", columns, inverse @ columns)
            b = b - own @ inverse @ columns
        usable = d > NONE * np.maximum(self.q.d, 1e-300)
        return np.where(usable, b * b / np.where(usable, d, 1.0), 0.0) / self.q.yy if self.q.yy > 0 else np.zeros(self.m)

    def strongest(self, terms: tuple[int, ...], pool: np.ndarray) -> int:
        """The candidate of the pool, places in order, that adds most."""
        gain = self.score(terms) + self.gains(terms)[pool]
        best = int(pool[first_best(gain)])
        self.q.fetch([best, *(int(pool[i]) for i in np.argsort(-gain, kind="stable")[: self.ahead])])
        return best

    def add(self, terms: tuple[int, ...]) -> tuple[int, ...]:
        """The terms with the one that adds most."""
        return tuple(sorted((*terms, self.strongest(tuple(terms), self._pool(terms)))))

    def weakest(self, terms: tuple[int, ...], among: tuple[int, ...]) -> int:
        """The term, one of ``among``, that the others miss least."""
        order = sorted(among)
        return order[first_best(np.array([self.score(tuple(t for t in terms if t != i)) for i in order]))]

    def _pool(self, *taken) -> np.ndarray:
        free = np.ones(self.m, bool)
        for terms in taken:
            free[list(terms)] = False
        return np.flatnonzero(free)

    def _shed(self, base: tuple[int, ...], terms: tuple[int, ...], book: Book, just: int | None) -> tuple[int, ...]:
        """Terms left of ``terms`` after those went without which the rest, with the base, beats the best of its size; a base term that is
        weakest ends it, and so does at first the one that came ``just`` before."""
        while terms and len(base) + len(terms) > 2:
            weak = self.weakest((*base, *terms), (*base, *terms))
            less = tuple(t for t in terms if t != weak)
            score = self.score((*base, *less))
            if weak in base or weak == just or not book.better(len(less), score):
                break
            terms, just = less, None
            book.enter(terms, score)
        return terms

    def _grow(self, base: tuple[int, ...], count: int, pool: np.ndarray | None = None, swap: bool = False) -> tuple[int, ...]:
        """``count`` terms on top of the base, floating.  A given pool loses what was taken once; without one all others stay candidates."""
        book, terms, once = Book(), (), pool is not None
        book.enter((), self.score(base))
        while len(terms) < count:
            some = pool if once else self._pool(base, terms)
            if not len(some):
                break
            new = self.strongest((*base, *terms), some)
            more = (*terms, new)
            score = self.score((*base, *more))
            if book.better(len(more), score):
                book.enter(more, score)
            terms = book.terms[len(more)]
            if once:
                pool = np.setdiff1d(pool, terms)
            terms = self._shed(base, terms, book, new)
            if swap and terms:
                terms = self._swapped(terms, book)
        return terms

    def _swapped(self, terms: tuple[int, ...], book: Book) -> tuple[int, ...]:
        """The terms after the one exchange that gains most, if any gains, and what it sheds."""
        best, top, came = terms, self.score(terms), None
        for out in terms:
            rest = tuple(t for t in terms if t != out)
            new = self.strongest(rest, self._pool(rest))
            if new != out and (score := self.score((*rest, new))) > top + TIE * max(top, TIE):
                best, top, came = (*rest, new), score, new
        if came is None:
            return terms
        book.enter(best, top)
        return self._shed((), best, book, came)

    def _shrink(self, terms: tuple[int, ...], count: int) -> tuple[int, ...]:
        """What is left after ``count`` terms went, floating: one that went returns where that beats the best of its size."""
        book, gone = Book(), ()
        book.enter(terms, self.score(terms))
        left = terms
        while len(gone) < count:
            weak = self.weakest(left, left)
            less = tuple(t for t in left if t != weak)
            if book.better(len(less), self.score(less)):
                book.enter(less, self.score(less))
            left = book.terms[len(less)]
            gone = tuple(t for t in terms if t not in left)
            just = weak
            while len(gone) > 1:
                back = self.strongest(left, np.array(sorted(gone)))
                if back == just or not book.better(len(left) + 1, self.score((*left, back))):
                    break
                left, just = (*left, back), None
                book.enter(left, self.score(left))
                gone = tuple(t for t in terms if t not in left)
        return left

    def osf(self, k: int) -> list[int]:
        return sorted(self._grow((), min(k, self.m)))

    def oif(self, k: int) -> list[int]:
        return sorted(self._grow((), min(k, self.m), swap=True))

    def oos(self, k: int, max_depth: int | None = None) -> list[int]:
        """From ``k`` terms taken one by one: take ``depth`` terms away and put the best ``depth`` on what is left, or the other way round; both are floating
        searches, whatever the depth, and what is left is never touched by the second.  The depth grows while neither swing gains."""
        k = min(k, self.m)
        if max_depth is not None and max_depth < 1:
            raise ValueError("max_depth must be at least 1")
        limit = max_depth or max(1, int(0.25 * min(k, self.m - k)))
        now: tuple[int, ...] = ()
        while len(now) < k:
            now = (*now, self.strongest(now, self._pool(now)))
        depth = 1
        while depth <= limit:
            gained = False
            for swing in (self._down, self._up):
                after = swing(now, depth)
                if after is not None and self.score(after) > self.score(now) + TIE * max(self.score(now), TIE):
                    now, gained = after, True
            depth = 1 if gained else depth + 1
        return sorted(now)

    def _down(self, terms: tuple[int, ...], depth: int) -> tuple[int, ...] | None:
        if len(terms) < depth:
            return None
        left = self._shrink(terms, depth)
        new = self._grow(left, depth, self._pool(left))
        return (*left, *new) if len(new) == depth else None

    def _up(self, terms: tuple[int, ...], depth: int) -> tuple[int, ...] | None:
        if len(terms) + depth > self.m:
            return None
        new = self._grow(terms, depth, self._pool(terms))
        return self._shrink((*terms, *new), depth) if len(new) == depth else None
