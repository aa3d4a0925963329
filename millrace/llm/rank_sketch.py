"""Mergeable percentile sketches of relative-rank compactors.

The method is that of relative-error streaming quantiles (Cormode, Karnin, Liberty, Thaler, Vesely: "Relative Error Streaming
Quantiles", PODS 2021): a stack of buffers of which each, when full, keeps the items near the protected tail as they are and passes every other one of the rest,
with double weight, to the next level. How far a compaction reaches towards the protected tail follows a schedule
of powers of two, so the rank error shrinks in proportion to the distance from that tail.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<Bbqdddi"  # version, sign, n, min, max, k0, levels
_LEVEL = "<diqi"  # section size, sections, compactions, items
_MASK = (1 << 64) - 1

#: Standard deviations of the rank error for which the section size is chosen, and the error's standard deviation times the section size.
SIGMAS, SPREAD = 3.0, 0.131


def section_size(eps: float) -> int:
    """The section size for a rank error of ``eps`` times the distance (in ranks) from the protected tail, at three standard deviations."""
    if not 0 < eps < 1:
        raise ValueError("eps is between 0 and 1")
    return max(4, 2 * int(np.ceil(SIGMAS * SPREAD / eps / 2)))


def _coin(*state: int) -> int:
    """A fair bit that depends on the sketch's state alone, so that a task that is run again gives the same sketch."""
    z = 0x9E3779B97F4A7C15
    for s in state:
        z = ((z ^ s) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return (z >> 40) & 1


class RankSketch:
    """Percentiles of a stream of numbers. ``protect`` is the tail with the least error, ``high`` or ``low``."""

    __slots__ = ("k0", "levels", "most", "n", "least", "sign", "waiting", "room")

    def __init__(self, k: int, protect: str = "high") -> None:
        self.sign = -1 if protect == "high" else 1
        self.k0, self.n, self.least, self.most = float(k), 0, np.inf, -np.inf
        self.levels: list[list] = [[float(k), 3, 0, np.empty(0)]]
        self.waiting: list[np.ndarray] = []
        self.room = 6 * k

    def __len__(self) -> int:
        return sum(len(x[3]) for x in self.levels) + sum(map(len, self.waiting))

    def held(self) -> int:
        """About the bytes that this takes in memory, objects included."""
        return 400 + sum(250 + 8 * len(x[3]) for x in self.levels) + sum(112 + 8 * len(x) for x in self.waiting)

    def update(self, values: np.ndarray) -> None:
        """Take in values, none of them NaN."""
        if not len(values):
            return
        self.n += len(values)
        self.least, self.most = min(self.least, float(values.min())), max(self.most, float(values.max()))
        self.waiting.append(values * self.sign)
        self.room -= len(values)
        if self.room <= 0:
            self._settle()

    def _settle(self) -> None:
        self.levels[0][3] = np.concatenate([self.levels[0][3], *self.waiting])
        self.waiting = []
        h = 0
        while h < len(self.levels):
            size, sections, done, items = self.levels[h]
            k = 2 * int(round(size / 2))
            if len(items) >= 2 * sections * k:
                self._compact(h, k)
            h += 1
        size, sections, _, items = self.levels[0]
        self.room = max(1, 2 * sections * 2 * int(round(size / 2)) - len(items))

    def _compact(self, h: int, k: int) -> None:
        size, sections, done, items = self.levels[h]
        ones = 0
        while (done >> ones) & 1:
            ones += 1
        keep = sections * k + max(0, sections - ones - 1) * k
        keep += (len(items) - keep) % 2
        items.sort()
        if h + 1 == len(self.levels):
            self.levels.append([self.k0, 3, 0, np.empty(0)])
        passed = items[keep + _coin(h, done, self.n, len(items)) :: 2]
        self.levels[h + 1][3] = np.concatenate([self.levels[h + 1][3], passed])
        done += 1
        if done >= 1 << (sections - 1) and size / np.sqrt(2) >= 4:
            size, sections = size / np.sqrt(2), 2 * sections
        self.levels[h] = [size, sections, done, items[:keep].copy()]

    def merge(self, other: RankSketch) -> None:
        """Take in another sketch, of another partition or day."""
        if other.sign != self.sign or other.k0 != self.k0:
            raise ValueError("sketches of different parameters can't be merged")
        if not other.n:
            return
        self.n += other.n
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        self.waiting += other.waiting
        for h, (size, sections, done, items) in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append([self.k0, 3, 0, np.empty(0)])
            mine = self.levels[h]
            self.levels[h] = [min(mine[0], size), max(mine[1], sections), mine[2] | done, np.concatenate([mine[3], items])]
        self._settle()

    def quantiles(self, shares: list[float]) -> list[float]:
        """The value of rank ceil(share * n), 1 at least; NaN for an empty sketch."""
        if not self.n:
            return [float("nan")] * len(shares)
        items = np.concatenate([x[3] for x in self.levels] + self.waiting)
        weights = np.concatenate([np.full(len(x[3]), 1 << h, np.int64) for h, x in enumerate(self.levels)] + [np.ones(sum(map(len, self.waiting)), np.int64)])
        items = items * self.sign
        order = np.argsort(items, kind="stable")
        upto = np.cumsum(weights[order])
        at = np.searchsorted(upto, np.maximum(1, np.ceil(np.asarray(shares) * self.n - 1e-9)))
        return [self.least if s <= 0 else self.most if s >= 1 else float(items[order[min(i, len(order) - 1)]]) for s, i in zip(shares, at)]

    def to_bytes(self) -> bytes:
        if self.waiting:
            self._settle()
        head = struct.pack(_HEAD, 1, self.sign, self.n, self.least, self.most, self.k0, len(self.levels))
        parts = [head]
        for size, sections, done, items in self.levels:
            parts += [struct.pack(_LEVEL, size, sections, done, len(items)), np.ascontiguousarray(items, "<f8").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> RankSketch:
        version, sign, n, least, most, k0, count = struct.unpack_from(_HEAD, data)
        if version != 1:
            raise ValueError(f"sketch of version {version}")
        out = cls(int(k0), "high" if sign < 0 else "low")
        out.n, out.least, out.most, out.levels, at = n, least, most, [], struct.calcsize(_HEAD)
        for _ in range(count):
            size, sections, done, items = struct.unpack_from(_LEVEL, data, at)
            at += struct.calcsize(_LEVEL)
            out.levels.append([size, sections, done, np.frombuffer(data, "<f8", items, at).copy()])
            at += 8 * items
        out._settle()
        return out


class ColumnSketch:
    """The values of one group while they are few, then a :class:`RankSketch` for each protected tail.

    ``protect`` is ``high``, ``low`` or ``both``.
    """

    __slots__ = ("few", "k", "n", "protect", "stacks")
    _KIND = ("high", "low", "both")
    _START = "<BBqq"  # version, protected tail, section size, n

    def __init__(self, k: int, protect: str = "both") -> None:
        self.k, self.protect, self.n = k, protect, 0
        self.few: list[np.ndarray] = []
        self.stacks: list[RankSketch] = []

    def __len__(self) -> int:
        return sum(map(len, self.stacks)) if self.stacks else self.n

    def held(self) -> int:
        """About the bytes that this takes in memory, objects and its entry in a dictionary included."""
        return 600 + (sum(s.held() for s in self.stacks) if self.stacks else 8 * self.n + 112 * len(self.few))

    def update(self, values: np.ndarray) -> None:
        """Take in values, none of them NaN."""
        self.n += len(values)
        if not self.stacks:
            self.few.append(values)
            if len(self.few) > 16:
                self.few = [np.concatenate(self.few)]
            if self.n > 6 * self.k:
                self._open()
        else:
            for s in self.stacks:
                s.update(values)

    def _open(self) -> None:
        self.stacks = [RankSketch(self.k, t) for t in (("high", "low") if self.protect == "both" else (self.protect,))]
        if self.few:
            values = np.concatenate(self.few)
            for s in self.stacks:
                s.update(values)
        self.few = []

    def merge(self, other: ColumnSketch) -> None:
        if (other.k, other.protect) != (self.k, self.protect):
            raise ValueError("sketches of different parameters can't be merged")
        if not other.stacks:
            for values in other.few:
                self.update(values)
            return
        if not self.stacks:
            self._open()
        self.n += other.n
        for mine, its in zip(self.stacks, other.stacks):
            mine.merge(its)

    def quantiles(self, shares: list[float]) -> list[float]:
        """The values of rank ceil(share * n), 1 at least: exact while the values are few, else each from the stack that protects its side."""
        if not self.n:
            return [float("nan")] * len(shares)
        if not self.stacks:
            values = np.sort(np.concatenate(self.few))
            at = np.maximum(1, np.ceil(np.asarray(shares) * self.n - 1e-9)).astype(int)
            return values[np.minimum(at, self.n) - 1].tolist()
        high, low = self.stacks[0], self.stacks[-1]
        return [(high if s >= 0.5 else low).quantiles([s])[0] for s in shares]

    def to_bytes(self) -> bytes:
        head = struct.pack(self._START, 1, self._KIND.index(self.protect) + 4 * bool(self.stacks), self.k, self.n)
        if not self.stacks:
            return head + (np.concatenate(self.few).astype("<f8").tobytes() if self.few else b"")
        parts = [s.to_bytes() for s in self.stacks]
        return head + struct.pack("<q", len(parts[0])) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> ColumnSketch:
        version, kind, k, n = struct.unpack_from(cls._START, data)
        if version != 1:
            raise ValueError(f"sketch of version {version}")
        out, at = cls(k, cls._KIND[kind & 3]), struct.calcsize(cls._START)
        out.n = n
        if kind & 4:
            (first,) = struct.unpack_from("<q", data, at)
            cuts = [at + 8, at + 8 + first, len(data)]
            out.stacks = [RankSketch.from_bytes(data[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
        elif n:
            out.few = [np.frombuffer(data, "<f8", n, at)]
        return out
