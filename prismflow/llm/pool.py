"""A bounded memo of encoded pieces with vectorised assembly of id sequences."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable
from types import ModuleType

import numpy as np


def kept_in_worker(key: str, make: Callable):
    """The object made for ``key`` earlier in this Python worker, or a new one.

    Functions reach workers by value, so their own globals do not outlive a task. Only bounded objects belong here.
    """
    store = sys.modules.setdefault("prismflow worker store", ModuleType("prismflow worker store"))
    if key not in store.__dict__:
        store.__dict__[key] = make()
    return store.__dict__[key]


def file_digest(path: str) -> str:
    """Names a file by its content, so that a changed file is not taken for the old one."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


class _Index(dict):
    """Numbers pieces as they are first asked for and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, piece) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class Pool:
    """Ids of every distinct piece seen; ``encode`` maps a list of new pieces to flat ids and the length of each.

    The memo is emptied once it holds ``limit`` pieces, so its memory does not follow the corpus.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self) -> None:
        pieces = self.index.new
        self.index.new = []
        flat, sizes = self.encode(pieces)
        n = len(pieces)
        first = len(self.index) - n
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while first + n > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.used += len(flat)

    def __call__(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``pieces`` one after another, and the number of ids of each piece."""
        if len(self.index) > self.limit:
            self._clear()
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if self.index.new:
            self._add()
        size = self.size[at]
        total = int(size.sum())
        where = np.arange(total) + np.repeat(self.start[at] - np.cumsum(size) + size, size)
        return self.flat[where], size
