"""Counts over the words, lines and characters of texts, a slice at a time."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from tidemark.llm import text as X

_LINE_END = np.zeros(256, bool)
_LINE_END[0x0A] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_START = np.ones(256, bool)  # bytes that begin a code point
_START[0x80:0xC0] = False
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a"):ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Statistics:
    """Each property is an array with one figure per row; they are computed when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n_rows = data, offsets, len(offsets) - 1

    def take(self, rows: np.ndarray) -> Statistics:
        """The same for some rows only."""
        sizes = np.diff(self.offsets)[rows]
        parts = [self.data[a:b] for a, b in zip(self.offsets[rows], self.offsets[rows + 1], strict=True)]
        return Statistics(np.concatenate([np.zeros(0, np.uint8), *parts]), np.concatenate([[0], np.cumsum(sizes)]))

    def _bytes(self, table: np.ndarray) -> np.ndarray:
        return _row_sums(table[self.data], self.offsets)

    def _in_rows(self, names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each name's group, sizes of the groups); names of different rows never share one."""
        _, which, sizes = np.unique(X.mix(names ^ X.mix(rows.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
        return which, sizes

    @cached_property
    def words(self) -> X.Words:
        return X.Words(self.data, self.offsets)

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.words.hashes()

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @cached_property
    def word_chars(self) -> np.ndarray:
        return _row_sums(_START[self.data] & ~X._SPACE[self.data], self.offsets)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._bytes(_SYMBOL)

    @cached_property
    def n_digits(self) -> np.ndarray:
        return self._bytes(_DIGIT)

    def n_of(self, character: str) -> np.ndarray:
        """Occurrences of one ASCII character."""
        return _row_sums(self.data == ord(character), self.offsets)

    @cached_property
    def _latin(self) -> np.ndarray:
        """Second bytes of Latin-1 letters."""
        second = np.zeros(len(self.data), bool)
        second[1:] = self.data[:-1] == 0xC3
        return second & (self.data != 0x97) & (self.data != 0xB7)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return _row_sums(_UPPER[self.data] | (self._latin & (self.data < 0x9F)), self.offsets)

    @cached_property
    def n_letters(self) -> np.ndarray:
        """ASCII and Latin-1 letters."""
        return _row_sums(_UPPER[self.data] | _LOWER[self.data] | self._latin, self.offsets)

    @cached_property
    def lines(self) -> X.Words:
        """Lines that are not empty, as words of another kind."""
        return X.Words(self.data, self.offsets, _LINE_END)

    @cached_property
    def _full_lines(self) -> np.ndarray:
        lines, begins = self.lines, self.words.starts
        return np.searchsorted(begins, lines.ends) > np.searchsorted(begins, lines.starts)

    @cached_property
    def n_lines(self) -> np.ndarray:
        """Lines with a word."""
        return np.bincount(self.lines.rows()[self._full_lines], minlength=self.n_rows)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the row."""
        rows, full = self.lines.rows(), self._full_lines
        names, rows = self.lines.hashes()[full], rows[full]
        _, first = np.unique(X.mix(names ^ X.mix(rows.astype(np.uint64) + np.uint64(1))), return_index=True)
        return np.bincount(rows, minlength=self.n_rows) - np.bincount(rows[first], minlength=self.n_rows)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in three-word windows that occur twice or more in the row, the first one included."""
        starts, rows = self.words.window_starts(3), self.words.rows()
        which, sizes = self._in_rows(X.window_hash(self.hashes, starts, 3), rows[starts])
        covered = np.zeros(len(rows), bool)
        again = starts[sizes[which] > 1]
        for k in range(3):
            covered[again + k] = True
        return np.bincount(rows[covered], minlength=self.n_rows)

    @cached_property
    def _word_groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, size) of each distinct word of each row."""
        rows = self.words.rows()
        which, sizes = self._in_rows(self.hashes, rows)
        owner = np.zeros(len(sizes), np.int64)
        owner[which] = rows
        return owner, sizes

    @cached_property
    def n_distinct_words(self) -> np.ndarray:
        return np.bincount(self._word_groups[0], minlength=self.n_rows)

    @cached_property
    def n_top_word(self) -> np.ndarray:
        """Occurrences of the row's most frequent word."""
        top = np.zeros(self.n_rows, np.int64)
        np.maximum.at(top, *self._word_groups)
        return top
