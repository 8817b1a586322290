"""Pre-tokenised encoding with a cache of chunks.

The byte-level pattern (contractions, runs of letters, of digits and of other signs,
each with an optional space before it, and white space) never lets a pre-token cross
the place before a space that stands between two characters that are not white space.
So a text may be cut there, each chunk encoded on its own, and each distinct chunk
once.  For the same reason letters and the signs after them are encoded apart, and a
text may be cut before a newline that follows what is not white space, as long as the
white space that it starts is cut nowhere else than at its last character.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r"(?<=\S) (?=\S)")
SIGNS = ".,;:!?#%&*$|)\"'-+(=@"
#: Bytes of remembered chunks and their ids; what one entry takes beside its text.
MEMO_BYTES, ENTRY_BYTES = 48 << 20, 200
#: Marks of a chunk: white space after the space before it, white space at its end, a newline
#: alone, white space after the newline that it starts with (or an added token there or at its start).
START, END, LONE, INSIDE = 1, 2, 4, 8
#: Distinct chunks that are encoded as one text.
JOINED = 200


def chunks(text: str) -> list:
    """Pieces of the text that the pattern splits independently: a str stands for a space
    and that str, a tuple for the str in it as it is (the start of the text)."""
    out = CUT.split(text)
    if out[0]:
        out[0] = (out[0],)
    else:
        del out[0]
    return out


def _form(key) -> str:
    """What a chunk's key stands for: one that starts with a newline has no space before it."""
    return key[0] if type(key) is tuple else key if key.startswith("\n") else " " + key


def _words(names: pa.StringArray) -> list[str]:
    """The strings, none of which holds a space."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(names)], names), " ")[0].as_py().split(" ")


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenated runs starts[i] .. starts[i] + lengths[i]."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Index(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self):
        self.new = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class ChunkEncoder:
    """Encodes texts chunk by chunk; ``encode`` maps a list of str to lists of ids.

    With ``sizes`` (the bytes of each id's token) many chunks are encoded as one text, and
    its ids are dealt out by their bytes.  ``added`` are strings that ``encode`` takes out of
    a text before it splits the rest.  Chunks are kept between calls up to about
    ``limit`` bytes; beyond that only those that came again are kept on, the most frequent
    first and up to half of it, which costs time and never changes a result."""

    def __init__(self, encode, sizes: np.ndarray | None = None, limit: int = MEMO_BYTES, added: tuple[str, ...] = ()):
        self.encode, self.sizes, self.limit, self.added = encode, sizes, limit, added
        # an added token that starts with a letter may reach from letters into signs
        self.plain = not any(t[0].isalpha() for t in added)
        self._clear()

    def _clear(self):
        self.index, self.held = _Index(), 0
        # of each chunk: where its ids are, its marks, how often it came
        self.start, self.length, self.edge, self.uses = (np.zeros(0, t) for t in (np.int64, np.int64, np.int8, np.int64))
        self.ids = np.zeros(0, np.uint32)

    def _shrink(self):
        """Keeps chunks that came more than once, by number of uses, in half of the limit."""
        names, bytes_of = list(self.index), np.zeros(len(self.index), np.int64)
        bytes_of[:] = [ENTRY_BYTES + len(k if type(k) is str else k[0]) for k in names]
        bytes_of += 4 * self.length
        order = np.argsort(-self.uses, kind="stable")
        order = order[(self.uses[order] > 1) & (np.cumsum(bytes_of[order]) <= self.limit // 2)]
        start, length, edge, uses, ids = self.start[order], self.length[order], self.edge[order], self.uses[order], self.ids
        self._clear()
        for i in order.tolist():
            self.index[names[i]] = len(self.index)
        self.ids = ids[gather(start, length)]
        self.start, self.length, self.edge, self.uses = np.cumsum(length) - length, length, edge, uses // 2
        self.held = int(bytes_of[order].sum())

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (a list of str or an Arrow array, without nulls), one after
        another, and each text's number of ids."""
        if self.held > self.limit:
            self._shrink()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # between two spaces or newlines; where that is beside more white space, the text is cut anew
        at, sizes = self._parts(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "))
        edge = self.edge[at]
        if edge.any():
            ends = np.cumsum(sizes)
            last = ends[sizes > 0] - 1
            edge[last] &= ~np.int8(END)  # white space at a text's end has no space after it
            lone = edge & LONE > 0
            lone[last] = False
            bad = edge & (START | END) > 0
            bad[:-1] |= lone[:-1] & (edge[1:] & (START | LONE | INSIDE) > 0)
            again = np.unique(np.searchsorted(ends, np.flatnonzero(bad), side="right"))
            if len(again):
                own = [chunks(texts[i].as_py()) for i in again.tolist()]
                found = self._numbers(list(chain.from_iterable(own)))
                made = np.split(found, np.cumsum([len(x) for x in own])[:-1])
                kept, upto = [], 0
                for i, new in zip(again.tolist(), made, strict=True):
                    kept += [at[upto : ends[i] - sizes[i]], new]
                    upto, sizes[i] = ends[i], len(new)
                at = np.concatenate([*kept, at[upto:]])
        self.uses += np.bincount(at, minlength=len(self.uses))
        lengths = self.length[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[gather(self.start[at], lengths)], np.diff(upto[np.concatenate([[0], np.cumsum(sizes)])])

    def _parts(self, parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of texts, with signs after letters apart, and each text's
        number of them.  The first part of a text has nothing before it, and is none if it is
        empty."""
        offsets, flat = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        offsets = offsets - offsets[0]
        codes, names = flat.indices.to_numpy(), _words(flat.dictionary)
        stems = pc.utf8_rtrim(flat.dictionary, SIGNS)
        signs = pc.subtract(pc.binary_length(flat.dictionary), pc.binary_length(stems)).to_numpy()
        rest = np.ones(len(codes), bool)
        rest[offsets[:-1]] = False
        used = np.bincount(codes[rest], minlength=len(names)) > 0
        letters = used & self.plain & pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False)
        numbers, after = np.zeros(len(names), np.int64), np.full(len(names), -1)
        own = np.flatnonzero(used & ~letters)
        numbers[own] = self._numbers([names[i] for i in own.tolist()])
        if letters.any():
            stems = stems.filter(pa.array(letters)).dictionary_encode()
            numbers[letters] = self._numbers(_words(stems.dictionary), True)[stems.indices.to_numpy()]
            own = np.flatnonzero(letters & (signs > 0))
            after[own] = self._numbers([(names[i][-n:],) for i, n in zip(own.tolist(), signs[own].tolist(), strict=True)])
        at, after = numbers[codes], after[codes]
        starts = [names[i] for i in codes[offsets[:-1]].tolist()]
        full = np.fromiter(map(bool, starts), bool, len(starts))
        at[offsets[:-1][full]], after[offsets[:-1]] = self._numbers([(x,) for x in starts if x]), -1
        many = 1 + (after >= 0)
        many[offsets[:-1]] = full
        ends = np.cumsum(many)
        at = np.repeat(at, many)
        at[ends[many == 2] - 1] = after[many == 2]
        return at, np.diff(np.concatenate([[0], ends])[offsets])

    def _numbers(self, keys: list, letters: bool = False) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        if self.index.new:
            self._learn(letters)
        return at

    def _learn(self, letters: bool):
        """Encodes the new chunks; with ``letters`` they all are a space and letters."""
        index, first = self.index, len(self.start)
        # words have no white space at their ends; others are encoded one by one
        words, others, numbers, other_numbers, pairs, bad = [], [], [], [], [], []
        if letters:
            words, numbers = [" " + k for k in index.new], list(range(first, first + len(index.new)))
        for n, key in enumerate(() if letters else index.new, first):  # grows: the parts of a pair are keys too
            if type(key) is str:
                glued = key.startswith("\n")
                body = key[1:] if glued else key
                inside = INSIDE * body.startswith(self.added)
                if inside:
                    bad.append((n, inside))
                stem = key.rstrip(SIGNS)
                if self.plain and (stem[1:] if glued else stem).isalpha():
                    if stem is key:
                        words.append(_form(key))
                        numbers.append(n)
                    else:
                        pairs.append((n, index[stem], index[(key[len(stem) :],)]))
                    continue
                if body and body.strip() is body:
                    words.append(_form(key))
                    numbers.append(n)
                    continue
                # an empty chunk is one of two spaces
                if not glued:
                    bad.append((n, inside | START * (not key or key[0].isspace()) | END * key[-1:].isspace()))
                else:
                    bad.append((n, inside | INSIDE * body[0].isspace() | END * body[-1].isspace() if body else LONE))
            elif key[0][-1:].isspace():  # the start of a text has nothing before it
                bad.append((n, END))
            others.append(_form(key))
            other_numbers.append(n)
        more = len(index.new)
        index.new.clear()
        grown = [np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.start, self.length, self.edge, self.uses)]
        self.start, self.length, self.edge, self.uses = grown
        if bad:
            at, edges = np.array(bad, np.int64).T
            self.edge[at] = edges
        made, lengths, size = self._encoded(words, others)
        at = np.array(numbers + other_numbers, np.int64)
        self.start[at], self.length[at] = len(self.ids) + np.cumsum(lengths) - lengths, lengths
        self.ids = np.concatenate([self.ids, made])
        if pairs:
            own, left, right = np.array(pairs, np.int64).T
            both = np.stack([left, right], 1).ravel()
            joined = self.ids[gather(self.start[both], self.length[both])]
            sizes = self.length[left] + self.length[right]
            self.start[own], self.length[own] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
            self.ids = np.concatenate([self.ids, joined])
        self.held += more * ENTRY_BYTES + size + 4 * len(made)

    def _encoded(self, words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """The ids of the words and then of the other chunks, one after another, each one's
        number of ids, and their bytes."""
        ids, lengths, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        if self.sizes is None:
            others = words + others
        elif words:
            # a word starts with a space or a newline and is cut off from what follows it
            made = self.encode(["".join(words[j : j + JOINED]) for j in range(0, len(words), JOINED)])
            ids.append(np.fromiter(chain.from_iterable(made), np.uint32, sum(map(len, made))))
            upto = np.cumsum(self.sizes[ids[-1]])
            ends = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy(), dtype=np.int64)
            cut = np.searchsorted(upto, ends)
            if cut[-1] >= len(upto) or (upto[cut] != ends).any():
                raise ValueError("a token crosses two chunks")
            lengths.append(np.diff(cut, prepend=-1))
            size = int(ends[-1])
        rest = self.encode(others)
        lengths.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        ids.append(np.fromiter(chain.from_iterable(rest), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths), size + sum(map(len, others))
