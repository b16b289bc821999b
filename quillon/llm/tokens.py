"""Token ids of whole columns of texts by the tokenizers library.

Both public vocabularies split a text before they merge, and no split part holds
white space behind another character. So a text may be cut where their split
patterns part it for certain: before a single space and around a single line end
between two other characters, and before a closing punctuation mark behind an
ASCII letter. Places next to white space of other alphabets are not cut. Texts
that hold a special token's string are not cut at all, as the library looks for
those before anything else.

The parts of a run of texts tile its bytes, so they make an Arrow array without a
copy, whose dictionary has each different part once. A table of the parts seen so
far answers for most of these. Of the others, Latin letters alone (with the space
before them) are one split part, which the library's merge model takes at once; the
rest goes through the whole tokenizer. The ids of the run are then gathered by
NumPy, without a Python object a word. The table stops growing at KEPT parts; parts
beyond are encoded once a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .words import text_chunks

KEPT = 300_000
#: Longer parts don't go into the table.
ALONE = 64
#: Bytes of text that are encoded at once; a longer text is encoded alone.
CHUNK = 4 << 20
#: Rows with a text that a worker gets at once.
ROWS = 1000

_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?")] = True
#: Leading bytes of the three-byte forms of white space, and the second bytes of these.
_LEAD, _SECOND = np.zeros(256, bool), np.zeros(256, bool)
_LEAD[[0xE1, 0xE2, 0xE3]] = True
_SECOND[[0x80, 0x81, 0x9A]] = True
#: Latin letters, which both normal forms and lower-casing leave letter by letter; the dotted capital I excepted.
_LATIN_END, _DOTTED = "ɐ", "İ"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte (fixed by their format)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _at(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Bytes at places, 0 outside."""
    return np.where((places >= 0) & (places < len(raw)), raw[np.clip(places, 0, len(raw) - 1)], 0)


def _solid_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is surely no white space."""
    one = _at(raw, at - 1)
    ok = _ASCII[one]
    wide = np.flatnonzero(one >= 0x80)
    one, two, three = one[wide], _at(raw, at[wide] - 2), _at(raw, at[wide] - 3)
    ok[wide] = ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) & ~(_LEAD[three] & _SECOND[two])
    return ok


def _solid_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character at each place is surely no white space."""
    one = _at(raw, at)
    ok = _ASCII[one]
    wide = np.flatnonzero(one >= 0x80)
    one, two = one[wide], _at(raw, at[wide] + 1)
    ok[wide] = ~((one == 0xC2) & ((two == 0x85) | (two == 0xA0))) & ~(_LEAD[one] & _SECOND[two])
    return ok


def _cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Marks of the places inside the texts where a part begins."""
    border = np.zeros(len(raw) + 2, bool)
    border[off] = True
    gap = np.flatnonzero((raw == 32) | (raw == 10))
    gap = gap[~border[gap] & ~border[gap + 1]]
    gap = gap[_solid_before(raw, gap)]
    gap = gap[_solid_at(raw, gap + 1)]
    closing = np.flatnonzero(_CLOSING[raw[1:]] & _LETTER[raw[:-1]]) + 1
    mark = np.zeros(len(raw) + 1, bool)
    mark[gap] = True
    mark[gap[raw[gap] == 10] + 1] = True
    mark[closing] = True
    mark[off] = False
    return mark


class Encoder:
    """The library's ids (``add_special_tokens=False``) of a vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merge = self._tokenizer.model.tokenize
        # a vocabulary that drops spaces lower-cases and brings letters to normal form C
        self._space = bool(self._tokenizer.encode(" a", add_special_tokens=False).ids != self._tokenizer.encode("a", add_special_tokens=False).ids)
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[bytes, int] = {}
        self._store = np.zeros(1 << 18, np.uint32)
        self._begin = np.zeros(1 << 16, np.int64)  # of part k in the store; the next one's is its end
        self._parts = 0

    def _add(self, parts: list[bytes]) -> int:
        """Puts the ids of new parts behind the others, and returns the number of the first."""
        first, ids, other = self._parts, [], []
        for k, part in enumerate(parts):
            text = part.decode()
            core = text[1:] if text[:1] == " " else text
            if core.isalpha() and _LATIN_END > max(core) and _DOTTED not in core:
                letters = part if self._space else core.lower().encode()
                ids.append([t.id for t in self._merge(letters.decode("latin-1").translate(_LETTERS))])
            else:
                ids.append(None)
                other.append((k, text))
        for a in range(0, len(other), 4096):
            made = self._tokenizer.encode_batch_fast([text for _, text in other[a : a + 4096]], add_special_tokens=False)
            for (k, _), x in zip(other[a : a + 4096], made, strict=True):
                ids[k] = x.ids
        ends = self._begin[first] + np.cumsum([len(x) for x in ids])
        while len(self._begin) < first + len(parts) + 1:
            self._begin = np.concatenate([self._begin, np.zeros(len(self._begin), np.int64)])
        while len(self._store) < ends[-1]:
            self._store = np.concatenate([self._store, np.zeros(len(self._store), np.uint32)])
        self._store[self._begin[first] : ends[-1]] = [i for x in ids for i in x]
        self._begin[first + 1 : first + 1 + len(parts)] = ends
        self._parts = first + len(parts)
        return first

    def _numbers(self, parts: list[bytes]) -> tuple[np.ndarray, int]:
        """Each part's number in the store, and how many parts stay in it."""
        known = self._known
        numbers = np.array([known.get(p, -1) for p in parts], np.int64)
        new = np.flatnonzero(numbers < 0)
        if not len(new):
            return numbers, self._parts
        short = np.array([len(parts[k]) <= ALONE for k in new])
        new = np.concatenate([new[short][: max(0, KEPT - len(known))], new[short][max(0, KEPT - len(known)) :], new[~short]])
        stay = min(int(short.sum()), max(0, KEPT - len(known)))
        first = self._add([parts[k] for k in new])
        numbers[new] = np.arange(first, first + len(new))
        known.update((parts[k], first + i) for i, k in enumerate(new[:stay].tolist()))
        return numbers, first + stay

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids of these rows, each row's begin in them with the end). A null text is an empty one."""
        for first, end, raw, off in text_chunks(texts, CHUNK):
            if not len(raw):
                yield first, end, np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
                continue
            mark = _cuts(raw, off)
            self._keep_specials(raw, off, mark)
            mark[off[:-1][off[1:] > off[:-1]]] = True
            starts = np.flatnonzero(mark)
            offsets = np.append(starts, len(raw)).astype(np.int32)
            array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
            numbers, stay = self._numbers(array.dictionary.to_pylist())
            number = numbers[array.indices.to_numpy()]
            begin, size = self._begin[number], self._begin[number + 1] - self._begin[number]
            ends = np.cumsum(size)
            ids = self._store[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
            self._parts = stay
            yield first, end, ids, np.append(0, ends)[np.searchsorted(starts, off)]
        pa.default_memory_pool().release_unused()  # a worker lives on, and so would what the dictionaries took

    def _keep_specials(self, raw: np.ndarray, off: np.ndarray, mark: np.ndarray) -> None:
        """Takes the marks out of texts that hold a special token's string."""
        for token in self._special:
            tail = np.frombuffer(token[-2:], np.uint8)
            for e in np.flatnonzero((raw[:-1] == tail[0]) & (raw[1:] == tail[1])) + 2:
                if raw[max(0, e - len(token)) : e].tobytes() == token:
                    row = int(np.searchsorted(off, e - 1, side="right")) - 1
                    mark[off[row] : off[row + 1]] = False

    def encode(self, text: str | None) -> np.ndarray:
        return np.concatenate([ids for _, _, ids, _ in self.column(pa.array([text], pa.string()))])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
