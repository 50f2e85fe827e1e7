"""Token ids of batches of texts, by a public byte-level BPE vocabulary.

Byte-level BPE splits a text into pieces (words with the space before them, numbers, runs of marks and
of white space) that are merged independently. The pieces of a batch are found and hashed as arrays;
each distinct one is encoded by the tokenizer once per worker and then looked up, so the result equals
encoding the whole text. Texts with characters whose class the byte tables do not know go to the
tokenizer whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import CHUNK_BYTES, chunks
from .kernels import U64, span_hashes

LETTER, DIGIT, SPACE, MARK, UNKNOWN = range(5)


def _classes() -> np.ndarray:
    """The class of each byte; of lead bytes, that of the characters they begin, where these are all alike."""
    c = np.full(256, UNKNOWN, np.uint8)
    c[:128] = MARK
    c[[9, 10, 11, 12, 13, 32]] = SPACE
    c[48:58] = DIGIT
    c[65:91] = c[97:123] = LETTER
    c[0xC3:0xCA] = LETTER  # U+00C0 to U+024F, but for two signs
    return c


_CLASS = _classes()
#: Classes of U+00A1 to U+00BF by their second byte; U+0080 to U+00A0 are unknown.
_LATIN_1 = np.full(256, UNKNOWN, np.uint8)
_LATIN_1[0xA1:0xC0] = MARK
_LATIN_1[[0xAA, 0xB5, 0xBA]] = LETTER
_LATIN_1[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
#: Third bytes of U+2010 to U+2027 and U+2030 to U+203E: dashes, quotes, dots and other marks.
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[0x90:0xA8] = _PUNCTUATION[0xB0:0xBF] = True
_APOSTROPHE = 39
#: Bytes of text that are split at once.
SPLIT_BYTES = 2 * CHUNK_BYTES


def _shown_bytes() -> dict[int, str]:
    """Byte-level BPE writes each byte as a character: printable ones of Latin-1 as themselves, the others from U+0100 on."""
    hidden = [*range(33), *range(127, 161), 173]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_SHOWN = _shown_bytes()



def _next(x: np.ndarray, n: int = 1) -> np.ndarray:
    return np.concatenate([x[n:], np.zeros(min(n, len(x)), x.dtype)])


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character each byte belongs to."""
    c = _CLASS[data]
    if not (data & 0x80).any():
        return c
    second, third = _next(data), _next(data, 2)
    c2 = np.flatnonzero(data == 0xC2)
    c[c2] = _LATIN_1[second[c2]]
    c[(data == 0xC3) & ((second == 0x97) | (second == 0xB7))] = MARK
    e2 = np.flatnonzero(data == 0xE2)
    c[e2[((second[e2] == 0x80) & _PUNCTUATION[third[e2]]) | ((second[e2] == 0x82) & (third[e2] == 0xAC))]] = MARK
    follows = np.flatnonzero((data & 0xC0) == 0x80)
    for at in (follows, follows[(data[follows - 1] & 0xC0) == 0x80]):  # second bytes, then third ones
        c[at] = c[at - 1]
    return c


def piece_starts(data: np.ndarray, classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of rows begin; the rows hold no unknown characters and the last byte of a row is at offsets[i + 1] - 1."""
    n = len(data)
    start = np.ones(n + 1, bool)
    start[1:n] = classes[1:] != classes[:-1]
    starts_row = offsets[:-1][np.diff(offsets) > 0]
    start[starts_row] = True
    last = np.zeros(n, bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    # the last of a run of white space leaves the run where a word or mark follows, and a space joins it
    space = classes == SPACE
    leaves = np.flatnonzero(space[:-1] & ~space[1:] & ~last[:-1])
    start[leaves] = True
    start[leaves[data[leaves] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll are pieces where one begins at the apostrophe
    at = np.flatnonzero((data == _APOSTROPHE) & start[:n] & ~last)
    if len(at):
        one = data[at + 1]
        two = np.where(last[at + 1], 0, _next(data)[at + 1])
        single = np.isin(one, [ord(x) for x in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[at[single | double] + 1] = False
        start[at[single] + 2] = True
        start[at[double] + 3] = True
    return np.flatnonzero(start[:n])


class BatchEncoder:
    """Ids of batches of texts. Known pieces are kept as arrays: sorted hashes, and where their ids stand.

    `entries` bounds the pieces that are kept before the table starts anew, and so its memory (some 25
    bytes each); pieces longer than `longest` bytes are not kept. Pieces are told apart by 64-bit hashes
    of their bytes and lengths.
    """

    def __init__(self, path: str, entries: int = 1_000_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.entries, self.longest, self._merge = entries, longest, self.tokenizer.model.tokenize
        self._empty()

    def _empty(self) -> None:
        self.hashes, self.places, self.counts = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        """The ids of one text, by the tokenizer alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The ids of pieces, and how many each has."""
        ids: list[int] = []
        counts = []
        for piece in pieces:
            made = self._merge(piece.decode("latin-1").translate(_SHOWN))
            counts.append(len(made))
            ids += [t.id for t in made]
        return np.array(ids, np.uint32), counts

    def _add(self, ids: np.ndarray) -> None:
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), end - len(self.ids)), np.uint32)])
        self.ids[self.used : end] = ids
        self.used = end

    def _of_pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in a row, and how many each piece has."""
        ends = np.append(starts[1:], len(data))
        found, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, found)
        inside = at < len(self.hashes)
        known = np.zeros(len(found), bool)
        known[inside] = self.hashes[at[inside]] == found[inside]
        places, counts = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        places[known], counts[known] = self.places[at[known]], self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = starts[first[new]], ends[first[new]]
            new = new[np.argsort(b - a > self.longest, kind="stable")]  # short ones first, which are kept
            a, b = starts[first[new]], ends[first[new]]
            raw = data.tobytes()
            ids, counts[new] = self._encoded([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            places[new] = self.used + np.cumsum(counts[new]) - counts[new]
            short = b - a <= self.longest
            kept = self.used + int(counts[new[short]].sum())
            self._add(ids)
            new = np.sort(new[short])
            where = np.searchsorted(self.hashes, found[new])
            self.hashes = np.insert(self.hashes, where, found[new])
            self.places = np.insert(self.places, where, places[new])
            self.counts = np.insert(self.counts, where, counts[new].astype(np.int32))
        n = counts[back]
        ends_of = np.cumsum(n)
        total = int(ends_of[-1]) if len(n) else 0
        out = self.ids[np.repeat(places[back] - (ends_of - n), n) + np.arange(total)]
        if not known.all():
            self.used = kept  # the ids of long pieces make way
        if len(self.hashes) > self.entries:
            self._empty()
        return out, n

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row of UTF-8 bytes, in order."""
        for a, b in chunks(offsets, SPLIT_BYTES):
            part = offsets[a : b + 1]
            if b - a == 1 and part[1] - part[0] > 2 * SPLIT_BYTES:
                yield self._long(data[part[0] : part[1]])
            else:
                yield from self._chunk(data[part[0] : part[-1]], part - part[0])

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        classes = byte_classes(data)
        odd = np.flatnonzero(classes == UNKNOWN)
        apart = set(np.unique(np.searchsorted(offsets, odd, "right") - 1).tolist())
        if not apart:
            yield from self._plain(data, classes, offsets)
            return
        mask = np.ones(len(offsets) - 1, bool)
        mask[list(apart)] = False
        sizes = np.where(mask, np.diff(offsets), 0)
        bytes_ = np.repeat(mask, np.diff(offsets))
        plain = self._plain(data[bytes_], classes[bytes_], np.concatenate([[0], np.cumsum(sizes)]))
        for i, ids in enumerate(plain):
            yield self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()) if i in apart else ids

    def _plain(self, data: np.ndarray, classes: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        starts = piece_starts(data, classes, offsets) if len(data) else np.empty(0, np.int64)
        ids, n = self._of_pieces(data, starts) if len(starts) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offsets)]
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield ids[x:y]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """A long text in parts that begin at a space between two letters or digits: a piece begins there whatever stands around."""
        raw, parts, at = data.tobytes(), [], 0
        while at < len(raw):
            end = at + SPLIT_BYTES
            while end < len(raw):
                end = raw.find(b" ", end)
                if end < 0 or end + 1 >= len(raw):
                    end = len(raw)
                elif raw[end - 1 : end].isalnum() and raw[end + 1 : end + 2].isalnum():
                    break
                else:
                    end += 1
            part = data[at : min(end, len(raw))]
            parts += self._chunk(part, np.array([0, len(part)]))
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


_encoders: dict[str, BatchEncoder] = {}


def encoder_of(path: str, entries: int) -> BatchEncoder:
    """The encoder that this worker process keeps from task to task."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    _encoders[path].entries = entries
    return _encoders[path]
