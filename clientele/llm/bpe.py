"""Byte-level BPE of many texts at once.

Borders between the pre-tokens of a batch and their hashes are found in numpy.
Each distinct pre-token is encoded once and kept in a bounded cache; the ids of
the batch are then gathered. The ids equal those of the `tokenizers` library.
"""

from __future__ import annotations

from array import array

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from clientele.llm.textscan import batches, span_hashes

CACHE_WORDS = 200_000                 # distinct pre-tokens kept by a worker
BATCH = 1 << 20                       # characters encoded together
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    for plane in range(0, 0x110000, 0x10000):
        chars = "".join(map(chr, (c for c in range(plane, plane + 0x10000) if not 0xD800 <= c < 0xE000)))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, chars):
                table[ord(m[0][0]):ord(m[0][-1]) + 1] = kind
    return table


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: a byte that is
    printable stands for itself, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairs:
    """`ordinary`: names of special tokens inside a text are ordinary text. Otherwise
    they become their ids, as the library does by default."""

    def __init__(self, path: str, ordinary: bool = False):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = ordinary
        self.specials = [] if ordinary else [t.content for t in self.library.get_added_tokens_decoder().values()]
        alphabet = _byte_alphabet()
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {bytes(alphabet[c] for c in token): i
                 for token, i in self.library.get_vocab().items() if token not in added}
        # A pre-token is encoded as it is; the pattern keeps it whole.
        self.pairs = tiktoken.Encoding("pairs", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat, self.offsets = array("I"), array("q", [0])

    def encode(self, texts: list[str]):
        """Yields an array of ids (uint32) for each text, in order."""
        for start, stop in batches([len(t) for t in texts], BATCH):
            yield from self._encode(texts[start:stop])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        plain = [("" if i in odd else t) for i, t in enumerate(texts)]
        ids, bounds = self._ids(plain)
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in odd:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = self._starts(points, borders)
        ends = np.append(starts[1:], len(points))
        distinct, first, inverse = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        if len(self.slots) > CACHE_WORDS:
            self._forget()
        known = self.slots
        slots = [known.get(h, -1) for h in distinct.tolist()]
        for k, slot in enumerate(slots):
            if slot < 0:
                at = first[k]
                slots[k] = known[int(distinct[k])] = len(known)
                self.flat.extend(self.pairs.encode_ordinary(joined[starts[at]:ends[at]]))
                self.offsets.append(len(self.flat))
        offsets = np.array(self.offsets, np.int64)
        slot = np.array(slots, np.int64)[inverse]
        begin, count = offsets[slot], offsets[slot + 1] - offsets[slot]
        done = np.concatenate([[0], np.cumsum(count)])
        take = np.repeat(begin - done[:-1], count) + np.arange(done[-1])
        return np.array(self.flat, np.uint32)[take], done[np.searchsorted(starts, borders)]

    def _starts(self, points: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """First characters of the pre-tokens: runs of letters, of numbers or of other
        signs, with one space before them; other white space; English contractions."""
        n = len(points)
        kind = np.append(self.classes[points], np.uint8(255))
        text_start = np.zeros(n + 1, bool)
        text_start[borders] = True
        start = text_start.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last white space before a run leaves its own run; a space joins what follows.
        after = np.flatnonzero(start[:n] & ~text_start[:n] & (kind[:n] != _SPACE))
        after = after[kind[after - 1] == _SPACE]
        start[after - 1] = True
        start[after[points[after - 1] == 32]] = False
        # The contractions 's 't 'm 'd 're 've 'll.
        quote = np.flatnonzero((points == 39) & start[:n])
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        inside = ~np.append(text_start, [True, True])
        one, two = padded[quote + 1], padded[quote + 2]
        short = inside[quote + 1] & np.isin(one, [115, 116, 109, 100])
        long = inside[quote + 1] & inside[quote + 2] & (
            ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        start[quote[short] + 1] = start[quote[long] + 1] = False
        start[quote[short] + 2] = start[quote[long] + 3] = True
        return np.flatnonzero(start[:n])


_loaded: dict[tuple[str, bool], BytePairs] = {}


def byte_pairs(path: str, ordinary: bool = False) -> BytePairs:
    """The tokenizer of this worker; read once."""
    if (path, ordinary) not in _loaded:
        _loaded[path, ordinary] = BytePairs(path, ordinary)
    return _loaded[path, ordinary]
