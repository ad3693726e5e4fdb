"""Exact token ids of whole texts with a memory of words.

The two public BPE files never merge across a word boundary, so the ids of a text are those of its words in order. Most
words recur: the words of some hundred texts are found and told apart as arrays of bytes, each distinct one is looked up in the memory, and
what it lacks goes to the merges.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from operator import attrgetter

import numpy as np

#: Words kept in one generation of the memory; two generations are held, about 250 bytes a word each.
MEMORY = 200_000
#: Bytes of text whose words are found at once, about.
AT_ONCE = 2 << 20

#: Texts with other white space, control characters or the start of a special token are encoded in one piece.
_PLAIN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x85\xa0  -     　]|<\\|")

_LETTERS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+"

#: Bytes by kind: the end of a text, white space, all others.
_END, _SPACE, _OTHER = 0, 1, 2
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0] = _END
_KIND[list(b" \t\n\r")] = _SPACE
_STOP = np.zeros(256, bool)
_STOP[list(b".,")] = True
_ALNUM = np.asarray([chr(b).isalnum() and b < 128 for b in range(256)])
#: Bytes of a word that two numbers hold, and the masks for each length.
_SHORT = 16
_MASKS = np.asarray([[0xFF] * n + [0] * (_SHORT - n) for n in range(_SHORT + 1)], np.uint8).view("<u8")


def word_bounds(raw: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that bytes of 0 end, the first byte being one.

    spaced: white space goes with the word after it, else it is no word's. Full stops and commas that end a word are a word of their own where a letter or
    digit comes before them: there both files' patterns divide.
    """
    kind = _KIND[raw]
    before, after = kind[:-2], kind[2:]
    here = kind[1:-1]
    if spaced:
        start, end = (here != _END) & ((before == _END) | (before == _OTHER) & (here == _SPACE)), (here != _END) & ((after == _END) | (here == _OTHER) & (after == _SPACE))
    else:
        start, end = (here == _OTHER) & (before != _OTHER), (here == _OTHER) & (after != _OTHER)
    s, e = np.flatnonzero(start) + 1, np.flatnonzero(end) + 2
    place = np.arange(len(raw), dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
    cut = np.maximum.accumulate(np.where(_STOP[raw], 0, place))[e - 1] + 1
    last = raw[cut - 1]
    latin = (raw[cut - 2] == 0xC3) & (last != 0x97) & (last != 0xB7) & (last >= 0x80)
    split = (cut < e) & (cut > s) & (_ALNUM[last] | latin)
    return np.sort(np.append(s, cut[split])), np.sort(np.concatenate([np.where(split, cut, e), e[split]]))


def distinct(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its like, and for each number the place of a word. Words over _SHORT bytes are each their own."""
    n = e - s
    short = np.flatnonzero(n <= _SHORT)
    padded = np.concatenate([raw, np.zeros(_SHORT, np.uint8)])
    two = np.lib.stride_tricks.sliding_window_view(padded, _SHORT)[s[short]].view("<u8") & _MASKS[n[short]]
    mixed = (two[:, 0] ^ (two[:, 1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(mixed)
    two, new = two[order], np.ones(len(order), bool)
    # Told apart by all bytes: mixed values only bring equal words together.
    np.any(two[1:] != two[:-1], axis=1, out=new[1:])
    like = np.empty(len(s), np.int64)
    like[short[order]] = np.cumsum(new) - 1
    long = np.flatnonzero(n > _SHORT)
    first = short[order[new]]
    like[long] = len(first) + np.arange(len(long))
    return like, np.append(first, long)


_ID = attrgetter("id")


def _byte_letters() -> dict[int, int]:
    """Byte-level files write each byte as a letter: visible Latin-1 characters stand for themselves, the others from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in {*seen})}


class _Memory(dict):
    """Ids by word (as UTF-8). A word that is not held is taken from the generation before, else encoded."""

    def __init__(self, ids: Callable[[bytes], bytes], before: dict[bytes, bytes]) -> None:
        super().__init__()
        self.ids, self.before = ids, before

    def __missing__(self, word: bytes) -> bytes:
        out = self.before.get(word)
        if out is None:
            out = self.ids(word)
        self[word] = out
        return out


def _blocks(text: bytes) -> list[bytes]:
    """A text in blocks of about AT_ONCE bytes that begin with a space after a word: no word is divided."""
    out, at = [], 0
    while len(text) - at > 2 * AT_ONCE:
        cut = text.find(b" ", at + AT_ONCE)
        while cut > 0 and text[cut - 1] in b" \t\n\r":
            cut = text.find(b" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. path: a tokenizers file; spaces: 'dropped' or 'leading', what becomes of white space."""

    def __init__(self, path: str, spaces: str, memory: int = MEMORY) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.spaced = spaces == "leading"
        self.lower = not self.spaced  # that file's normalizer puts all in lower case
        self.plain = re.compile(f" ?{_LETTERS}").fullmatch
        self.letters = _byte_letters()
        self.words, self.most = _Memory(self._ids, {}), memory

    def _ids(self, word: bytes) -> bytes:
        """Words of Latin letters go to the merges at once, without the search for word boundaries; others to the whole tokenizer."""
        bare = word[1:] if word[0] == 32 else word
        if bare.isalpha():  # of bytes: ASCII letters alone
            if self.lower:
                bare = bare.lower()
            return self._merged(f"\u0120{bare.decode()}" if len(bare) < len(word) else bare.decode())
        text = word.decode()
        if self.plain(text):
            return self._merged((text.lower() if self.lower else text).encode().decode("latin-1").translate(self.letters))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, key: str) -> bytes:
        return array("I", map(_ID, self.merge(key))).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        out, plain = [b""] * len(texts), []
        for k, text in enumerate(texts):
            if text and _PLAIN.search(text):
                out[k] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            elif text:
                plain.append(k)
        held, size = [], 0
        for k in plain:
            for part in _blocks(texts[k].encode()):
                held.append((k, part))
                size += len(part)
                if size >= AT_ONCE:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, bytes]], out: list[bytes]) -> None:
        if held:
            for (k, _), ids in zip(held, self._plain([part for _, part in held]), strict=True):
                out[k] += ids

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) > self.most:
            self.words.before = {}
            self.words = _Memory(self._ids, self.words)
        joined = b"\0" + b"\0".join(texts) + b"\0"
        raw = np.frombuffer(joined, np.uint8)
        s, e = word_bounds(raw, self.spaced)
        like, first = distinct(raw, s, e)
        held = [self.words[joined[a:b]] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        flat, size = np.frombuffer(b"".join(held), "<u4"), np.fromiter(map(len, held), np.int64, len(held)) // 4
        n, start = size[like], (np.cumsum(size) - size)[like]
        upto = np.cumsum(n)
        ids = flat[np.repeat(start - upto + n, n) + np.arange(n.sum())]
        ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.append(0, upto)[np.searchsorted(s, np.append(0, ends), side="right")]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str, spaces: str, memory: int = MEMORY) -> Encoder:
    """One encoder a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, spaces, memory)
