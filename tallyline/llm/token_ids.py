"""Token ids by the tokenizers library, with a memory for words already seen.

A byte-level BPE splits a text before it merges, and never merges across a place
where white space follows something else. A text can therefore be cut at all such
places: the ids of the parts, put together, are the ids of the text. Parts repeat
a lot, so each task keeps the ids of the parts it has met, and the library encodes
only new ones. Parts that split in an evident way (Latin letters, then ASCII
punctuation) go to the library's model as pieces, many in one call; all others
through its whole chain. When the memory is full, parts met once are dropped, which
changes nothing but time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

#: Unicode White_Space, as the library's pattern takes \\s.
WHITE = "\t-\r \x85\xa0  -     　"
PART = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
                   "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
MEMORY = 700_000  # parts
GROUP = 1 << 19  # characters handled at a time
#: White space but space and line feed.
RARE = tuple(sorted(_WHITE - {" ", "\n"}))
DOUBLE = ("  ", " \n", "\n ", "\n\n")
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
MARKS = "!-&(-/:-@\\[-`{-~"
#: The key of a part that splits in an evident way: after a line feed or a space or
#: nothing, Latin letters (to U+024F), then ASCII punctuation without the apostrophe.
EVIDENT = re.compile(f"[\n ]?[{LATIN}]+[{MARKS}]*").fullmatch
#: The places inside such a part where pieces meet.
MEET = re.compile(f"(?<=\n)(?=[{LATIN}])|(?<=[{LATIN}])(?=[{MARKS}])")


def key_of(part: str) -> str:
    """The key a part is remembered by: a leading single space is dropped, or put
    where there is no white space. Splitting a text at single spaces then gives keys."""
    if part[0] not in _WHITE:
        return " " + part
    return part[1:] if part[0] == " " and len(part) > 1 and part[1] not in _WHITE else part


def part_of(key: str) -> str:
    """The part of a key (the rule of ``key_of`` is its own inverse)."""
    return key_of(key)


def keys_in(text: str) -> list[str]:
    """The keys of the parts of a text, in order."""
    if not text:
        return []
    if (text[0] in _WHITE or text[-1] in _WHITE or any(c in text for c in RARE)
            or any(c in text for c in DOUBLE)):
        return [key_of(p) for p in PART.findall(text)]
    keys = text.replace("\n", " \n").split(" ")
    keys[0] = " " + keys[0]
    return keys


def byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable
    Latin-1 stands for itself, the others count up from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in shown)
    return {**{b: b for b in shown}, **{b: 256 + k for k, b in enumerate(others)}}


class PartEncoder:
    """Encodes texts with the tokenizer file at ``path``; texts are plain text,
    also where they spell a special token."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memory = memory
        # the model alone takes pieces that are split and written as byte letters
        self.pieces = Tokenizer(self.tokenizer.model)
        self.letters = {b: c for b, c in byte_letters().items() if b != 0}
        vocabulary = self.pieces.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.lengths[number] = len(token)
        setup = json.loads(self.tokenizer.to_str())
        split = setup["pre_tokenizer"] or {}
        self.splits_known = (split.get("type") == "ByteLevel" and split.get("use_regex")
                             and not split.get("add_prefix_space") and setup["normalizer"] is None)
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.sizes = np.zeros(1 << 14, dtype=np.int32)
        self.uses = np.zeros(1 << 14, dtype=np.int64)

    def _forget_rare(self) -> None:
        """Forget the parts that were met once, or more where over half the memory would stay."""
        uses = self.uses[:len(self.place)]
        least = 2
        while np.count_nonzero(uses >= least) > self.memory // 2:
            least *= 2
        kept = np.flatnonzero(uses >= least)
        keys, sizes, ids = list(self.place), self.sizes[kept], self._of_places(kept)[0]
        self._forget()
        self._keep([keys[i] for i in kept.tolist()], ids, sizes)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        grown = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
        grown[:len(array)] = array
        return grown

    def _keep(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the ids of ``keys``, which lie one after another in ``ids``."""
        at, n = len(self.place), len(keys)
        self.pool = self._room(self.pool, self.used + len(ids))
        self.starts, self.sizes = self._room(self.starts, at + n), self._room(self.sizes, at + n)
        self.uses = self._room(self.uses, at + n)
        self.pool[self.used:self.used + len(ids)] = ids
        self.starts[at:at + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at:at + n] = sizes
        self.place.update(zip(keys, range(at, at + n)))
        self.used += len(ids)

    def _learn(self, keys: list[str]) -> None:
        """Encode new keys: evident ones as pieces in one call, the others one by one."""
        plain, others = [], keys
        if self.splits_known:
            evident = list(map(EVIDENT, keys))
            plain = [k for k, m in zip(keys, evident) if m]
            others = [k for k, m in zip(keys, evident) if not m]
        if plain:
            # NUL sets parts and pieces apart while all are written as byte letters
            # an evident key starts with a space (its part has none) or not (its part has one)
            joined = "\0".join([k[1:] if k[0] == " " else k if k[0] == "\n" else " " + k for k in plain])
            sizes = [len(raw) for raw in joined.encode().split(b"\0")]
            shown = MEET.sub("\0", joined).encode().decode("latin-1").translate(self.letters).split("\0")
            made = self.pieces.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(made[0].ids, dtype=np.uint32)
            # an id stands for as many bytes as its token has letters
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1
            if ends[-1] != len(ids):
                raise ValueError("the vocabulary does not write every byte")
            self._keep(plain, ids, np.diff(ends, prepend=0))
        if others:
            found = [self._ids(part_of(key)) for key in others]
            self._keep(others, np.array([i for f in found for i in f], dtype=np.uint32),
                       np.array([len(f) for f in found], dtype=np.int64))

    def _of_places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts at these places, and where those of each end."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        # places in the pool of a group of texts: 32 bits hold them but for very long texts
        kind = np.int32 if max(self.used, int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
        take = np.repeat((self.starts[at] - (ends - sizes)).astype(kind), sizes)
        take += np.arange(len(take), dtype=kind)
        return self.pool[take], ends

    def _of_keys(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys' parts, and where the ids of each part end."""
        at = np.fromiter(map(self.place.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = dict.fromkeys(keys[i] for i in missing.tolist())
            if len(self.place) + len(new) > self.memory:
                self._forget_rare()
                at = np.fromiter(map(self.place.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
                missing = np.flatnonzero(at < 0)
                new = dict.fromkeys(keys[i] for i in missing.tolist())
            self._learn(list(new))
            at[missing] = list(map(self.place.__getitem__, map(keys.__getitem__, missing.tolist())))
        n = len(self.place)
        self.uses[:n] += np.bincount(at, minlength=n)
        return self._of_places(at)

    def _of_group(self, texts: list[str]) -> Iterator[np.ndarray]:
        lists = [keys_in(t) for t in texts]
        keys = list(chain.from_iterable(lists))
        if not keys:
            yield from (np.zeros(0, np.uint32) for _ in texts)
            return
        ids, ends = self._of_keys(keys)
        last = np.concatenate([[0], ends])[np.cumsum([len(found) for found in lists])]
        start = 0
        for end in last.tolist():
            yield ids[start:end]
            start = end

    def _of_long(self, text: str) -> np.ndarray:
        found, held, size = [], [], 0
        for match in PART.finditer(text):
            held.append(key_of(match.group()))
            size += len(held[-1])
            if size >= GROUP:
                found.append(self._of_keys(held)[0])
                held, size = [], 0
        if held:
            found.append(self._of_keys(held)[0])
        return np.concatenate(found)

    def many(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of every whole text as unsigned 32-bit numbers, in order."""
        held, size = [], 0
        for text in texts:
            if len(text) > GROUP:
                yield from self._of_group(held)
                yield self._of_long(text)
                held, size = [], 0
                continue
            held.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._of_group(held)
                held, size = [], 0
        yield from self._of_group(held)

    def __call__(self, text: str) -> np.ndarray:
        return next(self.many([text]))


@lru_cache(maxsize=2)
def encoder(path: str) -> PartEncoder:
    """One encoder per worker process and tokenizer file."""
    return PartEncoder(path)
