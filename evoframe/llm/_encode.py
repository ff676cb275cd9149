"""Tokenizing whole texts with the tokenizers library, words met often only once.

Texts are cut in front of runs of ASCII white space, and between letters and signs. No
pre-token of the two supported tokenizers crosses such a place, so the ids of a text are
the ids of its parts in order. Parts are found, told apart and put together with numpy, all
texts of a slice at once; new ones are encoded many to a call, with a sign between them
that has an id of its own. Texts with other white space or with a special token are encoded
in one call. What a worker keeps of parts met before is bounded.
"""

from __future__ import annotations

import os
import re

import numpy as np

from evoframe.llm._words import hash_spans

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts and ids that a worker remembers at most: about 40 MB.
MOST_PARTS, MOST_IDS = 500_000, 3 << 20

_OTHER_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
_ENCODERS: dict[tuple[str, bool], "WordEncoder"] = {}

# Kinds of bytes; the last stands between texts.
_OTHER, _SPACE, _LETTER, _SIGN, _EDGE = range(5)
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t\n\r")] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = _SIGN
_KIND[0x0B] = _EDGE
_GAP = {_SPACE, _EDGE}
#: By the kinds of two neighbours: does the second start a part, does the first end one?
_STARTS = np.array([b not in _GAP and (a in _GAP or {a, b} == {_LETTER, _SIGN}) for a in range(5) for b in range(5)])
_ENDS = np.array([a not in _GAP and (b in _GAP or {a, b} == {_LETTER, _SIGN}) for a in range(5) for b in range(5)])
# What stands in front of a part: nothing, one space, a line's end, or more; then the part takes it in.
_BARE, _SPACED, _LINE, _RUN = range(4)
_SEEDS = np.array([1, 2, 1, 3], np.uint64) << np.uint64(32)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PartTable:
    """Ids of parts by two hashes: sorted keys in two levels, the ids in one pool."""

    def __init__(self):
        none = np.zeros(0, np.uint64)
        self.levels = [(none, none, np.zeros(0, np.int64)) for _ in range(2)]  # key, check, number
        self.offset, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers of parts, -1 for unknown ones; ``key`` is sorted."""
        out = np.full(len(key), -1, np.int64)
        for keys, checks, numbers in self.levels:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[at] == key) & (checks[at] == check)
                out[hit] = numbers[at[hit]]
        return out

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
        """The numbers of new parts."""
        count = np.array([len(x) for x in ids], np.int64)
        numbers = len(self.count) + np.arange(len(ids))
        self.offset = np.append(self.offset, len(self.pool) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.pool = np.concatenate([self.pool, *ids])
        low = self._joined(self.levels[1], (key, check, numbers))
        if len(low[0]) > max(1 << 16, len(self.levels[0][0]) // 8):
            low, self.levels[0] = tuple(x[:0] for x in low), self._joined(self.levels[0], low)
        self.levels[1] = low
        return numbers

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)


class WordEncoder:
    """Unsigned 32-bit ids of texts.

    ``word_ends``: the tokenizer drops white space and case; else it is byte-level, and
    a space in front of a word is a part of it.
    """

    def __init__(self, path: str, word_ends: bool, most_parts: int = MOST_PARTS, most_ids: int = MOST_IDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word_ends, self.most_parts, self.most_ids = word_ends, most_parts, most_ids
        self.sign, self.between = ("\x01", " \x01 ") if word_ends else ("\n", "\n")
        sign = self._ids(self.sign)
        self.sign_id = int(sign[0]) if len(sign) == 1 else None
        self.line_end = self._ids("\n")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = PartTable()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learned(self, parts: list[str]) -> list[np.ndarray]:
        """The ids of parts without white space, but for one space in front."""
        out: list[np.ndarray] = []
        for at in range(0, len(parts), 512):
            some = parts[at : at + 512]
            ids = self._ids(self.between.join(some))
            cuts = np.flatnonzero(ids == self.sign_id) if self.sign_id is not None else ()
            if len(cuts) != len(some) - 1:  # a part has the sign in it
                out += map(self._ids, some)
                continue
            edges, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            out += [ids[a:b] for a, b in zip(edges, ends)]
        return out

    def _numbers(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The number of each part in the table, after new ones have been learned."""
        key = hash_spans(raw, starts, ends) ^ _SEEDS[kind]
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        check = hash_spans(raw, starts[first], ends[first], 7) ^ _SEEDS[kind[first]]
        if len(self.table.count) + len(key) > self.most_parts or len(self.table.pool) > self.most_ids:
            known, old = self.table.find(key, check), self.table
            kept, self.table = known[known >= 0], PartTable()  # the parts in use now
            ids = [old.pool[o : o + n] for o, n in zip(old.offset[kept].tolist(), old.count[kept].tolist())]
            self.table.add(key[known >= 0], check[known >= 0], ids)
        numbers = self.table.find(key, check)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            at = first[new]
            spans = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            run = kind[at] == _RUN
            lead = np.where(kind[at] == _SPACED, " ", "").tolist()
            plain = np.flatnonzero(~run).tolist()
            ids: list = [None] * len(new)
            for i, found in zip(plain, self._learned([lead[i] + spans[i] for i in plain])):
                ids[i] = found
            for i in np.flatnonzero(run).tolist():
                ids[i] = self._ids(spans[i])
            numbers[new] = self.table.add(key[new], check[new], ids)
        return numbers[inverse]

    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts that end in no white space."""
        raw = b"\x0b" + b"\x0b".join(texts) + b"\x0b"
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        data = np.frombuffer(raw, np.uint8)
        kinds = _KIND[data]
        two = np.flatnonzero(data[:-1] == 0xC3)  # letters of Latin-1; the signs among them are times and division
        two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
        kinds[two] = kinds[two + 1] = _LETTER
        pairs = kinds[:-1] * np.uint8(5) + kinds[1:]
        starts, ends = np.flatnonzero(_STARTS[pairs]) + 1, np.flatnonzero(_ENDS[pairs]) + 1
        own = np.searchsorted(begins, starts, side="right") - 1
        if self.word_ends:
            kind = np.zeros(len(starts), np.int64)
        else:
            front = np.maximum(np.append(0, ends[:-1]), begins[own]) if len(starts) else starts
            gap, before = starts - front, data[starts - 1]
            kind = np.where(gap == 0, _BARE, np.where((gap == 1) & (before == 0x20), _SPACED, np.where((gap == 1) & (before == 0x0A), _LINE, _RUN)))
            starts = np.where(kind == _RUN, front, starts)
        number = self._numbers(raw, starts, ends, kind)
        table, line = self.table, (kind == _LINE) * len(self.line_end)
        count = table.count[number]
        whole = count + line
        place = np.cumsum(whole) - whole
        flat = np.empty(int(whole.sum()), np.uint32)
        steps = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        flat[np.repeat(place + line, count) + steps] = table.pool[np.repeat(table.offset[number], count) + steps]
        for k, value in enumerate(self.line_end.tolist()):
            flat[place[kind == _LINE] + k] = value
        bounds = np.searchsorted(own, np.arange(1, len(texts)))
        return np.split(flat, np.append(place, len(flat))[bounds])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(texts)
        usual, cores, tails = [], [], []
        for i, text in enumerate(texts):
            if _OTHER_SPACE.search(text) or any(s in text for s in self.special):
                out[i] = self._ids(text)
                continue
            core = text.rstrip(" \t\n\r")
            usual.append(i)
            cores.append(core.encode())
            tails.append("" if self.word_ends else text[len(core) :])
        for i, ids, tail in zip(usual, self._together(cores) if cores else (), tails):
            out[i] = np.append(ids, self._ids(tail)) if tail else ids
        return out


def encoder(path: str, word_ends: bool) -> WordEncoder:
    """The worker's encoder for this file; built once and reused by later tasks. One is kept."""
    if (path, word_ends) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, word_ends] = WordEncoder(path, word_ends)
    return _ENCODERS[path, word_ends]
