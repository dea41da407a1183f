"""Byte-level BPE vocabularies: pre-tokens, and rank-synchronous merging of many sequences at once."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from tessera.llm import words

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside these blocks may be classed by another Unicode version in the library than in
#: ``regex``; texts that have any are split by the library's own pre-tokenizer.
_UNSURE = regex.compile(
    r"[^\u0000-՗ऀ-ॿ฀-๿Ḁ-₎₠-⯿　-鿿가-힣＀-￯\U0001F300-\U0001FAFF]"
)
NO_RANK = np.iinfo(np.int32).max
#: Symbols from which a sequence is merged on its own, with its pairs kept by rank.
LONG = 2048
#: Pre-tokens that a worker remembers, and the longest of them in bytes.
REMEMBERED, REMEMBERED_BYTES = 250_000, 64
#: Longer texts are worked on in stretches of about so many bytes.
STRETCH_BYTES = 4 << 20
#: Classes of characters.
_OTHER, _SPACE, _LETTER, _NUMBER, _SPECIAL = range(5)
#: Fixed value: what an apostrophe takes with it.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Ids of sequences of bytes, ragged: (ids, offsets).
Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its class, and whether the library may class it differently."""
    plain = [*range(0xD800), *range(0xE000, 0x110000)]
    every, code = "".join(map(chr, plain)), np.array(plain)
    kind, unsure = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    for c, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            kind[code[m.start() : m.end()]] = c
    unsure[code[[m.start() for m in _UNSURE.finditer(every)]]] = True
    return kind, unsure


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the byte at which each begins."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.uint32)
    size = 1 + (first >= 0xC0) + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
    point = np.where(size == 1, first, first & (0x7F >> size))
    padded = np.r_[data, np.zeros(3, np.uint8)]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        point[more] = (point[more] << 6) | (padded[lead[more] + k] & 0x3F)
    return np.minimum(point, 0x10FFFF), lead


def _token_starts(point: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the matches of ``PATTERN`` start, given each code point's class and where segments begin.

    A run of one class is a token. Of a run of spaces before something else, the last is a token of
    its own or, if it is U+0020, belongs to what follows. An apostrophe that begins a token takes an
    ending from the letters behind it.
    """
    n = len(point)
    start = begins.copy()
    start[1:] |= kind[1:] != kind[:-1]
    behind = np.flatnonzero(start & ~begins & (kind != _SPACE))
    behind = behind[kind[behind - 1] == _SPACE]
    start[behind - 1] = True
    start[behind[point[behind - 1] == 32]] = False
    mark = np.flatnonzero(point == 39)
    mark = mark[start[mark]]
    for ending in _ENDINGS:
        at = mark[mark + len(ending) < n]
        for k, c in enumerate(ending, 1):
            at = at[(point[at + k] == ord(c)) & ~begins[at + k]]
        start[at + 1] = False
        after = at + 1 + len(ending)
        start[after[after < n]] = True
    return start


def stretches(column: pa.Array, limit: int = STRETCH_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first text, texts) in turn; a text above ``limit`` bytes comes in several stretches.

    Stretches end before a space behind an ASCII character that is none, where a token always ends.
    """
    data, at = words.bytes_of(column)
    large = np.flatnonzero(np.diff(at) > limit).tolist()
    done = 0
    for i in large:
        if i > done:
            yield done, column.slice(done, i - done)
        raw, a = data[at[i] : at[i + 1]], 0
        while a < len(raw):
            b = a + limit
            while b < len(raw):
                some = raw[b - 1 : b + limit]
                cut = np.flatnonzero((some[1:] == 32) & (some[:-1] > 32) & (some[:-1] < 128))
                if len(cut):
                    b += int(cut[0])
                    break
                b += limit
            b = min(b, len(raw))
            yield i, pa.array([raw[a:b].tobytes()], pa.large_binary())
            a = b
        done = i + 1
    if done < len(column):
        yield done, column.slice(done)


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        self.path = path
        chars, vocab = _byte_chars(), model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        left, right, new = [], [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            new.append(vocab[a + b])
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        order = np.argsort(key, kind="stable")
        self._key, self._rank, self._new_of_rank = key[order], order.astype(np.int32), np.array(new, np.int32)
        special = sorted((t.encode() for t in self.specials), key=len, reverse=True)
        self._special = regex.compile(b"|".join(map(regex.escape, special))) if special else None
        self.special_id = {t.encode(): i for t, i in self.specials.items()}
        self._flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self._size = np.fromiter(map(len, self.token_bytes), np.int64, len(self.token_bytes))
        self._at = np.cumsum(self._size) - self._size
        self._library = None

    def _library_starts(self, text: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [a for _, (a, _) in self._library.pre_tokenize_str(text)]

    def pretokens(self, column: pa.Array) -> words.Words:
        """The pieces of each text that are merged on their own; special tokens stand as pieces."""
        data, at = words.bytes_of(column)
        if not len(data):
            z = np.zeros(0, np.int64)
            return words.Words(data, z, z, np.zeros(len(at), np.int64), at)
        if data.max() < 128:
            point, lead = data, np.arange(len(data))
        else:
            point, lead = _code_points(data)
        kinds, unsure = _characters()
        kind = kinds[point]
        begins = np.zeros(len(point), bool)
        text_at = np.searchsorted(lead, at)
        begins[text_at[:-1][text_at[:-1] < len(point)]] = True
        raw = data.tobytes()
        if self._special is not None and self._special.search(raw):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for m in self._special.finditer(raw, a, b):
                    x, y = np.searchsorted(lead, m.span()).tolist()
                    kind[x:y] = _SPECIAL
                    begins[x] = True
                    if y < len(point):
                        begins[y] = True
        start = _token_starts(point, kind, begins)
        if point is not data:
            edges = np.r_[np.flatnonzero(begins), len(point)]
            odd = np.unique(np.searchsorted(edges, np.flatnonzero(unsure[point]), "right")) - 1
            texts = np.searchsorted(text_at, edges[odd], "right") - 1  # a text is split by one of the two throughout
            for i in np.flatnonzero(np.isin(np.searchsorted(text_at, edges[:-1], "right") - 1, texts)).tolist():
                a, b = int(edges[i]), int(edges[i + 1])
                if kind[a] != _SPECIAL:
                    start[a:b] = False
                    end = int(lead[b]) if b < len(lead) else len(data)
                    start[a + np.array(self._library_starts(raw[lead[a] : end].decode("utf-8", "replace")), np.int64)] = True
        starts = lead[start]
        return words.Words(data, starts, np.r_[starts[1:], len(data)], np.searchsorted(starts, at), at)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self._key, key), len(self._key) - 1)
        return np.where(self._key[at] == key, self._rank[at], NO_RANK)

    def merge(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive in each byte sequence: (ids, offsets), ragged.

        All sequences are held in one array. In each round every sequence applies its own
        lowest-ranked pair wherever it stands, all sequences at once; a sequence with no known pair
        left is done and leaves the array. Sequences of ``LONG`` bytes or more go one by one, so that
        a round costs only the places that it changes.
        """
        n = len(sequences)
        sizes = np.fromiter(map(len, sequences), np.int64, n)
        if n and sizes.max() >= LONG:
            long_ = np.flatnonzero(sizes >= LONG).tolist()
            ids, offsets = self.merge([b"" if len(x) >= LONG else x for x in sequences])
            return splice(ids, offsets, long_, [self._merge_long(sequences[i]) for i in long_])
        symbol = self.byte_id[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(n), sizes)
        done_symbol: list[np.ndarray] = []
        done_owner: list[np.ndarray] = []
        rank = np.full(len(symbol), NO_RANK, np.int32)  # of the pair that starts at a place
        if len(symbol) > 1:
            inside = owner[1:] == owner[:-1]
            rank[:-1][inside] = self._ranks(symbol[:-1][inside], symbol[1:][inside])
        while len(symbol):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            width = np.diff(np.r_[first, len(owner)])
            low = np.repeat(lowest, width)
            if (lowest == NO_RANK).any():
                over = low == NO_RANK
                done_symbol.append(symbol[over])
                done_owner.append(owner[over])
                symbol, owner, rank, low = symbol[~over], owner[~over], rank[~over], low[~over]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == low)
            # In a run such as x x x, pairs overlap: every other one counts, from the left.
            new_run = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbol[at] = self._new_of_rank[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            for touched in (at, at[at > 0] - 1):
                rank[touched] = NO_RANK
                pair = touched[touched + 1 < len(symbol)]
                pair = pair[owner[pair] == owner[pair + 1]]
                rank[pair] = self._ranks(symbol[pair], symbol[pair + 1])
        if not done_symbol:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]


    def _merge_long(self, run: bytes) -> np.ndarray:
        """The symbols that survive in one sequence; places wait by the rank of the pair that starts there."""
        n = len(run)
        symbol = self.byte_id[np.frombuffer(run, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.r_[self._ranks(symbol[:-1], symbol[1:]), np.int32(NO_RANK)]
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] != NO_RANK]
            if not len(places):
                return
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            own = rank[places]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for r, a, b in zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(places[a:b])

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            new_run = np.r_[True, after[at[:-1]] != at[1:]]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            gone = after[at]
            symbol[at] = self._new_of_rank[r]
            rank[gone] = NO_RANK
            symbol[gone] = -1
            after[at] = after[gone]
            has = after[at] < n
            before[after[at[has]]] = at[has]
            touched = np.unique(np.r_[at, before[at[before[at] >= 0]]])
            rank[touched] = NO_RANK
            pair = touched[after[touched] < n]
            rank[pair] = self._ranks(symbol[pair], symbol[after[pair]])
            wait(pair)
        return symbol[symbol >= 0]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each run of ids; bytes that aren't UTF-8 are replaced."""
        size = self._size[ids]
        end = np.cumsum(size)
        flat = self._flat[np.arange(end[-1] if len(end) else 0) + np.repeat(self._at[ids] - end + size, size)]
        cut = np.r_[0, end][offsets]
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(flat)])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            raw = flat.tobytes()
            texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.large_string())
        return texts


def splice(ids: np.ndarray, offsets: np.ndarray, rows: list[int], runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ragged (ids, offsets) with ``runs`` in the places of the empty ``rows``."""
    if not rows:
        return ids, offsets
    size = np.diff(offsets)
    size[rows] = list(map(len, runs))
    parts, at = [], 0
    for i, run in zip(rows, runs, strict=True):
        parts += [ids[at : offsets[i]], np.asarray(run, np.int32)]
        at = offsets[i]
    return np.concatenate([*parts, ids[at:]]), np.r_[0, np.cumsum(size)]


class Memory:
    """Encoded pre-tokens that a worker has met, by their 64-bit numbers, in arrays.

    It holds ``REMEMBERED`` short pre-tokens at most and starts anew beyond that, which only affects
    speed. Pre-tokens with equal numbers are taken as equal.
    """

    def __init__(self, vocabulary: ByteBpe, encode: Encode | None = None):
        self.vocabulary, self.encode = vocabulary, encode or vocabulary.merge
        # A special token with a space might lie across the end of a stretch.
        self.limit = 1 << 62 if any(" " in t for t in vocabulary.specials) else STRETCH_BYTES
        self._clear()

    def _clear(self) -> None:
        self.number, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _encoded(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        own = self.vocabulary.special_id
        rows = [i for i, x in enumerate(sequences) if x in own]
        ids, offsets = self.encode([b"" if x in own else x for x in sequences])
        return splice(ids, offsets, rows, [np.array([own[sequences[i]]], np.int32) for i in rows])

    def look_up(self, w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, where each pre-token's ids begin in it, how many they are)."""
        coded = pa.array(words.numbers(w)).dictionary_encode()
        number, of = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        some = np.empty(len(number), np.int64)
        some[of[::-1]] = np.arange(len(of))[::-1]  # the first of each
        at = np.searchsorted(self.number, number)
        known = np.zeros(len(number), bool)
        inside = at < len(self.number)
        known[inside] = self.number[at[inside]] == number[inside]
        new = np.flatnonzero(~known)
        begin, size = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        begin[known], size[known] = self.begin[at[known]], self.size[at[known]]
        pool = self.pool
        if len(new):
            raw = w.data.tobytes()
            ids, offsets = self._encoded([raw[a:b] for a, b in zip(w.starts[some[new]].tolist(), w.ends[some[new]].tolist(), strict=True)])
            begin[new], size[new] = offsets[:-1] + len(pool), np.diff(offsets)
            pool = np.r_[pool, ids]
            self._remember(number[new], w.ends[some[new]] - w.starts[some[new]], ids, offsets)
        return pool, begin[of], size[of]

    def _remember(self, number: np.ndarray, n_bytes: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        if len(self.number) + len(number) > REMEMBERED:
            self._clear()
        short = np.flatnonzero(n_bytes <= REMEMBERED_BYTES)[:REMEMBERED]
        size = np.diff(offsets)[short]
        pool = gathered(ids, offsets[:-1][short], size)
        number = np.r_[self.number, number[short]]
        order = np.argsort(number, kind="stable")
        self.number = number[order]
        self.begin = np.r_[self.begin, np.cumsum(size) - size + len(self.pool)][order]
        self.size = np.r_[self.size, size][order]
        self.pool = np.r_[self.pool, pool]

    def counts(self, column: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(column), np.int64)
        for first, some in stretches(column, self.limit):
            w = self.vocabulary.pretokens(some)
            total = np.r_[0, np.cumsum(self.look_up(w)[2])]
            out[first : first + len(some)] += np.diff(total[w.first])
        return out

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of each text, ragged."""
        out, sizes = [np.zeros(0, np.int32)], np.zeros(len(column), np.int64)
        for first, some in stretches(column, self.limit):
            w = self.vocabulary.pretokens(some)
            pool, begin, size = self.look_up(w)
            out.append(gathered(pool, begin, size))
            sizes[first : first + len(some)] += np.diff(np.r_[0, np.cumsum(size)][w.first])
        return np.concatenate(out), np.r_[0, np.cumsum(sizes)]


def gathered(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` that begin at ``begin``, one behind the other."""
    end = np.cumsum(size)
    return pool[np.arange(end[-1] if len(end) else 0) + np.repeat(begin - end + size, size)]


@lru_cache(maxsize=2)
def load(tokenizer: str) -> ByteBpe:
    """``tokenizer``: a path, or the name of a file of the public tokenizers as the worker has them."""
    if not os.path.isabs(tokenizer):
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return ByteBpe(tokenizer)

