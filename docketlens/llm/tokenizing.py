"""Exact, cached use of the tokenizers library inside Python workers.

Both public vocabularies split a text at white space before any merge, so a
text's ids are those of its chunks in turn.  Texts are cut into chunks and
looked up by numpy, a piece of about ``PIECE_BYTES`` at a time: a chunk of up
to 16 bytes is two 64-bit numbers, which a hash table of fixed size maps to its
ids.  Only chunks that the table does not hold (new, evicted or longer ones)
reach the library.  When table or pool are full, the chunks met in the most
pieces stay.  So a worker's memory is bounded whatever it reads,
by ``SLOTS`` and ``POOL_IDS`` and by the longest run without a single space.
Texts for which chunking is not provably exact (rare white space, strings of
special tokens) go to the library whole.
"""

from __future__ import annotations

import re

import numpy as np

#: Slots of the table (23 bytes each), ids that its pool holds (4 bytes each), and bytes of text looked up at once.
SLOTS, POOL_IDS, PIECE_BYTES = 1 << 20, 1 << 22, 1 << 19
#: The table is thinned out when this share of it is taken.
FULL = 0.6

_RARE = re.compile("[\x00\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|<\\|")
_CONTROL = re.compile("[\x00\x1c-\x1f]|<\\|")
_LONE_SPACE = re.compile(rb"[^ \t\n\r\x0b\f] (?=[^ \t\n\r\x0b\f])")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: By length, what two little-endian 64-bit numbers keep of 16 bytes.
_MASKS = np.array([[(1 << 8 * min(n, 8)) - 1, (1 << 8 * max(n - 8, 0)) - 1] for n in range(17)], np.uint64)


def is_rare(text: str) -> bool:
    """Whether chunks might not add up to the library's ids."""
    return bool((_CONTROL if text.isascii() else _RARE).search(text))


class ChunkTable:
    """Chunks of up to 16 bytes (two numbers) -> ids; of fixed size, two slots a chunk."""

    def __init__(self, slots: int = SLOTS, pool_ids: int = POOL_IDS):
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.first, self.count = np.zeros(slots, np.int32), np.zeros(slots, np.uint16)
        self.met = np.zeros(slots, np.uint8)  # pieces that held the chunk after its first, up to 250
        self.pool, self.used, self.taken = np.zeros(pool_ids, np.uint32), 0, 0

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * _K1 ^ (high * _K2)
        return (((h ^ (h >> np.uint64(32))) * _K3) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each chunk, -1 where the table does not hold it."""
        at = self.slots(low, high)
        missing = np.flatnonzero((self.low[at] != low) | (self.high[at] != high))
        other = at[missing] ^ 1
        at[missing] = np.where((self.low[other] == low[missing]) & (self.high[other] == high[missing]), other, -1)
        hit = at[at >= 0]
        self.met[hit] = np.minimum(self.met[hit], 249) + 1
        return at

    def thin(self) -> None:
        """Keep the chunks met in the most pieces, about half of what fits; halve what was counted."""
        held = self.low != 0
        at_least = np.cumsum(np.bincount(self.met[held], minlength=256)[::-1])[::-1]
        ids_at_least = np.cumsum(np.bincount(self.met[held], self.count[held], minlength=256)[::-1])[::-1]
        fits = (at_least <= len(held) * FULL / 2) & (ids_at_least <= len(self.pool) / 2)
        keep = held & (self.met >= (int(np.argmax(fits)) if fits.any() else 256))
        at = np.flatnonzero(keep)
        n = self.count[at].astype(np.int64)
        ids = self.pool[ranges(self.first[at].astype(np.int64), n)]
        self.low[~keep] = 0
        self.high[~keep] = 0
        self.met //= 2
        self.pool[: len(ids)] = ids
        self.first[at] = np.cumsum(n) - n
        self.used, self.taken = len(ids), len(at)

    def room(self, n_ids: int, chunks: int) -> bool:
        return self.used + n_ids <= len(self.pool) and self.taken + chunks <= FULL * len(self.low)

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """New chunks and their ids, ``n`` each.  A chunk takes its empty slot or that of the chunk met less often."""
        at = self.slots(low, high)
        cost = lambda k: np.where(self.low[k] == 0, -1, self.met[k].astype(np.int64))
        at = np.where(cost(at ^ 1) < cost(at), at ^ 1, at)
        at, which = np.unique(at, return_index=True)  # of chunks for one slot one stays
        self.taken += int((self.low[at] == 0).sum())
        first = np.cumsum(n) - n + self.used
        self.low[at], self.high[at], self.first[at], self.count[at], self.met[at] = low[which], high[which], first[which], n[which], 0
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then those of first[1], ..."""
    before = np.cumsum(n) - n
    return np.repeat(first - before, n) + np.arange(int(n.sum()))


class ChunkTokenizer:
    """``arrays(texts)`` gives each text's ids."""

    def __init__(self, path: str, slots: int = SLOTS, pool_ids: int = POOL_IDS, piece_bytes: int = PIECE_BYTES):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        # Byte-level vocabularies keep white space (a space goes with the word after it);
        # the word vocabulary drops it.
        self.keeps_space = (told.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.lowers = "Lowercase" in json.dumps(told.get("normalizer"))  # then ASCII may be lowered before the look-up
        self.table, self.piece_bytes = ChunkTable(slots, pool_ids), piece_bytes
        self.vocab_size = self.library.get_vocab_size()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encoded(self, chunks: list[str], at_once: int = 48) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all chunks, and how many each has; a call takes many chunks, as words of one text."""
        ids, n = [], []
        for k in range(0, len(chunks), at_once):
            some = chunks[k : k + at_once]
            e = self.library.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            n.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(n)

    def _chunks(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks of a piece begin and end; a zero byte separates texts."""
        word = ~_BLANK[a]
        word &= a != 0
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        begin, end = edges[::2], edges[1::2]
        if not self.keeps_space:
            return begin, end
        begin = begin - (a[begin - 1] == 32)
        # Runs of white space other than the space before a word: all but the last character
        # of a run before a word, and that character if it is no space; a run at the end whole.
        blank = _BLANK[a]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        first, last = edges[::2], edges[1::2]
        before_word = word[last]
        odd = ~before_word | (last - first > 1) | (a[first] != 32)
        if not odd.any():
            return begin, end
        first, last, before_word = first[odd], last[odd], before_word[odd]
        core = last - before_word
        run = core > first
        tail = before_word & (a[last - 1] != 32)
        begin = np.concatenate([begin, first[run], last[tail] - 1])
        end = np.concatenate([end, core[run], last[tail]])
        order = np.argsort(begin, kind="stable")
        return begin[order], end[order]

    def _piece(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of some texts without rare characters."""
        data = b"\x00" + b"\x00".join(texts) + b"\x00"
        if self.lowers:
            data = data.lower()
        a = np.frombuffer(data + bytes(16), np.uint8)
        begin, end = self._chunks(a[: len(data)])
        size, table = end - begin, self.table
        short = np.flatnonzero(size <= 16)
        keys = np.lib.stride_tricks.as_strided(a, (len(data), 16), (1, 1))[begin[short]].view("<u8") & _MASKS[size[short]]
        low, high = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])
        at = np.full(len(size), -1, np.int64)
        at[short] = table.find(low, high)
        held = at >= 0
        first, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        first[held], count[held] = table.first[at[held]], table.count[at[held]]
        pool = table.pool[: table.used]
        missing = np.flatnonzero(~held)
        if len(missing):
            places: dict[bytes, int] = {}
            which = [places.setdefault(data[i:j], len(places)) for i, j in zip(begin[missing].tolist(), end[missing].tolist(), strict=True)]
            new = list(places)
            ids, n = self._encoded([c.decode() for c in new])
            which = np.array(which)
            first[missing], count[missing] = (np.cumsum(n) - n + len(pool))[which], n[which]
            pool = np.concatenate([pool, ids])
        total = np.concatenate([[0], np.cumsum(count)])
        out = pool[ranges(first, count)]
        if len(missing):
            self._learn(new, ids, n)
        bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
        cuts = total[np.searchsorted(begin, bounds)]
        return [out[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _learn(self, chunks: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        some = np.flatnonzero(np.array([len(c) <= 16 for c in chunks]) & (n < 1 << 16))
        ids = ids[ranges((np.cumsum(n) - n)[some], n[some])]
        if not self.table.room(len(ids), len(some)):
            self.table.thin()
        if len(some) and self.table.room(len(ids), len(some)):
            keys = np.frombuffer(b"".join(chunks[i].ljust(16, b"\x00") for i in some.tolist()), "<u8").reshape(-1, 2)
            self.table.add(keys[:, 0].copy(), keys[:, 1].copy(), ids, n[some])

    def _parts(self, text: bytes) -> list[bytes]:
        """A text in parts of about a piece, cut before single spaces between words."""
        out, at = [], 0
        while len(text) - at > 2 * self.piece_bytes:
            m = _LONE_SPACE.search(text, at + self.piece_bytes)
            if not m:
                break
            out.append(text[at : m.start() + 1])
            at = m.start() + 1
        return [*out, text[at:]]

    def arrays(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit integers; null counts as empty."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        parts: list[tuple[int, bytes]] = []
        for i, t in enumerate(texts):
            if t and is_rare(t):
                out[i] = self._whole(t)
            elif t:
                data = t.encode("utf-8", "surrogatepass")
                parts += [(i, p) for p in self._parts(data)] if len(data) > 2 * self.piece_bytes else [(i, data)]
        held, n, found = [], 0, {}
        for k, (i, p) in enumerate(parts):
            held.append((i, p))
            n += len(p)
            if n >= self.piece_bytes or k == len(parts) - 1:
                for (j, _), ids in zip(held, self._piece([x for _, x in held]), strict=True):
                    found.setdefault(j, []).append(ids)
                held, n = [], 0
        for i, ids in found.items():
            out[i] = ids[0] if len(ids) == 1 else np.concatenate(ids)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return [ids.astype("<u4").tobytes() for ids in self.arrays(texts)]


_LOADED: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """This worker's tokenizer for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file of the installed ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path(name)
