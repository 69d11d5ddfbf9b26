"""Exact encoding with a word-level BPE vocabulary of the tokenizers library, whole Arrow batches at a time.

The vocabulary drops white space before its merges, so a text cut at white space encodes to the joined encodings of
its pieces. A batch is handled as one byte array: bytes are lower-cased and classed, cut into the runs that the
vocabulary's pattern gives, equal runs are merged once, and ids are gathered back into text order. Pieces with
anything beyond plain ASCII and Latin-1 letters go through the library itself.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa

#: Bytes of text handled together; longer texts are cut at white space, so memory stays bounded.
SLAB = 5_000_000
#: Bytes of a run that is merged here; longer ones go through the library, whose merges do not slow down with length.
LONGEST = 400
#: The rank of pairs that do not merge.
_NONE = 1 << 30
_BLANK, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the
    remaining bytes take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _classes() -> np.ndarray:
    kinds = np.full(256, _ODD, np.uint8)
    kinds[33:127] = _OTHER
    kinds[list(b" \t\n\x0b\x0c\r")] = _BLANK
    kinds[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
    kinds[list(b"0123456789")] = _DIGIT
    kinds[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
    kinds[ord("'")] = _ODD  # contractions
    return kinds


_KINDS = _classes()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every span, joined."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class PairRanks:
    """Ranks of merge pairs, looked up for whole arrays: open addressing with a bounded number of probes."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int64)
        at, left, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            spot = (at[left] + self.probes - 1) & self.mask
            _, first = np.unique(spot, return_index=True)
            put = first[self.slots[spot[first]] < 0]
            self.slots[spot[put]], self.ranks[spot[put]] = keys[left[put]], left[put]
            left = np.delete(left, put)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            spot = (at[open_] + step) & self.mask
            held = self.slots[spot]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[spot[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out


class WordBPE:
    """Ids of texts, equal to the library's with add_special_tokens=False, without truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix")
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if not suffix or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a word-level BPE vocabulary with an end-of-word suffix is needed")
        self.size = max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.tokens = [self.library.id_to_token(i) or "" for i in range(self.size)]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.ranks = PairRanks(np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of many runs at once: in every round each unfinished run merges its best pair. Ids and their counts."""
        ends = np.cumsum(sizes) - 1
        ids = self.inner[data]
        ids[ends] = self.final[data[ends]]
        out, alive = ids.copy(), np.ones(len(ids), bool)
        rank = np.full(len(ids), _NONE, np.int64)
        rank[:-1] = self.ranks(ids[:-1] << 32 | ids[1:])
        rank[ends] = _NONE  # the last of a run has no right neighbour
        starts, place = ends + 1 - sizes, np.arange(len(ids))
        while len(ids):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            going = best >> 32 < _NONE
            widths = np.diff(np.r_[starts, len(ids)])
            best, at = best[going], best[going] & 0xFFFFFFFF
            new = self.merged[best >> 32]
            ids[at] = out[place[at]] = new
            alive[place[at + 1]] = False
            more = np.flatnonzero(at + 2 < len(ids))
            nxt = np.full(len(at), _NONE, np.int64)
            nxt[more] = self.ranks(new[more] << 32 | ids[at[more] + 2])
            run_end = np.zeros(len(ids) + 1, bool)
            run_end[starts[1:] - 1] = run_end[len(ids) - 1] = True
            nxt[run_end[at + 1]] = _NONE
            rank[at] = nxt
            back = np.flatnonzero((at > 0) & ~run_end[at - 1])
            rank[at[back] - 1] = self.ranks(ids[at[back] - 1] << 32 | new[back])
            keep = np.repeat(going, widths)
            keep[at + 1] = False
            ids, rank, place = ids[keep], rank[keep], place[keep]
            widths = widths[going] - 1
            starts = np.cumsum(widths) - widths
        return out[alive], np.add.reduceat(alive.astype(np.int64), ends + 1 - sizes) if len(sizes) else sizes

    def _slab(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a byte array, and the number of ids before each edge (byte positions that no run may cross)."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        size = len(raw)
        low = np.zeros(size + 16, np.uint8)
        low[:size] = _LOWER[raw]
        kind = _KINDS[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        if len(lead):
            second = raw[lead + 1]
            latin = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
            lead, second = lead[latin], second[latin]
            kind[lead] = kind[lead + 1] = _LETTER
            low[lead[second < 0x9F] + 1] += 32
        kind[np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))] = _ODD  # marks of special tokens
        change = np.zeros(size + 1, bool)
        change[0] = True
        change[edges] = True
        change = change[:-1]
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):  # the whole piece between white space goes through the library
            walls = np.r_[np.flatnonzero((kind == _BLANK) | change), size]
            right = np.searchsorted(walls, odd, "right")
            begin = walls[right - 1]
            begin = begin + (kind[begin] == _BLANK)
            begin, one = np.unique(begin, return_index=True)
            inside = spans(begin, walls[right][one] - begin)
            kind[inside], low[inside] = _ODD, raw[inside]
        change[1:] |= kind[1:] != kind[:-1]
        change |= kind == _DIGIT
        starts = np.flatnonzero(change)
        sizes = np.diff(np.r_[starts, size])
        keep = kind[starts] != _BLANK
        starts, sizes = starts[keep], sizes[keep]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        odd_run = (kind[starts] == _ODD) | (sizes > LONGEST)
        one, same = self._equal(low, starts, sizes, odd_run)
        plain = np.flatnonzero(~odd_run[one])
        ids, counts = self.merge(low[spans(starts[one[plain]], sizes[one[plain]])], sizes[one[plain]])
        at = np.zeros(len(one), np.int64)
        count = np.zeros(len(one), np.int64)
        at[plain], count[plain] = np.cumsum(counts) - counts, counts
        extra, n = [ids.astype(np.uint32)], len(ids)
        for u in np.flatnonzero(odd_run[one]):
            a = starts[one[u]]
            text = raw[a : a + sizes[one[u]]].tobytes().decode()
            got = self.library.encode(text, add_special_tokens=False).ids
            extra.append(np.array(got, np.uint32))
            at[u], count[u] = n, len(got)
            n += len(got)
        of = count[same]
        out = np.concatenate(extra)[spans(at[same], of)]
        return out, np.r_[0, np.cumsum(of)][np.searchsorted(starts, edges)]

    @staticmethod
    def _equal(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of each group of equal runs, and the group of each run. Runs are read eight bytes at a time; groups are
        formed by a hash of these words and then held against their first member word by word."""
        words = np.ndarray((len(low) - 7,), "<u8", low.data, strides=(1,))
        key = sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + odd
        pieces, left, at, who = [], sizes, starts, np.arange(len(sizes))
        while len(who):
            word = words[at]
            part = np.flatnonzero(left < 8)
            word[part] &= (np.uint64(1) << (left[part].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            key[who] = (key[who] ^ word) * np.uint64(0x9E3779B97F4A7C15)
            key[who] ^= key[who] >> np.uint64(29)
            pieces.append((who, word))
            more = left > 8
            who, at, left = who[more], at[more] + 8, left[more] - 8
        same, unique = pd.factorize(key)
        one = np.zeros(len(unique), np.int64)
        one[same[::-1]] = np.arange(len(same))[::-1]
        clash = sizes[one[same]] != sizes
        for who, word in pieces:
            held = np.zeros(len(sizes), np.uint64)
            held[who] = word
            clash[who] |= held[one[same[who]]] != word
        lone = np.flatnonzero(clash)  # runs that only share a hash with others stand alone
        same[lone] = len(one) + np.arange(len(lone))
        return np.r_[one, lone], same

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that `offsets` cut out of UTF-8 bytes, and the offsets of each text's ids."""
        cuts, at, end = [int(offsets[0])], int(offsets[0]), int(offsets[-1])
        blanks = None
        while end - at > SLAB:
            stop = np.searchsorted(offsets, at + SLAB, "right") - 1
            nxt = int(offsets[stop])
            if nxt <= at:  # one text longer than a slab: cut it at white space
                blanks = np.flatnonzero(_KINDS[data] == _BLANK) if blanks is None else blanks
                k = np.searchsorted(blanks, at + SLAB)
                nxt = min(int(blanks[k]) if k < len(blanks) else end, int(offsets[stop + 1]))
            cuts.append(nxt)
            at = nxt
        cuts.append(end)
        ids, before, total = [], np.zeros(len(offsets), np.int64), 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            lo, hi = np.searchsorted(offsets, a, "left"), np.searchsorted(offsets, b, "right")
            got, seen = self._slab(data[a:b], offsets[lo:hi] - a)
            before[lo:hi] = total + seen
            total += len(got)
            ids.append(got)
        return np.concatenate(ids), before

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow string array's texts, and the offsets of each text's ids; null and empty have none."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.fill_null("").cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        return self.encode_bytes(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(pa.array([text], pa.string()))[0].tolist()

    def library_ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        """decode(ids, skip_special_tokens=False) of a vocabulary without a decoder: its tokens, space-joined."""
        return " ".join(map(self.tokens.__getitem__, ids))


_open: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    """The worker's encoder of a vocabulary file."""
    if path not in _open:
        _open[path] = WordBPE(path)
    return _open[path]
