"""Re-Pair grammars of token ids: the layout of one shard, and reading any part of it back.

A shard holds whole documents. Pairs of neighbouring symbols are replaced by nonterminals, round after
round, until no pair occurs often enough to pay for its rule; no pair spans two documents, so each
document is a run of symbols of its own. A round replaces all frequent pairs at once: where they
overlap, the more frequent one, and a pair left with too few uses waits for the next round. Symbols
take as many bits as the largest one needs. The end id that every document carries is not stored. All
numbers are little-endian:

    4s magic "RPG2", u32 base (first nonterminal), u32 end id, u32 rules, u32 symbols, u32 documents,
    u32 bits per symbol
    symbols[2 * rules]   left and right symbol of each rule, bit-packed, filled to a whole byte
    u32[rules]           expansion length of each rule in ids
    symbols[symbols]     the documents, one after the other, packed likewise
    u32[documents + 1]   first symbol of each document
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC, HEADER = b"RPG2", "<4s6I"
#: Uses that pay for a rule: it costs two symbols of 16 to 20 bits and a length of 32.
LEAST = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Stands where the right symbol of a replaced pair was; no id or nonterminal.
GONE = np.uint32(0xFFFFFFFF)


def pack(symbols: np.ndarray, bits: int) -> bytes:
    """Symbols of ``bits`` bits each, the highest bit first, one after the other."""
    out = [np.zeros(0, np.uint8)]
    step = 1 << 15  # a multiple of 8, so all blocks but the last end with a byte
    for a in range(0, len(symbols), step):
        wide = symbols[a:a + step].astype(">u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits:]))
    return np.concatenate(out).tobytes()


def unpack(data: np.ndarray, count: int, bits: int) -> np.ndarray:
    """The first ``count`` symbols of packed bytes."""
    out = np.zeros(count, np.uint32)
    step = 1 << 15
    for a in range(0, count, step):
        n = min(step, count - a)
        own = np.unpackbits(data[a * bits // 8:(a * bits + n * bits + 7) // 8])[:n * bits].reshape(n, bits)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, 32 - bits:] = own
        out[a:a + n] = np.packbits(wide, axis=1).view(">u4").ravel()
    return out


def _frequent(pairs: np.ndarray) -> np.ndarray:
    """Distinct pairs with LEAST or more uses, the most frequent first; a pair of one symbol overlaps itself and counts half."""
    some = np.sort(pairs)
    cuts = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
    counts = np.diff(cuts, append=len(some))
    often = np.flatnonzero(counts >= LEAST)
    kinds, counts = some[cuts[often]], counts[often]
    same = (kinds >> np.uint64(32)) == (kinds & np.uint64(0xFFFFFFFF))
    return kinds[np.argsort(-np.where(same, (counts + 1) // 2, counts), kind="stable")]


def _round(seq: np.ndarray, after: np.ndarray, before: np.ndarray, at: np.ndarray, next_id: int) -> tuple[np.ndarray, np.ndarray]:
    """One round, in place: (left symbols of the pairs that the next round looks at, new rules).

    ``after`` and ``before`` lead to the next and last symbol of the document, -1 if there is none. Only
    pairs with a symbol of the last round and those that were frequent then can be frequent: the uses of
    all others have become fewer since they were counted. Of overlapping uses that of the more frequent pair
    stands, so the most frequent pair has all of its own, and a round without a rule is the last one.
    """
    right = after[at]
    pairs = seq[at].astype(np.uint64) << np.uint64(32) | seq[right]
    chosen = _frequent(pairs)
    if not len(chosen):
        return at, np.zeros((0, 2), np.uint32)
    # a table of slots names the pair of each use; pairs that lost their slot to another one are searched for
    table = np.full(1 << 20, -1, np.int32)
    slots = ((chosen * _MULTIPLIER) >> np.uint64(44)).astype(np.int64)
    table[slots] = np.arange(len(chosen), dtype=np.int32)
    lost = np.flatnonzero(table[slots] != np.arange(len(chosen)))
    rank = table[((pairs * _MULTIPLIER) >> np.uint64(44)).astype(np.int64)]  # rank 0 is the most frequent pair
    found = chosen[rank] == pairs
    if len(lost):
        lost = lost[np.argsort(chosen[lost])]
        ordered, miss = chosen[lost], np.flatnonzero(~found & (rank >= 0))
        place = np.minimum(np.searchsorted(ordered, pairs[miss]), len(ordered) - 1)
        same = ordered[place] == pairs[miss]
        rank[miss[same]], found[miss[same]] = lost[place[same]], True
    use = np.flatnonzero(found)
    hit, right, rank = at[use], right[use], rank[use]
    ask = np.zeros(len(seq), bool)
    ask[hit] = True
    next_to = right[:-1] == hit[1:]
    stands = np.ones(len(hit), bool)
    stands[1:] &= ~(next_to & (rank[:-1] < rank[1:]))
    stands[:-1] &= ~(next_to & (rank[1:] < rank[:-1]))
    use = np.flatnonzero(stands)
    hit, right, rank = hit[use], right[use], rank[use]
    # what still overlaps is a run of one symbol: every other pair, from the left
    inner = np.flatnonzero(right[:-1] == hit[1:]) + 1
    if len(inner):
        number = np.zeros(len(hit), np.int64)
        number[inner] = 1
        first = np.flatnonzero(number == 0)
        number = np.arange(len(hit)) - np.repeat(first, np.diff(first, append=len(hit)))
        use = np.flatnonzero(number % 2 == 0)
        hit, right, rank = hit[use], right[use], rank[use]
    pays = np.bincount(rank, minlength=len(chosen)) >= LEAST
    use = np.flatnonzero(pays[rank])
    hit, right, rank = hit[use], right[use], rank[use]
    names = (next_id + np.cumsum(pays) - 1).astype(np.uint32)
    seq[hit], seq[right] = names[rank], GONE
    follow = after[right]
    after[hit] = follow
    inner = np.flatnonzero(follow >= 0)
    before[follow[inner]] = hit[inner]
    left = before[hit]
    ask[left[left >= 0]], ask[right] = True, False
    at, kept = np.flatnonzero(ask), chosen[pays]
    return at[after[at] >= 0], np.stack([kept >> np.uint64(32), kept & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


def grammar(ids: np.ndarray, first: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols, first symbol of each document and the end)."""
    seq, full = ids.astype(np.uint32), np.diff(first) > 0
    after, before = np.arange(1, len(seq) + 1), np.arange(-1, len(seq) - 1)
    after[first[1:][full] - 1] = before[first[:-1][full]] = -1
    rules, next_id, at = [np.zeros((0, 2), np.uint32)], base, np.flatnonzero(after >= 0)
    while len(at):
        at, more = _round(seq, after, before, at, next_id)
        if not len(more):
            break
        rules.append(more)
        next_id += len(more)
    stay = np.flatnonzero(seq != GONE)
    return np.concatenate(rules), seq[stay], np.searchsorted(stay, first)


def encode(ids: np.ndarray, first: np.ndarray, base: int, end_id: int) -> bytes:
    """A shard from the ids of its documents, ``ids[first[k]:first[k + 1]]``, end ids left out; ids are below ``base``."""
    rules, seq, starts = grammar(ids, first, base)
    lengths = [1] * base
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    bits = max(1, (base + len(rules) - 1).bit_length())
    return b"".join([
        struct.pack(HEADER, MAGIC, base, end_id, len(rules), len(seq), len(first) - 1, bits), pack(rules.ravel(), bits),
        np.array(lengths[base:], "<u4").tobytes(), pack(seq, bits), starts.astype("<u4").tobytes()])


@dataclass
class Shard:
    """A shard read back; `document` and `slice` touch only the symbols they need."""

    base: int
    end_id: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    first: np.ndarray

    @classmethod
    def read(cls, data: bytes) -> Shard:
        magic, base, end_id, rules, symbols, documents, bits = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at, raw = struct.calcsize(HEADER), np.frombuffer(data, np.uint8)

        def packed(count: int) -> np.ndarray:
            nonlocal at
            own, at = raw[at:], at + (count * bits + 7) // 8
            return unpack(own, count, bits)

        def numbers(count: int) -> np.ndarray:
            nonlocal at
            own, at = np.frombuffer(data, "<u4", count, at), at + 4 * count
            return own

        pairs, lengths = packed(2 * rules).reshape(-1, 2), numbers(rules)
        own = packed(symbols)
        return cls(base, end_id, pairs, np.r_[np.ones(base, np.int64), lengths.astype(np.int64)], own, numbers(documents + 1))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a run of symbols: nonterminals are opened level by level."""
        symbols = symbols.astype(np.int64)
        while len(rule := np.flatnonzero(symbols >= self.base)):
            pair = self.rules[symbols[rule] - self.base].astype(np.int64)
            counts = np.ones(len(symbols), np.int64)
            counts[rule] = 2
            to = np.cumsum(counts) - counts
            wider = np.repeat(symbols, counts)
            wider[to[rule]], wider[to[rule] + 1] = pair[:, 0], pair[:, 1]
            symbols = wider
        return symbols.astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        """All ids of document ``k`` with the end id."""
        return np.append(self.expand(self.symbols[self.first[k]:self.first[k + 1]]), np.uint32(self.end_id))

    def slice(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``k``: expansion lengths lead to the symbols that cover them."""
        own = self.symbols[self.first[k]:self.first[k + 1]]
        ends = np.cumsum(self.lengths[own])
        total = int(ends[-1]) if len(own) else 0
        a, b = (int(np.searchsorted(ends, x, side="right")) for x in (start, max(start, stop - 1)))
        skipped = int(ends[a - 1]) if a else 0
        ids = self.expand(own[a:b + 1])[start - skipped:stop - skipped] if start < min(stop, total) else np.zeros(0, np.uint32)
        return np.append(ids, np.uint32(self.end_id)) if start <= total < stop else ids

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other with their end ids, first id of each and the end)."""
        # each rule is opened once; the documents are then put together from what the rules stand for
        opened = np.r_[np.arange(self.base, dtype=np.uint32), self.expand(np.arange(self.base, self.base + len(self.rules)))]
        counts, at = self.lengths[self.symbols], np.cumsum(self.lengths) - self.lengths
        total = np.r_[0, np.cumsum(counts)]
        flat = opened[np.repeat(at[self.symbols] - total[:-1], counts) + np.arange(total[-1])]
        ends = total[self.first]
        return np.insert(flat, ends[1:], np.uint32(self.end_id)), ends + np.arange(len(ends))
