"""Re-Pair grammars over token ids, and their binary form.

Frequent pairs of neighbouring ids are replaced by new symbols, round after round: each round counts all pairs,
gives a symbol to the most frequent ones (up to ``PAIRS_PER_ROUND``, each seen ``LEAST_COUNT`` times) and replaces
them from left to right, until no pair is seen ``LEAST_COUNT`` times or all symbols are given (those of two bytes if the
ids need no more). No pair crosses a document's end, so every document stays a run of whole symbols. With each
rule the number of ids it expands to is kept, so one document, or a range of its ids, is decoded without the rest.

A payload is, little-endian: the magic, seven counts (rules, symbols, documents, first rule's symbol, bytes of an id,
bytes of a symbol, rounds), each rule's left part, right part and expansion length, each document's id, whether that
id is null, its symbols and its ids, and the symbols.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

MAGIC = b"TMRP0001"
PAIRS_PER_ROUND, LEAST_COUNT = 3072, 16


_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _slots(pairs: int) -> int:
    """A power of two, large enough that few pairs share a slot."""
    return 1 << max(10, int(64 * pairs).bit_length())


def _slot(pair: np.ndarray, multiplier: int, slots: int) -> np.ndarray:
    return (pair.astype(np.uint64) * np.uint64(multiplier)) >> np.uint64(65 - slots.bit_length())


class Grammar(NamedTuple):
    base: int  # symbols from here on are rules
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # ids that each rule expands to
    doc_ids: np.ndarray
    doc_null: np.ndarray
    doc_symbols: np.ndarray
    doc_tokens: np.ndarray
    symbols: np.ndarray
    rounds: int


def compress(ids: np.ndarray, doc_tokens: np.ndarray, doc_ids: np.ndarray, doc_null: np.ndarray, base: int) -> Grammar:
    """Grammar of documents that lie one after the other in ``ids``; all ids are below ``base``."""
    small = base < 65_536
    most = (65_536 if small else 2**31) - base
    symbols = ids.astype(np.uint32)
    stops = np.cumsum(doc_tokens)  # one past each document's last symbol
    left, right, length, done = [], [], [], 0
    sizes = np.ones(base, np.int64)
    while True:
        room = min(PAIRS_PER_ROUND, most - (len(sizes) - base))
        if room <= 0 or len(symbols) < 2:
            break
        pair = symbols[:-1] << np.uint32(16) | symbols[1:] if small else symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
        inside = np.ones(len(pair), bool)
        inside[stops[(stops > 0) & (stops <= len(pair))] - 1] = False
        ordered = np.sort(pair[inside])
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))) if len(ordered) else np.zeros(1, int)
        count = np.diff(edge)
        frequent = np.flatnonzero(count >= LEAST_COUNT)
        if not len(frequent):
            break
        if len(frequent) > room:
            frequent = np.sort(frequent[np.argsort(-count[frequent], kind="stable")[:room]])
        # Rules are found by one look into a table of hashed pairs. Of pairs that share a slot one is taken, the others next round.
        slots, multiplier = _slots(len(frequent)), _MULTIPLIERS[done % len(_MULTIPLIERS)]
        chosen = ordered[edge[frequent]]
        own = _slot(chosen, multiplier, slots)
        frequent = frequent[np.sort(np.unique(own, return_index=True)[1])]
        chosen = ordered[edge[frequent]]
        table = np.zeros(slots, np.int32)
        table[_slot(chosen, multiplier, slots)] = np.arange(len(chosen), dtype=np.int32)
        heads = np.zeros(len(sizes), bool)
        heads[(chosen >> (16 if small else 32)).astype(np.int64)] = True
        maybe = np.flatnonzero(heads[symbols[:-1]] & inside).astype(np.int32)
        wanted = pair[maybe]
        at = table[_slot(wanted, multiplier, slots)]
        hit = chosen[at] == wanted
        place, rule = maybe[hit].astype(np.int64), at[hit]
        # Of places in a row every other one counts, from the left.
        opens = np.append(True, np.diff(place) != 1)
        first = place[opens][np.cumsum(opens) - 1]
        taken = (place - first) % 2 == 0
        place, rule = place[taken], rule[taken]
        a = (chosen >> (16 if small else 32)).astype(np.int64)
        b = (chosen & (0xFFFF if small else 0xFFFFFFFF)).astype(np.int64)
        symbols[place] = (rule + len(sizes)).astype(np.uint32)
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        stops = stops - np.searchsorted(place, stops)
        symbols = symbols[keep]
        left.append(a)
        right.append(b)
        length.append(sizes[a] + sizes[b])
        sizes = np.concatenate((sizes, length[-1]))
        done += 1
    none = np.zeros(0, np.int64)
    return Grammar(
        base, *(np.concatenate(x) if x else none for x in (left, right, length)), doc_ids, doc_null,
        np.diff(stops, prepend=0), doc_tokens, symbols, done,
    )


def packed(grammar: Grammar) -> bytes:
    wide = 2 if grammar.base + len(grammar.left) <= 65_536 else 4
    head = struct.pack(
        "<7Q", len(grammar.left), len(grammar.symbols), len(grammar.doc_ids), grammar.base, 4, wide, grammar.rounds
    )
    parts = [x.astype("<u4").tobytes() for x in (grammar.left, grammar.right, grammar.length)]
    parts += [grammar.doc_ids.astype("<i8").tobytes(), grammar.doc_null.astype("u1").tobytes()]
    parts += [x.astype("<u4").tobytes() for x in (grammar.doc_symbols, grammar.doc_tokens)]
    return b"".join([MAGIC, head, *parts, grammar.symbols.astype(f"<u{wide}").tobytes()])


def unpacked(payload: bytes) -> Grammar:
    if payload[:8] != MAGIC:
        raise ValueError("not a token grammar")
    rules, symbols, docs, base, _, wide, rounds = struct.unpack_from("<7Q", payload, 8)
    at, out = 64, []
    for kind, n in (("<u4", rules),) * 3 + (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", docs), (f"<u{wide}", symbols)):
        out.append(np.frombuffer(payload, kind, n, at))
        at += out[-1].nbytes
    left, right, length, doc_ids, null, doc_symbols, doc_tokens, body = out
    return Grammar(base, left, right, length, doc_ids, null.astype(bool), doc_symbols, doc_tokens, body, rounds)


class Decoder:
    """Expands symbols of one grammar."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.sizes = np.concatenate((np.ones(grammar.base, np.int64), grammar.length.astype(np.int64)))
        rules = np.arange(grammar.base, len(self.sizes))
        flat = rules
        while (flat >= grammar.base).any():  # at most as often as there were rounds
            flat = self._split(flat)
        self.flat = np.concatenate((np.arange(grammar.base), flat)).astype(np.uint32)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.starts = np.concatenate(([0], np.cumsum(grammar.doc_symbols.astype(np.int64))))

    def _split(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.grammar.base
        at = np.cumsum(rule + 1)
        out = np.empty(int(at[-1]), np.int64)
        which = symbols[rule] - self.grammar.base
        out[at[~rule] - 1] = symbols[~rule]
        out[at[rule] - 2] = self.grammar.left[which]
        out[at[rule] - 1] = self.grammar.right[which]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.sizes[symbols]
        stops = np.cumsum(n)
        total = int(stops[-1]) if len(stops) else 0
        return self.flat[np.repeat(self.offsets[:-1][symbols] - stops + n, n) + np.arange(total)]

    def document(self, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` up to ``last`` (not included) of document ``k``; only the symbols that hold them are expanded."""
        own = self.grammar.symbols[self.starts[k] : self.starts[k + 1]]
        stops = np.cumsum(self.sizes[own])
        last = int(stops[-1]) if last is None and len(stops) else last or 0
        low, high = np.searchsorted(stops, first, "right"), np.searchsorted(stops, last, "left") + 1
        skipped = int(stops[low - 1]) if low else 0
        return self.expand(own[low:high])[first - skipped : last - skipped]
