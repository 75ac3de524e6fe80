"""Learning and applying merges of adjacent symbols, in columns of ids.

A batch of words is one array of symbol ids and one of row numbers. Merges are learned in bands:
the pairs at the head of the ranking, taken together with the chains they form, are closed under merging.
A pair that counts less than the band's floor is never merged in the band, and no merge across it
can come to count more, so words are cut there. What is left are chains of frequent pairs, the same ones in
very many words: equal chains are summed, and the merges down to the floor are found in them exactly,
thousands at a time.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

Merge = tuple[int, int, int]
FREE = np.iinfo(np.int64).max


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbol ids of a batch end to end, and the row each belongs to."""
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    return np.asarray(lists.flatten()).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def lists_of(ids: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))


def pair_keys(ids: np.ndarray) -> np.ndarray:
    return (ids[:-1] << 32) | ids[1:]


class MergeTable:
    """Merges in the order they were learned, looked up for whole columns of pairs."""

    def __init__(self, merges: Iterable[Merge], singly: bool = False) -> None:
        """``singly`` encodes a text: of a pair learned twice the last place holds, and a merge whose token
        is part of an earlier one goes one place at a time, since the earlier one then comes first."""
        merges = list(merges)
        self.single = None
        if singly:
            last = {m[:2]: rank for rank, m in enumerate(merges)}
            merges = [m for rank, m in enumerate(merges) if last[m[:2]] == rank]
            first: dict[int, int] = {}
            for rank, pair in enumerate(merges):
                for part in pair[:2]:
                    first.setdefault(part, rank)
            self.single = np.array([first.get(m[2], FREE) < rank for rank, m in enumerate(merges)], bool)
        keys = np.array([(a << 32) | b for a, b, _ in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.new = np.array([m for _, _, m in merges], np.int64)
        self.by_pair = None

    def find(self, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours in a row, ``FREE`` for a pair that is no merge."""
        have = pair_keys(ids)
        slot = np.minimum(np.searchsorted(self.keys, have), len(self.keys) - 1)
        known = (self.keys[slot] == have) & (row[:-1] == row[1:])
        return np.where(known, self.ranks[slot], FREE)

    def _pass(self, ids: np.ndarray, row: np.ndarray, rank: np.ndarray):
        """Merge the earliest pair of each row wherever it stands, leftmost first."""
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        lowest = np.minimum.reduceat(np.append(rank, FREE), first)
        least = np.repeat(lowest, np.diff(np.append(first, len(row))))
        hits = np.flatnonzero((rank != FREE) & (rank == least[:-1]))
        # hits in sequence overlap (only a symbol merged with itself does): every other one counts
        fresh = np.concatenate([[True], np.diff(hits) > 1])
        place = np.arange(len(hits)) - np.maximum.accumulate(
            np.where(fresh, np.arange(len(hits)), 0))
        hits = hits[place % 2 == 0]
        if self.single is not None:
            again = np.concatenate([[False], row[hits[1:]] == row[hits[:-1]]])
            hits = hits[~(again & self.single[rank[hits]])]
        ids = ids.copy()
        ids[hits] = self.new[rank[hits]]
        keep = np.ones(len(ids), bool)
        keep[hits + 1] = False
        return ids[keep], row[keep]

    def apply(self, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply the earliest merge present in each row until none is."""
        if not len(self.keys) or len(ids) < 2:
            return ids, row
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            rank = self.find(ids, row)
            active = np.zeros(int(row[-1]) + 1, bool)
            active[row[:-1][rank != FREE]] = True
            go_on = active[row]
            if not go_on.all():
                done.append((ids[~go_on], row[~go_on]))
                rank = np.append(rank, FREE)[go_on][:-1]
                ids, row = ids[go_on], row[go_on]
            if not len(ids):
                break
            ids, row = self._pass(ids, row, rank)
        ids, row = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(row, kind="stable")
        return ids[order], row[order]

    def apply_word(self, ids: list[int]) -> list[int]:
        """Merge one word of any length: a queue of its pairs by rank and place."""
        if self.by_pair is None:
            self.by_pair = {int(k): (int(r), int(self.new[r])) for k, r in zip(self.keys, self.ranks)}
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        ids = list(ids)

        def found(at: int):
            right = after[at]
            return self.by_pair.get(ids[at] << 32 | ids[right]) if right >= 0 else None

        queue = [(hit[0], at) for at in range(len(ids)) if (hit := found(at))]
        heapq.heapify(queue)
        while queue:
            rank, at = heapq.heappop(queue)
            hit = found(at) if ids[at] >= 0 else None
            if hit is None or hit[0] != rank:
                continue
            right = after[at]
            ids[at], ids[right] = hit[1], -1
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for place in (before[at], at):
                if place >= 0 and (again := found(place)):
                    heapq.heappush(queue, (again[0], place))
        return [i for i in ids if i >= 0]


def apply_all(lists: pa.Array, segments: list[MergeTable]) -> tuple[np.ndarray, np.ndarray]:
    ids, row = flat(lists)
    for table in segments:
        ids, row = table.apply(ids, row)
    return ids, row


def count_pairs(batch: pa.RecordBatch, segments: list[MergeTable]) -> pa.RecordBatch:
    """``(l, r, n)``: how often neighbours occur."""
    ids, row = apply_all(batch.column("ids"), segments)
    freq = np.asarray(batch.column("freq"))
    inside = row[:-1] == row[1:]
    keys, where = np.unique(pair_keys(ids)[inside], return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, where, freq[row[:-1][inside]])
    return pa.RecordBatch.from_arrays(
        [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)),
         pa.array(n)], ["l", "r", "n"])


def chosen_rows(batch: pa.RecordBatch, ids: np.ndarray, row: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """The rows marked in ``rows``, with the given symbols."""
    keep = rows[row]
    number = np.cumsum(rows) - 1
    return pa.RecordBatch.from_arrays(
        [lists_of(ids[keep], number[row[keep]], int(rows.sum())),
         batch.column("freq").filter(pa.array(rows))], ["ids", "freq"])


def merged_rows(batch: pa.RecordBatch, segments: list[MergeTable]) -> pa.RecordBatch:
    """The batch with all merges applied; words of one symbol are done and leave."""
    ids, row = apply_all(batch.column("ids"), segments)
    return chosen_rows(batch, ids, row, np.bincount(row, minlength=batch.num_rows) > 1)


def chains(batch: pa.RecordBatch, segments: list[MergeTable], keys: np.ndarray) -> pa.RecordBatch:
    """The merged words cut wherever neighbours are none of the pairs ``keys`` (sorted), without lone symbols."""
    ids, row = apply_all(batch.column("ids"), segments)
    have = pair_keys(ids)
    slot = np.minimum(np.searchsorted(keys, have), len(keys) - 1)
    joined = (keys[slot] == have) & (row[:-1] == row[1:])
    chain = np.concatenate([[0], np.cumsum(~joined)])[:len(ids)]
    first = np.flatnonzero(np.concatenate([[True], ~joined]))[:chain[-1] + 1 if len(ids) else 0]
    sizes = np.bincount(chain, minlength=len(first))
    keep = sizes > 1
    number = np.cumsum(keep) - 1
    inside = keep[chain]
    return pa.RecordBatch.from_arrays(
        [lists_of(ids[inside], number[chain[inside]], int(keep.sum())),
         pa.array(np.asarray(batch.column("freq"))[row[first[keep]]])], ["ids", "freq"])


def merge_band(
    lists: pa.Array, freqs: np.ndarray, floor: int, name: Callable[[int, int], tuple[int, bool]],
    go_on: Callable[[], bool],
) -> list[tuple[Merge, bool]]:
    """The next merges of the corpus, from all chains (:func:`chains`) of pairs that count ``floor`` or more.

    The most frequent pair first, ties to the smaller ids. ``name`` gives the id of a merge's token and whether
    it was known before. A pair that is not in the chains counts less than ``floor`` and cannot grow, save
    for one with a known token: such a token had neighbours before, and gets more across the cuts. What
    they add up to is bounded by ``weight_of``: neighbours a and b that are cut apart count less than
    floor * weight_of[a] * weight_of[b], where a known token has the weight of all it was made of. Merging stops
    where a pair with such a token could come first. A list of merges ends after each known token;
    within a list no merged pair comes up again.
    """
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    ids = np.asarray(lists.flatten()).astype(np.int64)
    weight = np.repeat(np.asarray(freqs), sizes)
    ends = np.cumsum(sizes)
    after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
    after[ends - 1] = -1
    before[ends - sizes] = -1
    at = np.flatnonzero(after >= 0)
    keys = pair_keys(ids)[at]
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    sums = np.add.reduceat(weight[at], begins) if len(keys) else np.zeros(0, int)
    stops = np.append(begins[1:], len(keys))
    counts: dict[tuple[int, int], int] = {}
    places: dict[tuple[int, int], list[int]] = {}
    for i in np.flatnonzero(sums >= floor):
        pair = (int(keys[begins[i]] >> 32), int(keys[begins[i]] & 0xFFFFFFFF))
        counts[pair] = int(sums[i])
        places[pair] = at[begins[i]: stops[i]].tolist()
    ids, weight, after, before = ids.tolist(), weight.tolist(), after.tolist(), before.tolist()
    ranked = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(ranked)
    bar = floor
    unknown: dict[tuple[int, int], int] = defaultdict(int)
    weight_of: dict[int, int] = defaultdict(lambda: 1)
    heaviest = 1
    out: list[tuple[Merge, bool]] = []
    while ranked and go_on():
        count, left, right = heapq.heappop(ranked)
        now = counts.get((left, right), 0)
        if -count < bar:
            break
        if now != -count:
            if now >= floor:
                heapq.heappush(ranked, (-now, left, right))
            continue
        new, known = name(left, right)
        out.append(((left, right, new), known))
        fresh: dict[tuple[int, int], int] = {}
        where: dict[tuple[int, int], list[int]] = {}

        def lose(pair: tuple[int, int], n: int) -> None:
            for held in (fresh, counts):
                if pair in held:
                    held[pair] -= n
                    break
            else:
                if pair in unknown:
                    unknown[pair] -= n

        def gain(pair: tuple[int, int], n: int, place: int) -> None:
            if pair in counts:
                counts[pair] += n
                places[pair].append(place)
                heapq.heappush(ranked, (-counts[pair], *pair))
            else:
                fresh[pair] = fresh.get(pair, 0) + n
                where.setdefault(pair, []).append(place)

        for here in sorted(places.pop((left, right))):
            other = after[here]
            if ids[here] != left or other < 0 or ids[other] != right:
                continue
            n, last, nxt = weight[here], before[here], after[other]
            ids[here], ids[other], after[here] = new, -1, nxt
            if last >= 0:
                lose((ids[last], left), n)
                gain((ids[last], new), n, last)
            if nxt >= 0:
                before[nxt] = here
                lose((right, ids[nxt]), n)
                gain((new, ids[nxt]), n, here)
        counts.pop((left, right), None)
        made = max(weight_of[left], weight_of[right])
        for pair, n in fresh.items():
            if known:  # it may have been counted before, outside these chains
                unknown[pair] += n
            elif n >= floor:
                counts[pair], places[pair] = n, where[pair]
                heapq.heappush(ranked, (-n, *pair))
        if known:
            weight_of[new] += made
            heaviest = max(heaviest, weight_of[new])
            seen = max((n for held in (counts, unknown) for pair, n in held.items() if new in pair), default=0)
            bar = max(bar, seen + floor * heaviest * weight_of[new] + 1)
        elif made > 1:
            weight_of[new] = made
    return out
