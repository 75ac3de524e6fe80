"""Per-word helpers that run inside tasks, on distinct words only."""

from __future__ import annotations

import math

import numpy as np

UNKNOWN = -30.0
#: words of more characters than this are split one by one, not in columns
LONG = 256
GAP = 0x1FFFFF


def prefixes(pieces) -> set[str]:
    """Every beginning of every piece; a text that leaves the set starts no piece."""
    return {p[:i] for p in pieces for i in range(1, len(p) + 1)}


def _edges(word: str, scores: dict[str, float], starts: set[str]) -> list[list[tuple[int, float]]]:
    """For each end position the (start, score) of the pieces that end there."""
    n = len(word)
    found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start in range(n):
        for end in range(start + 1, n + 1):
            piece = word[start:end]
            if piece not in starts:
                break
            score = scores.get(piece)
            if score is not None:
                found[end].append((start, score))
    return found


def expected_pieces(
    words: list[str], freqs: list[int], scores: dict[str, float], starts: set[str],
) -> tuple[dict[str, float], float]:
    """Expected piece counts over all splits of each word, and the log likelihood."""
    uses: dict[str, float] = {}
    total = 0.0
    for word, freq in zip(words, freqs):
        n = len(word)
        edges = _edges(word, scores, starts)
        # log likelihood of each beginning of the word
        ahead = [0.0] + [-math.inf] * n
        for end in range(1, n + 1):
            terms = [ahead[s] + sc for s, sc in edges[end]]
            peak = max(terms, default=-math.inf)
            if peak > -math.inf:
                ahead[end] = peak if len(terms) == 1 else peak + math.log(
                    sum([math.exp(t - peak) for t in terms]))
        if ahead[n] == -math.inf:
            continue
        total += freq * ahead[n]
        # share of the splits that pass through each position, from the end back
        through = [0.0] * n + [float(freq)]
        for end in range(n, 0, -1):
            if through[end] == 0.0:
                continue
            for start, score in edges[end]:
                share = through[end] * math.exp(ahead[start] + score - ahead[end])
                through[start] += share
                piece = word[start:end]
                uses[piece] = uses.get(piece, 0.0) + share
    return uses, total


def best_split(
    word: str, scores: dict[str, float], starts: set[str], without: str | None = None,
) -> tuple[list[str], float]:
    """The most likely split; a character no piece covers stands alone at a heavy cost."""
    n = len(word)
    edges = _edges(word, scores, starts)
    best = [0.0] + [-math.inf] * n
    back = [0] * (n + 1)
    for end in range(1, n + 1):
        best[end], back[end] = best[end - 1] + UNKNOWN, end - 1
        for start, score in edges[end]:
            if best[start] + score > best[end] and word[start:end] != without:
                best[end], back[end] = best[start] + score, start
    pieces = []
    end = n
    while end:
        pieces.append(word[back[end]:end])
        end = back[end]
    return pieces[::-1], best[n]


class PieceIndex:
    """Pieces as a trie in sorted columns: all words of a batch walk it at once.

    A step is a key of node and character. Nodes are numbered as the steps are sorted, so that
    the place of a step is the node it leads to.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        scores = {p: s for p, s in scores.items() if p}
        self.pieces = list(scores)
        self.scores = np.array([scores[p] for p in self.pieces], np.float64)
        points, begins, sizes = code_points(self.pieces)
        node = np.zeros(len(sizes), np.int64)
        keys, self.ends, total = [], [np.array([-1])], 0
        for depth in range(int(sizes.max(initial=0))):
            rows = np.flatnonzero(sizes > depth)
            step, where = np.unique((node[rows] << 21) | points[begins[rows] + depth], return_inverse=True)
            node[rows] = total + 1 + where
            last = np.full(len(step), -1)
            done = sizes[rows] == depth + 1
            last[where[done]] = rows[done]
            keys.append(step)
            self.ends.append(last)
            total += len(step)
        self.keys = np.concatenate([*keys, [FAR]])
        self.ends = np.concatenate(self.ends)

    def edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, end, piece)`` of every piece that stands in the text, in no order."""
        at, node, depth = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        found = []
        while len(at):
            have = (node << 21) | points[at + depth]
            node = np.searchsorted(self.keys, have)
            known = self.keys[node] == have
            at, node, depth = at[known], node[known] + 1, depth + 1
            piece = self.ends[node]
            whole = piece >= 0
            found.append((at[whole], at[whole] + depth, piece[whole]))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def longest(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(end, piece)`` of the longest piece from each place, the piece -1 for none."""
        end, best = at.copy(), np.full(len(at), -1)
        row, node, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
        while len(row):
            have = (node << 21) | points[at[row] + depth]
            node = np.searchsorted(self.keys, have)
            known = self.keys[node] == have
            row, node, depth = row[known], node[known] + 1, depth + 1
            piece = self.ends[node]
            whole = piece >= 0
            end[row[whole]], best[row[whole]] = at[row[whole]] + depth, piece[whole]
        return end, best


FAR = np.iinfo(np.int64).max


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words end to end with a ``GAP`` after each, where each begins, and its length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(sizes + 1) - sizes - 1
    points = np.full(int(sizes.sum()) + len(words), GAP, np.int64)
    filled = np.ones(len(points), bool)
    filled[begins + sizes] = False
    points[filled] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, begins, sizes


class Lattice:
    """All splits of a batch of words: the pieces between places, in the order of their ends.

    ``rounds`` are the slices of edges that end as many characters into their words; within a
    round the edges of an end stand together, from the earliest start on.
    """

    def __init__(self, words: list[str], index: PieceIndex) -> None:
        self.points, self.begins, self.sizes = code_points(words)
        start, end, piece = index.edges(self.points)
        inside = np.arange(len(self.points)) - np.repeat(self.begins, self.sizes + 1)
        order = np.lexsort((start, end, inside[end]))
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        self.score = index.scores[self.piece]
        into = inside[self.end]
        cuts = np.searchsorted(into, np.arange(1, int(self.sizes.max(initial=0)) + 2))
        self.rounds = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]

    def heads(self, part: slice) -> np.ndarray:
        """Where each end's edges begin within a round."""
        end = self.end[part]
        return np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))


def expected_uses(words: list[str], freqs: np.ndarray, index: PieceIndex) -> tuple[np.ndarray, float]:
    """:func:`expected_pieces` in columns, as one number for each piece of the index."""
    lattice = Lattice(words, index)
    ahead = np.full(len(lattice.points), -np.inf)
    ahead[lattice.begins] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for part in lattice.rounds:
            if part.start == part.stop:
                continue
            heads = lattice.heads(part)
            terms = ahead[lattice.start[part]] + lattice.score[part]
            peak = np.maximum.reduceat(terms, heads)
            sizes = np.diff(np.append(heads, len(terms)))
            sums = np.add.reduceat(np.exp(terms - np.repeat(peak, sizes)), heads)
            ahead[lattice.end[part][heads]] = np.where(peak > -np.inf, peak + np.log(sums), -np.inf)
        share = np.exp(ahead[lattice.start] + lattice.score - ahead[lattice.end])
    whole = ahead[lattice.begins + lattice.sizes]
    likely = whole > -np.inf
    # a place no split reaches has no share in any
    share[~(ahead[lattice.end] > -np.inf)] = 0.0
    through = np.zeros(len(lattice.points))
    through[(lattice.begins + lattice.sizes)[likely]] = freqs[likely]
    for part in reversed(lattice.rounds):
        share[part] *= through[lattice.end[part]]
        # a start has one edge at most in a round
        through[lattice.start[part]] += share[part]
    uses = np.bincount(lattice.piece, weights=share, minlength=len(index.pieces))
    return uses, float((freqs[likely] * whole[likely]).sum())


def best_pieces(words: list[str], index: PieceIndex) -> tuple[np.ndarray, np.ndarray]:
    """:func:`best_split` in columns: the pieces of all words end to end, -1 for an unknown
    character, and the number of pieces of each word."""
    lattice = Lattice(words, index)
    places = len(lattice.points)
    best = np.full(places, -np.inf)
    best[lattice.begins] = 0.0
    back = np.arange(places) - 1
    chosen = np.full(places, -1)  # a lone character is a piece if the index has it, at any score
    single = lattice.end - lattice.start == 1
    chosen[lattice.end[single]] = lattice.piece[single]
    for depth, part in enumerate(lattice.rounds, 1):
        at = lattice.begins[lattice.sizes >= depth] + depth
        best[at] = best[at - 1] + UNKNOWN
        if part.start == part.stop:
            continue
        heads = lattice.heads(part)
        start, end, piece = lattice.start[part], lattice.end[part], lattice.piece[part]
        terms = best[start] + lattice.score[part]
        sizes = np.diff(np.append(heads, len(terms)))
        peak = np.maximum.reduceat(terms, heads)
        tops = np.flatnonzero(terms == np.repeat(peak, sizes))
        first = tops[np.searchsorted(tops, heads)]
        first = first[peak > best[end[heads]]]
        ends = end[first]
        best[ends], back[ends], chosen[ends] = terms[first], start[first], piece[first]
    at, row = lattice.begins + lattice.sizes, np.arange(len(words))
    rows, ids = [], []
    while len(at):
        go_on = at > lattice.begins[row]
        at, row = at[go_on], row[go_on]
        rows.append(row)
        ids.append(chosen[at])
        at = back[at]
    rows, ids = (np.concatenate(c[::-1]) if c else np.zeros(0, np.int64) for c in (rows, ids))
    order = np.argsort(rows, kind="stable")
    return ids[order], np.bincount(rows, minlength=len(words))


class PieceTrie:
    """Known pieces by their characters: one walk finds the longest that starts at a place."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.ids: dict[int, int] = {}
        for piece, number in pieces.items():
            node = 0
            for ch in piece:
                node = self.steps.setdefault((node, ch), len(self.steps) + 1)
            self.ids[node] = number

    def longest(self, word: str, start: int) -> tuple[int, int | None]:
        """``(end, id)`` of the longest piece of ``word`` from ``start``; the id is None for none."""
        node, end, found, steps = 0, start, None, self.steps
        for at in range(start, len(word)):
            node = steps.get((node, word[at]))
            if node is None:
                break
            if node in self.ids:
                end, found = at + 1, self.ids[node]
        return end, found


def longest_match(
    word: str, heads: PieceTrie, tails: PieceTrie, unknown: int, longest: int | None = None,
) -> list[int]:
    """WordPiece: the longest known piece from each place, ``[UNK]`` if one is missing.

    A walk is no longer than the longest piece, so a word of any length takes linear time. ``longest``
    makes longer words ``[UNK]``, as public encoders do from 100 characters on.
    """
    if longest is not None and len(word) > longest:
        return [unknown]
    out, start = [], 0
    while start < len(word):
        start, found = (tails if start else heads).longest(word, start)
        if found is None:
            return [unknown]
        out.append(found)
    return out


def longest_matches(
    words: list[str], heads: PieceIndex, tails: PieceIndex,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`longest_match` in columns: the pieces of all words end to end (of ``heads`` for a word's first,
    of ``tails`` for the others), the number of pieces of each word, and which words can be spelled."""
    points, begins, sizes = code_points(words)
    spelled = np.ones(len(words), bool)
    row, at, index = np.flatnonzero(sizes > 0), begins[sizes > 0], heads
    rows, pieces = [], []
    while len(row):
        end, piece = index.longest(points, at)
        missing = piece < 0
        spelled[row[missing]] = False
        rows.append(row[~missing])
        pieces.append(piece[~missing])
        go_on = ~missing & (points[end] != GAP)
        row, at, index = row[go_on], end[go_on], tails
    rows, pieces = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rows, pieces))
    order = np.argsort(rows, kind="stable")
    order = order[spelled[rows[order]]]
    return pieces[order], np.bincount(rows[order], minlength=len(words)), spelled
