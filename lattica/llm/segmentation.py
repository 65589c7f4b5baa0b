"""Segmentation lattices over a fixed public vocabulary: forward sums over all segmentations of words.

A word is the byte string of its UTF-8 text after one space.  Its lattice has an edge for every vocabulary
piece that stands in it; single bytes are always pieces, so every word has a segmentation.  Pieces have a
space at their first byte only, so no piece reaches over two words and the lattice of a text is the chain of
its words' lattices.  Many words are walked at once: positions step through a prefix tree together, and
boundaries at equal distance from their word's begin are summed together in log space.  Words of more than
LONG bytes are walked one by one in segments, and only the sums at the last boundaries are carried on, so
that time grows in proportion to their length and memory with the segment (for expected uses, and with 16
bytes for each byte of the word).
"""

from __future__ import annotations

import numpy as np

LN10 = float(np.log(10.0))
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LONG, SEGMENT = 2000, 50_000


def load_pieces(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Pieces that lower-cased words can hold, then single bytes, and their log weights by the file's scores.

    The scores of this vocabulary are ranks, so piece r has weight 1 / (r + 100), which is Zipf's law with an
    offset; bytes come after all ranks.  Pieces with a space after their first byte can't stand in a word.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, int] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        surface = sp.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in surface[1:] and surface == surface.lower():
            rank[surface] = i
    for b in range(256):
        rank.setdefault(bytes([b]), sp.get_piece_size())
    pieces = sorted(rank)
    weight = 1.0 / (np.array([rank[p] for p in pieces], dtype=np.float64) + 100.0)
    return pieces, np.log(weight / weight.sum())


class Lattice:
    def __init__(self, pieces: list[bytes]):
        self.count, self.longest = len(pieces), max(map(len, pieces))
        tree: list[dict[int, int]] = [{}]
        piece_at = [-1]
        for k, p in enumerate(pieces):
            node = 0
            for b in p:
                nxt = tree[node].get(b)
                if nxt is None:
                    nxt = tree[node][b] = len(tree)
                    tree.append({})
                    piece_at.append(-1)
                node = nxt
            piece_at[node] = k
        self.piece_at = np.array(piece_at, dtype=np.int32)
        self.root = np.zeros(256, dtype=np.int32)
        for b, node in tree[0].items():
            self.root[b] = node
        later = sorted({b for t in tree[1:] for b in t})
        self.kind = np.zeros(256, dtype=np.int32)
        self.kind[later] = np.arange(1, len(later) + 1)
        inner = [i for i in range(1, len(tree)) if tree[i]]
        self.row = np.zeros(len(tree), dtype=np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.zeros((len(inner) + 1, len(later) + 1), dtype=np.int32)
        for i in inner:
            for b, node in tree[i].items():
                self.next[self.row[i], self.kind[b]] = node

    def _walk(self, text: np.ndarray, n: int):
        """(start, end, piece) of all pieces that start before n; a space ends each way through the tree."""
        at, node = np.arange(n, dtype=np.int32), self.root[text[:n]]
        starts, ends, pieces, size = [at], [at + 1], [self.piece_at[node]], 1
        while True:
            row = self.row[node]
            on = row > 0
            at, row = at[on], row[on]
            node = self.next[row, self.kind[text[at + size]]]
            on = node > 0
            at, node = at[on], node[on]
            size += 1
            if not len(at):
                break
            piece = self.piece_at[node]
            hit = piece >= 0
            starts.append(at[hit])
            ends.append(at[hit] + size)
            pieces.append(piece[hit])
        return tuple(map(np.concatenate, (starts, ends, pieces)))

    def edges(self, words: list[bytes]):
        """Edges of all words, sorted by the distance of their end from the word's begin, then by end."""
        text = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        offset = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(lengths, out=offset[1:])
        n = int(offset[-1])
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        start, end, piece = self._walk(text, n)
        w = word[start]
        step = end - offset[w]
        # Boundaries: one more than bytes for each word.
        key = step.astype(np.int64) * (n + len(words) + 1) + end + w
        order = np.argsort(key)
        start, end, piece, step = (start + w)[order], (end + w)[order], piece[order], step[order]
        first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        by_step = np.searchsorted(step, np.arange(1, int(step[-1]) + 2))
        return start, end, piece, first, by_step, offset[:-1] + np.arange(len(words)), offset[1:] + np.arange(len(words)), n + len(words)

    def _sum(self, words, scores):
        start, end, piece, first, by_step, begins, finals, total = self.edges(words)
        alpha = np.full((total, scores.shape[1]), -np.inf)
        alpha[begins] = 0.0
        value = np.empty((len(start), scores.shape[1]))
        groups = np.searchsorted(first, by_step)
        for t in range(len(by_step) - 1):
            a, b, ga, gb = by_step[t], by_step[t + 1], groups[t], groups[t + 1]
            v = alpha[start[a:b]] + scores[piece[a:b]]
            own = first[ga:gb] - a
            top = np.maximum.reduceat(v, own, axis=0)
            sizes = np.diff(np.r_[own, b - a])
            total_at = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, sizes, axis=0)), own, axis=0))
            alpha[end[first[ga:gb]]] = total_at
            value[a:b] = v - np.repeat(total_at, sizes, axis=0)
        return alpha, value, start, end, piece, by_step, finals, total

    def _segments(self, word: bytes):
        """Begins of segments of a long word's text, and the text with a space after it."""
        text = np.frombuffer(b" " + word + b" ", dtype=np.uint8)
        return range(0, len(text) - 1, SEGMENT), text

    def _long(self, word: bytes, scores: np.ndarray, keep: bool = False):
        """Natural log of a long word's probability under one model; with `keep` that of each of its beginnings."""
        begins, text = self._segments(word)
        n, weight, shift = len(text) - 1, np.exp(scores), 0.0
        alpha = [1.0]
        kept = np.empty(n + 1) if keep else None
        for s in begins:
            size = min(SEGMENT, n - s)
            start, end, piece = self._walk(text[s : s + size + self.longest + 1], size)
            order = np.argsort(start, kind="stable")
            firsts = np.searchsorted(start[order], np.arange(size + 1)).tolist()
            ends, weights = end[order].tolist(), weight[piece[order]].tolist()
            alpha += [0.0] * (size + self.longest + 1 - len(alpha))
            for i in range(size):
                a = alpha[i]
                if a < 1e-150:
                    for j in range(i, i + self.longest + 1):
                        alpha[j] *= 1e150
                    shift -= 150 * LN10
                    a = alpha[i]
                if keep:
                    kept[s + i] = np.log(a) + shift
                for e in range(firsts[i], firsts[i + 1]):
                    alpha[ends[e]] += a * weights[e]
            alpha = alpha[size:]
        total = float(np.log(alpha[0])) + shift
        if keep:
            kept[n] = total
            return kept
        return total

    def _long_uses(self, word: bytes, weight: float, scores: np.ndarray) -> np.ndarray:
        """Expected uses of the pieces in a long word, from the last segment of ends to the first."""
        begins, text = self._segments(word)
        n, reached, out = len(text) - 1, self._long(word, scores, True), np.zeros(self.count)
        mass = [0.0] * self.longest + [weight]  # at the boundaries up to the end of the segment
        for s in reversed(begins):
            size, low = min(SEGMENT, n - s), max(0, s - self.longest)
            start, end, piece = (x.astype(np.int64) for x in self._walk(text[low : s + size + self.longest + 1], s + size - low))
            on = (end + low > s) & (end + low <= s + size)
            start, end, piece = start[on] + low, end[on] + low, piece[on]
            share = np.exp(reached[start] + scores[piece] - reached[end])
            order = np.argsort(-end, kind="stable")
            base = s + size  # mass[-1] stands for this boundary
            mass = [0.0] * (base - low + 1 - len(mass)) + mass if base - low + 1 > len(mass) else mass[len(mass) - (base - low + 1) :]
            used = np.empty(len(order))
            at = zip((start[order] - low).tolist(), (end[order] - low).tolist(), share[order].tolist(), strict=True)
            for k, (a, b, part) in enumerate(at):
                part *= mass[b]
                mass[a] += part
                used[k] = part
            out += np.bincount(piece[order], used, self.count)
            mass = mass[: s - low + 1]
        return out

    def forward(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability under each column of `scores` (pieces x models)."""
        out = np.zeros((len(words), scores.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if short:
            alpha, *_, finals, _ = self._sum([words[i] for i in short], scores)
            out[short] = alpha[finals]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = [self._long(w, scores[:, k]) for k in range(scores.shape[1])]
        return out

    def marginals(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """The same as `forward`, with plain products for words that these can hold; others go through log space."""
        out = np.empty((len(words), scores.shape[1]))
        short = np.fromiter((len(w) <= 32 for w in words), dtype=bool, count=len(words))
        if short.any():
            own = [w for w, s in zip(words, short, strict=True) if s]
            start, end, piece, first, by_step, begins, finals, total = self.edges(own)
            groups = np.searchsorted(first, by_step)
            bounds = list(zip(by_step[:-1].tolist(), by_step[1:].tolist(), groups[:-1].tolist(), groups[1:].tolist(), strict=True))
            ends = end[first]
            found = np.empty((len(own), scores.shape[1]))
            for k in range(scores.shape[1]):
                alpha, weight = np.zeros(total), np.exp(scores[:, k])[piece]
                alpha[begins] = 1.0
                for a, b, ga, gb in bounds:
                    alpha[ends[ga:gb]] = np.add.reduceat(alpha[start[a:b]] * weight[a:b], first[ga:gb] - a)
                found[:, k] = alpha[finals]
            fine = found.min(axis=1) > 1e-280
            short[np.flatnonzero(short)[~fine]] = False
            out[short] = np.log(found[fine])
        rest = np.flatnonzero(~short)
        if len(rest):
            out[rest] = self.forward([words[i] for i in rest.tolist()], scores)
        return out

    def expect(self, words: list[bytes], weights: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Expected number of times each piece is used, words weighted, under one model."""
        out = np.zeros(self.count)
        for w, n in zip(words, weights.tolist(), strict=True):
            if len(w) > LONG:
                out += self._long_uses(w, n, scores)
        short = np.array([len(w) <= LONG for w in words], dtype=bool)
        words, weights = [w for w in words if len(w) <= LONG], np.asarray(weights)[short]
        if not words:
            return out
        _, value, start, end, piece, by_step, finals, total = self._sum(words, scores[:, None])
        share = np.exp(value[:, 0])
        mass = np.zeros(total)
        mass[finals] = weights
        for t in range(len(by_step) - 2, -1, -1):
            a, b = by_step[t], by_step[t + 1]
            share[a:b] *= mass[end[a:b]]
            mass[start[a:b]] += share[a:b]  # at one step no two edges begin at the same boundary
        return out + np.bincount(piece, share, self.count)


def chunks(words: list, limit: int = 50_000):
    """Slices of a list of words with about `limit` bytes together."""
    begin = total = 0
    for i, w in enumerate(words):
        total += len(w) + 1
        if total >= limit:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(words):
        yield begin, len(words)


def new_scores(expected: np.ndarray, extra: float = 0.0, smooth: float = 0.1) -> np.ndarray:
    """Log probabilities from expected uses; `extra` is the mass of what else the model can emit."""
    return np.log((expected + smooth) / (expected.sum() + extra + smooth * (len(expected) + (extra > 0))))
