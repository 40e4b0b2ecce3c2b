"""SentencePiece encoding and decoding: distinct sampled segmentations of whole texts.

The lattice of a text has an edge for every vocabulary piece. A segmentation's
probability is the product of its pieces', to the power ``alpha``, over the sum
for the lattice. Top-k sampling without replacement gives every segmentation
the key log p + Gumbel noise and takes the k largest. They are found without
enumeration by a perturbed best-first (A*) search from the top: the largest key
of a set of segmentations is Gumbel around the log of the set's mass, which
the lattice's backward sums give exactly, and once the best is split off, the
largest key of the rest is Gumbel truncated at it. The first sample draws its
pieces left to right; at every position the other edges form a group with a
truncated key on the agenda. The best group on the agenda gives the next
sample: it leaves the known path there, by an edge not used yet, and draws on.
The best key left after k samples is the threshold of the inclusion scores.

No piece spans words, so lattices are built once for each distinct word of
a batch and positions of many texts advance together as numpy arrays. A word
of more than LONGEST signs is built in segments from its end: pieces may span the
seams, where the backward sums are handed over. A task holds about 180 bytes for
each character of the distinct words of one batch, or of one longer text.
Random numbers are hashes of (row key, seed, sample, position): results do not
depend on batches, partitions or retries.

The vocabulary file is only read. Its scores are merge ranks, not
probabilities, so a piece of rank r gets probability 1 / (r + 2.7), scaled to
sum to one over the pieces, which are as Zipf's law has them.
"""

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.5
K = 2
#: Bytes of texts that are sampled together and share the lattices of their words; a longer text is alone.
BATCH_BYTES = 500_000
#: Characters of words whose lattices are built at once; memory beside the finished lattices grows with it only.
BUILD_CHARS = 60_000
MARK = "▁"
#: Longer words than this are alone: built in segments of so many signs and walked sign by sign, since nothing runs beside them.
LONGEST = 4096
#: Spaces lead a word; no piece holds a line end beside another sign, nor a space after one.
WORD = re.compile(r" *[^ \n]+| +|\n")
M64 = (1 << 64) - 1
SPREAD = 0x9E3779B97F4A7C15
#: Units of the integer sums of chances and of log chances.
SCALE_P, SCALE_LOG = float(1 << 50), float(1 << 32)


class Vocabulary:
    """Pieces as a trie: a hash table (node, code point) -> node, and the piece that ends at a node."""

    def __init__(self, model: str):
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=model)
        size = read.get_piece_size()
        self.text: list[bytes] = [b""] * size
        self.byte = np.zeros(256, np.int64)
        self.by_text: dict[str, int] = {}
        for i in range(size):
            piece = read.id_to_piece(i)
            if read.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (read.is_control(i) or read.is_unknown(i)):
                plain = piece.replace(MARK, " ")
                if " " in plain[1:] and plain.strip(" "):
                    raise ValueError(f"piece {i} spans words")
                self.text[i] = plain.encode()
                self.by_text[plain] = i
        rank = np.arange(size, dtype=np.float64)
        first = min(self.by_text.values())
        mass = 1 / (np.maximum(rank - first, 0) + 2.7)
        mass[: first] = 1 / (size + 2.7)  # byte pieces rank last
        self.logp = np.log(mass / mass.sum())
        self.byte_logp = float(self.logp[self.byte[0]])
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for plain, i in self.by_text.items():
            at = 0
            for c in map(ord, plain):
                at = nodes.setdefault((at, c), len(nodes) + 1)
                if at == len(ends):
                    ends.append(-1)
            ends[at] = i
        # Open addressing, at most an eighth full; -1 marks a free slot.
        self.bits = (8 * len(nodes)).bit_length()
        self.keys, self.child = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        free = (1 << self.bits) - 1
        for (n, c), k in nodes.items():
            slot = (((n << 21 | c) * SPREAD) & M64) >> (64 - self.bits)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & free
            self.keys[slot], self.child[slot] = n << 21 | c, k
        #: Child of the root by code point; 0 for none.
        self.first = np.zeros(0x110000, np.int32)
        self.first[[c for n, c in nodes if n == 0]] = [k for (n, _), k in nodes.items() if n == 0]
        self.ends = np.array(ends, np.int64)
        self.longest = max(map(len, self.by_text))
        if any("\n" in t and t != "\n" for t in self.by_text):
            raise ValueError("a piece holds a line end")
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.width = np.array([len(t) for t in self.text], np.int64)
        self.offset = np.cumsum(self.width) - self.width

    def below(self, nodes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child by their sign, and these children."""
        key = (nodes.astype(np.int64) << 21) | chars
        slot = ((key.view(np.uint64) * np.uint64(SPREAD)) >> np.uint64(64 - self.bits)).view(np.int64)
        found = self.keys[slot]
        over = np.flatnonzero((found != key) & (found >= 0))
        while len(over):
            slot[over] = (slot[over] + 1) & (len(self.keys) - 1)
            found[over] = self.keys[slot[over]]
            over = over[(found[over] != key[over]) & (found[over] >= 0)]
        hit = np.flatnonzero(found >= 0)
        return hit, self.child[slot[hit]]

    def joined(self, ids) -> bytes:
        """Bytes of piece ids."""
        ids, out = np.asarray(ids, np.int64), []
        for a in range(0, len(ids), BUILD_CHARS):
            part = ids[a : a + BUILD_CHARS]
            width = self.width[part]
            ends = width.cumsum()
            at = (self.offset[part] - ends + width).repeat(width)
            at += np.arange(len(at))
            out.append(self.flat[at].tobytes())
        return b"".join(out)

    def decode(self, ids) -> str:
        """Text of piece ids: bytes and pieces joined, less the space put before the text."""
        return self.joined(ids).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser of uint64 values."""
    x = x + np.uint64(SPREAD)
    spare = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(x, np.uint64(shift), out=spare)
        x ^= spare
        x *= np.uint64(factor)
    return x


def uniforms(seeds: np.ndarray, stream: int, at: np.ndarray) -> np.ndarray:
    """In (0, 1), one for each (seed, stream, position)."""
    bits = at.astype(np.uint64)
    bits *= np.uint64(0xA0761D6478BD642F)
    bits += seeds
    bits += np.uint64((stream * 0xD6E8FEB86659FD93) & M64)
    bits = mixed(bits)
    bits >>= np.uint64(11)
    out = bits.astype(np.float64)
    out += 0.5
    out *= 1 / (1 << 53)
    return out


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        return value


class Lattices:
    """Lattices of the distinct words of a batch, in flat arrays.

    Word w has nodes first_node[w] .. first_node[w] + its length; node n has the
    edges first_edge[n] .. first_edge[n + 1], longest piece first, with their
    log chances given the node, cumulated chances, lengths and pieces (-1: bytes).
    """

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        self.v, self.alpha = vocabulary, alpha

    def of(self, words: list[str]) -> np.ndarray:
        """Builds the lattices of the distinct words; returns the word number of each word."""
        number = _Numbers()
        numbers = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        unique = list(number)
        ends = np.cumsum([len(w) for w in unique])
        parts, first = [], 0
        while first < len(unique) or not parts:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BUILD_CHARS, "right")))
            last = next((i for i in range(first, min(last, len(unique))) if len(unique[i]) > LONGEST), last)
            parts.append(self._build(unique[first:last]) if last > first else self._build_long(unique[first]))
            first = max(last, first + 1)
        char, count, length, self.cum, self.logp, self.span, self.piece = (np.concatenate(x) for x in zip(*parts))
        self.char, self.length = char, length.astype(np.int64)
        self.first_node = np.cumsum(self.length + 1) - self.length - 1
        self.first_edge = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        return numbers

    def _edges(self, chars: np.ndarray, n: int, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges from each of the first ``n`` signs, which have ``left`` signs up to their word's end: counts, spans, pieces, tempered log chances."""
        v = self.v
        found = []  # (starts, piece) of each length
        state = v.first[chars[:n]]
        at = np.flatnonzero(state)
        state = state[at]
        step = 0
        while len(at):
            if step:
                hit, state = v.below(state, chars[at + step])
                at = at[hit]
            step += 1
            piece = v.ends[state]
            whole = piece >= 0
            found.append((at[whole], piece[whole]))
            more = left[at] > step
            at, state = at[more], state[more]
        single = np.zeros(n, bool)
        if found:
            single[found[0][0]] = True
        alone = np.flatnonzero(~single)  # written as bytes
        count = np.bincount(alone, minlength=n)
        for starts, _ in found:
            count[starts] += 1
        first = np.cumsum(count) - count
        # Edges are put in their places by character, longest last to first: no sort.
        edges = int(count.sum())
        span, kind, score = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        place = first + count - 1
        width = 1 + (chars[alone] > 0x7F) + (chars[alone] > 0x7FF) + (chars[alone] > 0xFFFF)
        span[place[alone]], kind[place[alone]], score[place[alone]] = 1, -1, width * v.byte_logp
        place[alone] -= 1
        for k, (starts, piece) in enumerate(found):
            to = place[starts]
            span[to], kind[to], score[to] = k + 1, piece, v.logp[piece]
            place[starts] -= 1
        score *= self.alpha
        return count, span, kind, score

    @staticmethod
    def _chances(count: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cumulated chances, and log chances, of the edges of each node."""
        first = np.cumsum(count) - count
        logp[np.repeat(count == 1, count)] = 0.0
        # In integers, whose sums wrap round exactly: a word's lattice depends on no other word.
        part = np.rint(np.exp(logp) * SCALE_P).astype(np.uint64)
        run = np.cumsum(part)
        cum = (run - np.repeat((run - part)[first], count)) / SCALE_P
        cum[first + count - 1] = 1.0
        return cum, logp

    def _build(self, unique: list[str]) -> tuple[np.ndarray, ...]:
        """Of some words: sign and edges of each node, lengths, and cumulated and log chances, span and piece of each edge."""
        length = np.fromiter(map(len, unique), np.int64, len(unique))
        chars = np.frombuffer("".join(unique).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(chars)
        node = np.arange(n) + np.repeat(np.arange(len(unique)), length)  # every word has one node more than characters
        left = np.repeat(np.cumsum(length), length) - np.arange(n)  # characters up to the word's end
        count, span, kind, score = self._edges(chars, n, left)
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(n), count)
        target = node[owner] + span
        # Log of the summed weights from each node to its word's end, from the ends backwards.
        total = np.zeros(n + len(unique))
        order = np.argsort(left.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                own = order[a:b]
                c = count[own]
                lead = np.cumsum(c) - c
                edge = np.repeat(first[own] - lead, c) + np.arange(int(c.sum()))
                total[node[own]] = np.logaddexp.reduceat(score[edge] + total[target[edge]], lead)
        cum, logp = self._chances(count, score + total[target] - total[node[owner]])
        char = np.zeros(n + len(unique), np.uint32)
        char[node] = chars
        at_node = np.zeros(n + len(unique), np.int32)
        at_node[node] = count
        return char, at_node, length, cum, logp, span, kind

    def _build_long(self, word: str) -> tuple[np.ndarray, ...]:
        """The same of one long word, segment by segment from its end; a segment needs the sums of as many nodes after it as the longest piece has signs."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(chars)
        at_node = np.zeros(n + 1, np.int32)
        after = np.zeros(1)  # sums of the nodes from the segment's end on
        parts = []
        for a in range((n - 1) // LONGEST * LONGEST, -1, -LONGEST):
            b = min(n, a + LONGEST)
            count, span, kind, score = self._edges(chars[a : min(n, b + self.v.longest)], b - a, np.arange(n - a, n - b, -1))
            sums = [0.0] * (b - a) + after.tolist()
            edges, spans, e = score.tolist(), span.tolist(), len(score)
            for i in range(b - a - 1, -1, -1):
                c = int(count[i])
                e -= c
                terms = [edges[k] + sums[i + spans[k]] for k in range(e, e + c)]
                most = max(terms)
                sums[i] = most + math.log(sum([math.exp(t - most) for t in terms])) if c > 1 else most
            total = np.array(sums)
            owner = np.repeat(np.arange(b - a), count)
            cum, logp = self._chances(count, score + total[owner + span] - total[owner])
            parts.append((cum, logp, span, kind))
            at_node[a:b] = count
            after = total[: self.v.longest + 1].copy()
        cum, logp, span, kind = (np.concatenate(x[::-1]) for x in zip(*parts))
        return np.append(chars, np.uint32(0)), at_node, np.array([n]), cum, logp, span, kind

    def source(self, edges: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_edge, edges, side="right") - 1

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that u falls on; the first edges, of the longest pieces, are the likeliest."""
        edge = self.first_edge[node].copy()
        over = np.flatnonzero(u >= self.cum[edge])
        while len(over):
            edge[over] += 1
            over = over[u[over] >= self.cum[edge[over]]]
        return edge


class Path:
    """Decisions of one sample of each of some texts, in order: text, position, node, edge, and the agenda's keys.

    ``start[d]`` .. ``start[d + 1]`` are those of text d. A path of a later
    sample holds only what comes after it left its parent.
    """

    def __init__(self, texts: int, doc, at, node, edge):
        self.doc, self.at, self.node, self.edge = doc, at, node, edge
        self.start = np.searchsorted(doc, np.arange(texts + 1))


def _walk(lat: Lattices, texts: int, doc, at, node, end, seeds, stream: int) -> Path:
    """Draw pieces from ``node`` to ``end`` for every word part (of text ``doc``, at position ``at``), parts in order."""
    taken = np.zeros(len(node), np.int64)
    far = end - node > LONGEST
    alone = {int(p): _walk_alone(lat, int(at[p]), int(node[p]), int(end[p]), seeds[doc[p]], stream) for p in np.flatnonzero(far)}
    part = np.flatnonzero((node < end) & ~far)
    steps = []
    while len(part):
        now, place = node[part], at[part]
        edge = lat.draw(now, uniforms(seeds[doc[part]], stream, place))
        steps.append((part, place, now, edge))
        span = lat.span[edge]
        at[part] = place + span
        now = now + span
        node[part] = now
        taken[part] += 1
        part = part[now < end[part]]
    for p, found in alone.items():
        taken[p] = found.shape[1]
    # A part's decisions stand one after the other.
    slot = np.cumsum(taken) - taken
    out = np.empty((3, int(taken.sum())), np.int64)
    for k, (part, *values) in enumerate(steps):
        out[:, slot[part] + k] = values
    for p, found in alone.items():
        out[:, slot[p] : slot[p] + taken[p]] = found
    return Path(texts, np.repeat(doc, taken), *out)


def _walk_alone(lat: Lattices, at: int, node: int, end: int, seed: np.uint64, stream: int) -> np.ndarray:
    """(position, node, edge) of the pieces drawn from ``node`` to ``end`` of one long word, some signs at a time."""
    parts, shift = [], at - node
    while node < end:
        base, stop = node, min(end, node + LONGEST)
        u = uniforms(np.full(stop - base, seed), stream, np.arange(base + shift, stop + shift)).tolist()
        first = lat.first_edge[base : stop + 1].tolist()
        cum, span = lat.cum[first[0] : first[-1]].tolist(), lat.span[first[0] : first[-1]].tolist()
        nodes, edges = [], []
        while node < stop:
            edge, draw = first[node - base] - first[0], u[node - base]
            while draw >= cum[edge]:
                edge += 1
            nodes.append(node)
            edges.append(edge + first[0])
            node += span[edge]
        parts.append(np.array([nodes, nodes, edges]))
    out = np.concatenate(parts, axis=1)
    out[0] += shift
    return out


def _truncated(mass, most, u):
    """Gumbel around ``mass`` given that it is below ``most``; a set without mass has the key -inf."""
    return mass - np.log(np.exp(np.minimum(mass - most, 700)) - np.log(u))


def sample_texts(lat: Lattices, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations, largest key first: (ids, log p, key, log of the inclusion chance)."""
    n = len(texts)
    cut = WORD.findall
    words: list[str] = []
    counts = []
    for t in texts:
        found = cut(" " + t) if t else []
        counts.append(len(found))
        words += found
    ids = lat.of(words)
    doc = np.repeat(np.arange(n), counts)
    size = lat.length[ids]
    first_word = np.cumsum(counts) - counts
    at = np.cumsum(size) - size
    head = np.repeat(at[np.minimum(first_word, max(0, len(at) - 1))], counts) if len(at) else at
    at = at - head
    first, end = lat.first_node[ids], lat.first_node[ids] + size
    root = -np.log(-np.log(uniforms(seeds, 1, np.zeros(n, np.int64))))
    lattice_edges = np.diff(lat.first_edge)

    def keys_for(path: Path, before: np.ndarray, most: np.ndarray, stream: int) -> None:
        """Log p up to each decision, and the key of the group of its other edges."""
        step = lat.logp[path.edge]
        # Integer sums again: texts of a batch do not touch each other's last digits.
        part = np.rint(step * SCALE_LOG).astype(np.int64)
        run = np.concatenate([[0], np.cumsum(part)])
        base = run[path.start[:-1]]
        of_doc = np.diff(path.start)
        path.prefix = (run[:-1] - base.repeat(of_doc)) / SCALE_LOG + before.repeat(of_doc)
        path.total = (run[path.start[1:]] - base) / SCALE_LOG + before
        one = lattice_edges[path.node] == 1
        with np.errstate(divide="ignore"):
            rest = np.where(one, -np.inf, np.log(np.maximum(-np.expm1(step), 1e-300)))
        path.keys = _truncated(path.prefix + rest, most.repeat(of_doc), uniforms(seeds.repeat(of_doc), stream, path.at))

    zero = np.zeros(n)
    path = _walk(lat, n, doc, at.copy(), first.copy(), end, seeds, 2)
    keys_for(path, zero, root, 3)
    paths, tops = [path], []
    samples: list[list[tuple[np.ndarray, float, float]]] = [[(path.edge[path.start[d] : path.start[d + 1]], float(path.total[d]), float(root[d]))] for d in range(n)]
    #: How sample r of a text came about: (parent path, decision in it, edges taken there so far).
    used: dict[tuple[int, int, int], list[int]] = {}
    origin: dict[tuple[int, int], tuple[int, int, int]] = {}

    def best_of(path: Path) -> np.ndarray:
        some = path.start[1:] > path.start[:-1]
        best = np.full(n, -np.inf)
        if some.any():
            best[some] = np.maximum.reduceat(path.keys, path.start[:-1][some])
        return best

    tops.append(best_of(path))
    for r in range(1, k):
        top = np.stack(tops)
        which = top.argmax(axis=0)
        key = top[which, np.arange(n)]
        go = np.flatnonzero(key > -np.inf)
        if not len(go):
            break
        part_doc, part_at, part_node, part_end = [], [], [], []
        before = np.zeros(n)
        taken = np.full(n, -1, np.int64)
        chosen = []
        for d in go.tolist():
            source = paths[which[d]]
            a = int(source.start[d])
            chosen.append(a + int(source.keys[a : source.start[d + 1]].argmax()))
        place = np.array([paths[q].at[i] for q, i in zip(which[go].tolist(), chosen)])
        turns = uniforms(seeds[go], 10 * r + 4, place).tolist()
        remains = np.log(uniforms(seeds[go], 10 * r + 5, place)).tolist()
        for d, i, u, left in zip(go.tolist(), chosen, turns, remains):
            q = int(which[d])
            source = paths[q]
            node = int(source.node[i])
            out = used.setdefault((d, q, i), [int(source.edge[i])])
            e0, e1 = int(lat.first_edge[node]), int(lat.first_edge[node + 1])
            p = np.exp(lat.logp[e0:e1])
            p[[e - e0 for e in out]] = 0.0
            c = np.cumsum(p)
            edge = e0 + min(int(c.searchsorted(u * c[-1], side="right")), int(p.nonzero()[0][-1]))
            out.append(edge)
            rest = float(c[-1] - p[edge - e0]) if len(out) < e1 - e0 else 0.0
            mass = float(source.prefix[i]) + math.log(rest) if rest > 0 else -math.inf
            source.keys[i] = -math.inf if rest <= 0 else mass - math.log(math.exp(min(mass - key[d], 700)) - left)
            taken[d], before[d] = edge, source.prefix[i] + lat.logp[edge]
            origin[(d, r)] = (q, i, edge)
            # The rest of this word after the edge, then the words that follow.
            span = int(lat.span[edge])
            w = int(first_word[d]) + int(at[first_word[d] : first_word[d] + counts[d]].searchsorted(source.at[i], side="right")) - 1
            part_doc.append(np.full(first_word[d] + counts[d] - w, d))
            part_at.append(at[w : first_word[d] + counts[d]].copy())
            part_node.append(first[w : first_word[d] + counts[d]].copy())
            part_end.append(end[w : first_word[d] + counts[d]])
            part_at[-1][0], part_node[-1][0] = source.at[i] + span, node + span
        path = _walk(lat, n, *(np.concatenate(x) for x in (part_doc, part_at, part_node, part_end)), seeds, 10 * r + 6)
        keys_for(path, before, key, 10 * r + 7)
        paths.append(path)
        for q in set(which[go].tolist()):
            tops[q] = best_of(paths[q])
        tops.append(best_of(path))
        for d in go.tolist():
            q, i, edge = origin[(d, r)]
            # Decisions before the one left: of the parent path, and of what that had left in turn.
            back, to, of = [], i, q
            while True:
                back.append(paths[of].edge[int(paths[of].start[d]) : to])
                if of == 0:
                    break
                parent, j, took = origin[(d, of)]
                back.append(np.array([took]))
                to, of = j, parent
            tail = path.edge[path.start[d] : path.start[d + 1]]
            samples[d].append((np.concatenate([*back[::-1], [edge], tail]), float(path.total[d]), float(key[d])))
    threshold = np.stack(tops).max(axis=0)
    return [[(_ids(lat, e), lp, g, _inclusion(lp, float(threshold[d]))) for e, lp, g in samples[d]] for d in range(n)]


def _inclusion(logp: float, threshold: float) -> float:
    """Log of the chance that the key of a segmentation exceeds the best key that was not taken."""
    if threshold == -np.inf:
        return 0.0
    return float(np.log(-np.expm1(-np.exp(min(logp - threshold, 700)))) if logp - threshold > -30 else logp - threshold)


def _ids(lat: Lattices, edges: np.ndarray) -> np.ndarray:
    """Piece ids of edges; a sign outside the vocabulary becomes its bytes in UTF-8."""
    piece = lat.piece[edges.astype(np.int64, copy=False)]
    if piece.min(initial=0) >= 0:
        return piece
    lost = np.flatnonzero(piece < 0)
    text = lat.char[lat.source(edges[lost].astype(np.int64))].tobytes().decode("utf-32-le", "surrogatepass")
    coded = text.encode("utf-8", "surrogatepass")
    width = np.array([len(c.encode("utf-8", "surrogatepass")) for c in text]) if len(coded) > len(text) else 1
    count = np.ones(len(piece), np.int64)
    count[lost] = width
    out = np.repeat(piece, count)
    out[out < 0] = lat.v.byte[np.frombuffer(coded, np.uint8)]
    return out


SAMPLES = "sample int, n_pieces int, log_prob double, log_inclusion double, ids_sha256 string, decodes boolean"


def sample_segmentations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, alpha: float = ALPHA, seed: int = 0, model: str = MODEL, with_ids: bool = True
) -> DataFrame:
    """Up to ``k`` distinct sampled segmentations of every text: a row each, by falling perturbed key.

    Columns: the id, ``sample`` (1 to k), ``n_pieces``, ``log_prob`` (of the
    segmentation under the tempered lattice), ``log_inclusion`` (of the chance
    that a draw without replacement includes it), ``ids_sha256`` (of the ids as
    little-endian int32), ``decodes`` (decoding gives the text back), and
    ``ids`` with ``with_ids``.

    Edge cases: null and empty texts have the one segmentation of no pieces.
    Texts with fewer than k segmentations give all of them, each with inclusion
    chance 1. Rows with equal ids and texts give equal samples; a null id seeds
    like any value. Signs outside the vocabulary are written as byte pieces.
    Words have no bound: a text of one endless word takes memory and time in
    proportion to its length, as one of many words does.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("_seed"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
    names = ["_id", *[f.split()[0] for f in SAMPLES.split(", ")], *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        lat = Lattices(known, alpha)

        def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            seeds = mixed(batch.column(1).to_numpy().view(np.uint64))
            out, whose, flat = [], [], []
            for i, samples in enumerate(sample_texts(lat, texts, seeds, k)):
                plain = texts[i].encode()
                for j, (ids, logp, _, inclusion) in enumerate(samples):
                    ids = ids.astype("<i4")
                    out.append((j + 1, len(ids), logp, inclusion, hashlib.sha256(ids.tobytes()).hexdigest(), known.joined(ids)[1:] == plain))
                    whose.append(i)
                    if with_ids:
                        flat.append(ids)
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            if with_ids:
                ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat))))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose)), *columns], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.cumsum([len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column(2)]) // BATCH_BYTES
            starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                yield describe(batch.slice(a, b - a))

    declared = f"_id {kind}, {SAMPLES}" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, declared).withColumnRenamed("_id", id_col)


def decode_ids(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add the text of piece ids; null ids give null, unknown ids raise."""
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        known = vocabulary(model)
        return ids.map(lambda x: None if x is None else known.decode(x))

    return df.withColumn(out_col, decode(F.col(ids_col)))


def op10_piece_samples(spark, sf_dir: str) -> DataFrame:
    from nimboscale.session import table

    return sample_segmentations(table(spark, sf_dir, "documents").select("doc_id", "text"))
