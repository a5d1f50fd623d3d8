"""Encoding into the pieces of a merge-type vocabulary with seeded merge-dropout, and lossless decoding.

A text starts as its characters. An agenda holds the possible merges of neighbours; the one of the best score,
then the leftmost, is taken each time. A candidate is skipped for good with a given probability, decided by a
hash keyed by the seed, the row and the place of the word's occurrence, so that every occurrence has skips of its
own and a seed gives the same result wherever and however often a task runs. Characters outside the vocabulary
become byte pieces, so decoding restores the text.

No piece crosses from another character to a blank or a line break, so texts are encoded word by word. What a
word becomes depends on the steps of its agenda that are skipped, and on nothing else: words and their skipped
steps make a tree whose nodes are learnt as occurrences reach them. Occurrences descend it by their own draws, all
of a batch at once. The agendas of all new nodes are processed in lock step; very long words have a heap each.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from simloom.llm import worker
from simloom.llm.shingles import mix

_U = np.uint64
#: Stands for a blank in the vocabulary's pieces. Blanks are kept as such here; this character itself is not in
#: the vocabulary and so becomes bytes.
BLANK = "\u2581"
WORDS = re.compile(r" *[^ \n]+|\n| +")


@dataclass(frozen=True)
class Dropout:
    """Probability that a merge is skipped, and the seed."""

    p: float = 0.1
    seed: int = 0


class Tree:
    """Words by the steps that were skipped: each node's number of steps and ids, and its nodes below.

    A node is a word with some steps skipped. The node below at step ``k`` has that step skipped too, after all
    the others. ``used`` counts the occurrences that came through a node.
    """

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.below: dict[int, int] = {}
        self.names: list[str] = []
        self.ids: list[bytes] = []
        self.skips: list[tuple[int, ...]] = []
        self.steps = np.zeros(1024, dtype=np.int64)
        self.used = np.zeros(1024, dtype=np.int64)

    def add(self, names: list[str], skips: list[tuple[int, ...]], ids: list[bytes], steps: np.ndarray) -> None:
        n = len(self.ids)
        self.names += names
        self.skips += skips
        self.ids += ids
        if len(self.ids) > len(self.steps):
            more = np.zeros(len(self.ids), dtype=np.int64)
            self.steps, self.used = np.concatenate([self.steps, more]), np.concatenate([self.used, more])
        self.steps[n : len(self.ids)] = steps

    def pruned(self, most: int) -> Tree:
        """A tree of the nodes used most, ``most`` at most; a node is used as often as any below it."""
        n = len(self.ids)
        used = self.used[:n]
        least = 1 + int(np.partition(used, n - 1 - most)[n - 1 - most]) if most < n else 0
        keep = np.flatnonzero(used >= least)
        to = np.full(n, -1, dtype=np.int64)
        to[keep] = np.arange(len(keep))
        to = to.tolist()
        out = Tree()
        some = keep.tolist()
        out.add([self.names[k] for k in some], [self.skips[k] for k in some], [self.ids[k] for k in some], self.steps[keep])
        out.used[: len(keep)] = used[keep] // 2
        out.words = {w: to[k] for w, k in self.words.items() if to[k] >= 0}
        out.below = {to[k >> 8] << 8 | k & 255: to[x] for k, x in self.below.items() if to[x] >= 0}
        return out


class PieceCoder:
    """Encoder and decoder of one vocabulary and one dropout."""

    #: Longer words have heaps. Any other's agenda has less than 3 * LONG steps, as each merge adds two candidates at most.
    LONG = 48

    def __init__(self, path: str, dropout: Dropout = Dropout(), keep: int = 150_000):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout, self.keep = dropout, keep
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [0] * 256
        self.piece: dict[str, int] = {}
        self.score = np.full(n, -np.inf)
        for k in range(n):
            name = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte_id[int(name[3:5], 16)] = k
                self.bytes_of[k] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                text = name.replace(BLANK, " ")
                if "\n" in text or " " in text.lstrip(" "):
                    raise ValueError(f"a piece crosses words: {name!r}")
                self.piece[text] = k
                self.score[k] = sp.get_score(k)
                self.bytes_of[k] = text.encode()
        self.char = np.full(0x110000, -1, dtype=np.int32)
        pairs = []
        for text, k in self.piece.items():
            if len(text) == 1:
                self.char[ord(text)] = k
            pairs += [(self.piece[text[:c]] << 32 | self.piece[text[c:]], k) for c in range(1, len(text)) if text[:c] in self.piece and text[c:] in self.piece]
        pairs.sort()
        self.pair_keys = np.array([a for a, _ in pairs], dtype=np.int64)
        self.pair_ids = np.array([b for _, b in pairs], dtype=np.int32)
        self._table()
        # Scores as small numbers in the same order, equal ones equal.
        self.rank = np.unique(self.score, return_inverse=True)[1].astype(np.int32)
        # Entry k: a draw below it skips none of the first k + 1 steps.
        stay = [max(0.0, 1.0 - max(0.0, dropout.p)) ** (k + 1) for k in range(3 * self.LONG)]
        self.stay = np.array([min(2**64 - 1, int(x * 2**64)) for x in reversed(stay)], dtype=_U)
        self.drops = dropout.p > 0
        self.tree = Tree()

    @classmethod
    def shared(cls, path: str, dropout: Dropout) -> PieceCoder:
        made = worker.kept("pieces", dict)
        if (path, dropout) not in made:
            made[path, dropout] = cls(path, dropout)
        return made[path, dropout]

    def _keys(self, draws: np.ndarray) -> np.ndarray:
        """Keys of occurrences from their numbers."""
        return mix(_U(xxhash.xxh64_intdigest(f"{self.dropout.seed}")) ^ mix(draws))

    def _due(self, key: np.ndarray, at: np.ndarray | int, drawn: int) -> np.ndarray:
        """The step to skip next, from step ``at`` on; ``at + 3 * LONG`` means none before. ``drawn`` counts the draws before."""
        draw = mix(key + mix(np.array([drawn], dtype=_U)))
        return at + (len(self.stay) - np.searchsorted(self.stay, draw, side="right"))

    def _fallback(self, symbols: list[int], chars: list[str]) -> bytes:
        """Ids of symbols, with the bytes of the characters that are none."""
        out: list[int] = []
        for s, c in zip(symbols, chars, strict=True):
            out += [s] if s >= 0 else [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
        return np.array(out, dtype="<u4").tobytes()

    def heap_word(self, word: str, draw: int) -> bytes:
        """One occurrence of a word by a heap; ``draw`` is its number."""
        return self._heap(word, self._keys(np.array([draw], dtype=_U)))

    def _heap(self, word: str, key: np.ndarray) -> bytes:
        ids: list[int] = [self.piece.get(c, -1) for c in word]
        text = list(word)
        prev, nxt = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        alive = [True] * len(ids)
        step, drawn, start = -1, 0, 0
        due = int(self._due(key, 0, 0)[0]) if self.drops else -1
        agenda: list[tuple[float, int, int, int, int]] = []

        def add(a: int) -> None:
            b = nxt[a] if a >= 0 else len(ids)
            if b < len(ids) and ids[a] >= 0 and ids[b] >= 0 and (k := self.piece.get(text[a] + text[b])) is not None:
                heapq.heappush(agenda, (-self.score[k], a, k, ids[a], ids[b]))

        for a in range(len(ids) - 1):
            add(a)
        while agenda:
            _, a, k, left, right = heapq.heappop(agenda)
            b = nxt[a]
            if not alive[a] or b >= len(ids) or ids[a] != left or ids[b] != right:
                continue
            step += 1
            skip = False
            while step == due and not skip:
                skip = due - start < len(self.stay)
                drawn, start = drawn + 1, due + skip
                due = int(self._due(key, start, drawn)[0])
            if skip:
                continue
            ids[a], text[a] = k, text[a] + text[b]
            alive[b] = False
            nxt[a] = nxt[b]
            if nxt[a] < len(ids):
                prev[nxt[a]] = a
            add(prev[a])
            add(a)
        live = [k for k in range(len(ids)) if alive[k]]
        return self._fallback([ids[k] for k in live], [text[k] for k in live])

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        found = self.slots[at]
        out = np.where((found >= 0) & (self.pair_keys[found] == key), self.pair_ids[found], -1)
        todo = np.flatnonzero((found >= 0) & (out < 0) & (left >= 0) & (right >= 0))
        while len(todo):
            at = (at if len(at) == len(todo) else at[todo]) + 1 & len(self.slots) - 1
            found, some = self.slots[at], key[todo]
            out[todo] = np.where((found >= 0) & (self.pair_keys[found] == some), self.pair_ids[found], -1)
            more = (found >= 0) & (out[todo] < 0)
            at, todo = at[more], todo[more]
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(65 - len(self.slots).bit_length())).astype(np.int64)

    def _table(self) -> None:
        """An open hash table of the pairs, at most an eighth full."""
        self.slots = np.full(1 << (8 * max(1, len(self.pair_keys))).bit_length(), -1, dtype=np.int32)
        todo, at = np.arange(len(self.pair_keys)), self._slot(self.pair_keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            rest = self.slots[at] != todo
            todo, at = todo[rest], at[rest] + 1 & len(self.slots) - 1

    def _agendas(self, words: list[str], skips: list[tuple[int, ...]]) -> tuple[list[bytes], np.ndarray]:
        """Ids of words of like length with the given steps skipped, and the steps of each; all agendas at once.

        Arrays have a row for each place and a column for each word; places are told by their number in the flat
        array. The last row stands for both ends; nothing merges with it.
        """
        m, width = len(words), max(map(len, words))
        most = max(map(len, skips))
        skipped = np.array([x + (-1,) * (most - len(x)) for x in skips], dtype=np.int16).reshape(m, most).T
        steps = np.zeros(m, dtype=np.int64)
        codes = np.frombuffer("".join(w.ljust(width, "\n") for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(m, width).T
        size = np.fromiter(map(len, words), np.int32, m)
        place, word = np.arange(width + 1, dtype=np.int32)[:, None], np.arange(m, dtype=np.int32)
        end = width * m + word
        alive = place < size
        ids = np.full((width + 1, m), -1, dtype=np.int32)
        ids[:width] = np.where(alive[:width], self.char[codes], -1)
        nxt = np.where(place + 1 < size, (place + 1) * m + word, end).ravel()
        prev = np.where(place > 0, (place - 1) * m + word, end).ravel()
        alive, ids = alive.ravel(), ids.ravel()
        made = self._merged(ids, ids[nxt])
        # What is taken next is the greatest value of a column: by score, then by place.
        late = (255 - np.repeat(place.ravel(), m)).astype(np.int32)
        value = np.where(made >= 0, self.rank[made] << 8 | late, -1)
        columns = value.reshape(width + 1, m)
        step = -1
        while True:
            step += 1
            best = columns.max(0)
            go = np.flatnonzero(best >= 0)
            if not len(go):
                break
            steps[go] += 1
            a = (255 - (best[go] & 255)) * m + go
            if most:
                skip = (skipped[:, go] == step).any(0)
                value[a[skip]] = -1
                a = a[~skip]
            b = nxt[a]
            ids[a] = made[a]
            alive[b] = False
            value[b] = -1
            after = nxt[b]
            nxt[a] = after
            prev[after] = a
            x = np.concatenate([prev[a], a])
            k = self._merged(ids[x], ids[nxt[x]])
            made[x] = k
            value[x] = np.where(k >= 0, self.rank[k] << 8 | late[x], -1)
        alive, ids = alive.reshape(width + 1, m).T, ids.reshape(width + 1, m).T
        flat = ids[alive].astype("<u4").tobytes()
        ends = 4 * np.cumsum(alive.sum(1))
        out = [flat[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]
        for k in np.flatnonzero((alive & (ids < 0)).any(1)):
            some = np.flatnonzero(alive[k])
            out[k] = self._fallback(ids[k, some].tolist(), [words[k][j] for j in some])  # what has no piece is one character
        return out, steps

    def _learn(self, names: list[str], skips: list[tuple[int, ...]]) -> np.ndarray:
        """New nodes of the tree, their numbers in the order given."""
        size = np.fromiter(map(len, names), np.int64, len(names))
        order = np.argsort(size, kind="stable")
        first = len(self.tree.ids)
        at = 0
        while at < len(order):
            most = max(6, int(size[order[at]]) * 5 // 4)
            end = min(at + 5000, int(np.searchsorted(size, most, side="right", sorter=order)))
            some = order[at:end].tolist()
            words, steps = [names[k] for k in some], [skips[k] for k in some]
            self.tree.add(words, steps, *self._agendas(words, steps))
            at = end
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.arange(first, first + len(order))
        return out

    def _reached(self, words: list[str], key: np.ndarray) -> np.ndarray:
        """The node of each occurrence; nodes that are not yet in the tree are learnt."""
        tree = self.tree
        new = sorted(set(words).difference(tree.words))
        if new:
            tree.words.update(zip(new, self._learn(new, [()] * len(new)).tolist(), strict=True))
        node = np.fromiter(map(tree.words.__getitem__, words), np.int64, len(words))
        live = np.arange(len(words))
        due = np.zeros(len(words), dtype=np.int64)
        drawn = 0
        while len(live):
            n = len(tree.ids)
            tree.used[:n] += np.bincount(node[live], minlength=n)
            if not self.drops:
                break
            due[live] = self._due(key[live], due[live], drawn)
            live = live[due[live] < tree.steps[node[live]]]
            ways, which = np.unique(node[live] << 8 | due[live], return_inverse=True)
            new = [w for w in ways.tolist() if w not in tree.below]
            if new:
                made = self._learn([tree.names[w >> 8] for w in new], [(*tree.skips[w >> 8], w & 255) for w in new])
                tree.below.update(zip(new, made.tolist(), strict=True))
            node[live] = np.fromiter(map(tree.below.__getitem__, ways.tolist()), np.int64, len(ways))[which]
            due[live] += 1
            drawn += 1
        return node

    def _ids(self, words: list[str], numbers: np.ndarray) -> list[bytes]:
        """Ids of each occurrence of a word; its number decides its skips."""
        key = self._keys(numbers)
        if len(self.tree.ids) > self.keep:
            self.tree = self.tree.pruned(self.keep // 2)
        long = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) > self.LONG)
        short, some = np.ones(len(words), dtype=bool), words
        short[long] = False
        if len(long):
            some = [w for w, x in zip(words, short.tolist(), strict=True) if x]
        node = np.empty(len(words), dtype=np.int64)
        node[short] = self._reached(some, key[short])
        # Long words have heaps of their own, and numbers after all nodes of the tree.
        node[long] = len(self.tree.ids) + np.arange(len(long))
        ids = self.tree.ids + [self._heap(words[k], key[k : k + 1]) for k in long.tolist()] if len(long) else self.tree.ids
        return list(map(ids.__getitem__, node.tolist()))

    def lockstep(self, words: list[tuple[str, int]]) -> list[bytes]:
        """Occurrences of words, each with its number, by the tree."""
        return self._ids([w for w, _ in words], np.array([n for _, n in words], dtype=_U))

    def encode(self, rows: list[tuple[int | None, str]]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit; a row's number and a word's place decide the word's skips."""
        words: list[str] = []
        numbers, ends = [np.empty(0, dtype=_U)], [0]
        for number, text in rows:
            some = WORDS.findall(" " + text) if text else []
            words += some
            ends.append(len(words))
            numbers.append(_U(xxhash.xxh64_intdigest(f"{number}")) + np.arange(len(some), dtype=_U))
        ids = self._ids(words, np.concatenate(numbers))
        return [b"".join(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text of ids; one blank that encoding puts first is taken off."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.decode("utf-8", "surrogatepass").removeprefix(" ")


def _slices(n: int, sizes: Iterator[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Stretches of ``n`` rows whose sizes add up to a bounded number."""
    at, total, low = 0, 0, 0
    for at, size in enumerate(sizes):
        if at > low and total + size > most:
            yield low, at
            low, total = at, 0
        total += size
    if n > low:
        yield low, n


def encoded(text: Column, number: Column, path: str, dropout: Dropout = Dropout()) -> Column:
    """Binary ids (little-endian 32-bit) of each text; ``number`` decides the skips in the row's words.

    A null text gives null, an empty one no ids. Rows of equal text and number get equal ids; a null number is
    a number of its own.
    """

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for _, ids in _coded(PieceCoder.shared(path, dropout), batches):
            yield pa.array(ids, pa.binary())

    return run(text.cast("string"), number.cast("long"))


def _coded(coder: PieceCoder, batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[list[str | None], list[bytes | None]]]:
    """Texts and their ids, a bounded stretch of a batch at a time."""
    for texts, numbers in batches:
        for a, b in _slices(len(texts), (len(x.as_buffer()) if x.is_valid else 0 for x in texts)):
            some = texts.slice(a, b - a).to_pylist()
            ids = coder.encode([(n, x or "") for n, x in zip(numbers.slice(a, b - a).to_pylist(), some, strict=True)])
            yield some, [None if x is None else y for x, y in zip(some, ids, strict=True)]


def round_trip(text: Column, number: Column, path: str, dropout: Dropout = Dropout()) -> Column:
    """``struct<ids binary, text string>``: what ``encoded`` gives, and what ``decoded`` makes of it, by one coder.

    Both fields are null for a null text. A worker needs the vocabulary's tables once, and not for each of two
    functions.
    """

    @F.arrow_udf("ids binary, text string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        coder = PieceCoder.shared(path, dropout)
        for _, ids in _coded(coder, batches):
            back = [None if x is None else coder.decode(x) for x in ids]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=["ids", "text"])

    return run(text.cast("string"), number.cast("long"))


def decoded(ids: Column, path: str) -> Column:
    """The text of binary ids; null for null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = PieceCoder.shared(path, Dropout(0.0))
        for batch in batches:
            yield pa.array([coder.decode(x.as_py()) if x.is_valid else None for x in batch], pa.string())

    return run(ids)
