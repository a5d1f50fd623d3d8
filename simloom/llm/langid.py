"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed against
it greedily into phrases, each the longest match with any place of the sample. Fewer phrases mean that the
sample predicts the text better: phrases * log2(sample length) / text length estimates the cross entropy in
bits a letter. The language with the least estimate wins.

Automata are sparse: the transitions of one are a hash table, so every letter of the samples takes part, however
many there are. All texts of a batch walk an automaton in lock step. Long texts are laid out in blocks that are
parsed at once, each as if a phrase began with it; then the state in which a block ends goes on into the next one
until both walks are in the same state, from where they are one. So the parse is that of the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm import worker

UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample: rows a language, letters of a row, letters a language."""

    rows: int = 64
    row_chars: int = 8192
    chars: int = 24_000


def plain(text: str) -> str:
    """Lower-case letters with one space for each run of anything else."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def sample(labelled: DataFrame, fit: Fit = Fit()) -> dict[str, str]:
    """A bounded sample of ``labelled(doc_id, text, lang)``: language -> letters.

    Each language's rows fall into ``rows`` buckets by a hash of their id; the least hash of each bucket is
    taken, rows of 200 to ``row_chars`` code points before others. Rows without language or letters are left
    out. Neither a frequent language nor a repeated id makes the sample larger.
    """
    rows = labelled.select("lang", "text", F.xxhash64("doc_id").alias("h")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    far = F.when(F.length("text").between(200, fit.row_chars), 0).otherwise(1)
    rank = F.shiftrightunsigned("h", 2) + far * F.lit(1 << 61)
    rows = rows.select("lang", "text", F.pmod("h", F.lit(fit.rows)).alias("bucket"), rank.alias("rank"))
    least = rows.groupBy("lang", "bucket").agg(F.min("rank").alias("rank")).collect()
    if not least:
        return {}
    some = rows.where(F.col("rank").isin([r["rank"] for r in least])).groupBy("lang", "bucket", "rank")
    texts = some.agg(F.min(F.substring("text", 1, fit.row_chars)).alias("text")).collect()
    wanted = {(r["lang"], r["bucket"], r["rank"]) for r in least}
    parts: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["rank"])):
        if (r["lang"], r["bucket"], r["rank"]) in wanted:
            parts.setdefault(r["lang"], []).append(plain(r["text"]))
    return {k: "\n".join(x for x in v if x)[: fit.chars] for k, v in parts.items() if any(v)}


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root. Every path from it spells a substring."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Automaton:
    """A suffix automaton whose transitions are an open hash table; states and symbols are numbers, -1 is no state."""

    def __init__(self, symbols: list[int], width: int):
        nxt = suffix_automaton(symbols)
        self.width = width
        edges = [(k * width + c, q) for k, ways in enumerate(nxt) for c, q in ways.items() if c >= 0]
        self.kind = np.int32 if len(nxt) * width < 2**31 else np.int64
        keys = np.array([a for a, _ in edges], dtype=self.kind)
        self.mask = (1 << max(4, (3 * len(edges)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=self.kind)
        self.to = np.full(self.mask + 1, -1, dtype=np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        to = np.array([q for _, q in edges], dtype=np.int32)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]
            mine = self.keys[at] == keys[todo]
            self.to[at[mine]] = to[todo[mine]]
            todo, at = todo[~mine], at[~mine] + 1 & self.mask
        self.root = np.full(width, -1, dtype=np.int32)
        for c, q in nxt[0].items():
            if c >= 0:
                self.root[c] = q

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        if self.kind is np.int32:
            return ((keys.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.mask.bit_length())).astype(np.intp)
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.mask.bit_length())).astype(np.intp)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state of each walk after a symbol, or -1."""
        want = state.astype(self.kind) * self.kind(self.width) + symbol
        at = self._slot(want)
        have = self.keys.take(at)
        out = np.where(have == want, self.to.take(at), np.int32(-1))
        miss = np.flatnonzero((have != want) & (have >= 0))
        while len(miss):
            at[miss] = at[miss] + 1 & self.mask
            have = self.keys[at[miss]]
            hit = have == want[miss]
            out[miss[hit]] = self.to[at[miss[hit]]]
            miss = miss[~hit & (have >= 0)]
        return out

    def one(self) -> dict[int, int]:
        """All transitions as a dictionary, for a walk of one text."""
        some = np.flatnonzero(self.keys >= 0)
        return dict(zip(self.keys[some].tolist(), self.to[some].tolist(), strict=True))


class CrossParser:
    """The automata of all languages, and the parse of texts against them."""

    BLOCK = 512
    #: Rounds in which blocks go on from the ones before in lock step; what is not settled then is walked text by text.
    ROUNDS = 4
    SPACE, STRANGE = 0, 1

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for k in self.langs for c in samples[k] if c.isalpha()})
        self.width = width = len(letters) + 2
        code = {c: k + 2 for k, c in enumerate(letters)} | {" ": self.SPACE}
        # Of every code point: a letter of some sample, another letter, or anything else.
        self.symbol = np.array([self.STRANGE if chr(c).isalpha() else self.SPACE for c in range(0x110000)], dtype=np.int32)
        for c, k in code.items():
            self.symbol[ord(c)] = k
        self.automata = [Automaton([code.get(c, -1) for c in samples[lang]], width) for lang in self.langs]
        self.scale = [math.log2(max(2, len(samples[lang]))) for lang in self.langs]

    @classmethod
    def shared(cls, samples: dict[str, str]) -> CrossParser:
        made = worker.kept("langid", dict)
        if made.get("samples") != samples:
            made.update(samples=samples, parser=cls(samples))
        return made["parser"]

    def letters(self, text: str) -> np.ndarray:
        """Symbols of ``text``: runs of anything but letters as one space, none at the ends."""
        s = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")]
        space = s == self.SPACE
        keep = ~space
        keep[1:] |= ~space[:-1]
        s = s[keep]
        a, b = (1 if len(s) and s[0] == self.SPACE else 0), len(s) - (1 if len(s) and s[-1] == self.SPACE else 0)
        return s[a:b]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language, and the texts' lengths in letters."""
        seqs = [self.letters(x) for x in texts]
        size = np.array([len(s) for s in seqs], dtype=np.int64)
        blocks = (size + self.BLOCK - 1) // self.BLOCK
        first = np.cumsum(blocks) - blocks
        grid = np.zeros((int(blocks.sum()), self.BLOCK), dtype=np.int32)
        flat = grid.ravel()
        for s, at in zip(seqs, first.tolist(), strict=True):
            flat[at * self.BLOCK : at * self.BLOCK + len(s)] = s
        owner = np.repeat(np.arange(len(texts)), blocks)
        used = np.minimum(self.BLOCK, size[owner] - (np.arange(len(grid)) - first[owner]) * self.BLOCK)
        order = np.argsort(-used, kind="stable")  # short blocks drop out at the end
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        steps = np.ascontiguousarray(grid[order].T)
        grid = None
        out = np.zeros((len(texts), len(self.langs)))
        # The block that a block goes on into, by place in the order; -1 for a text's last.
        following = np.full(len(order), -1, dtype=np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        following[place[inner]] = place[inner + 1]
        used, owner = used[order], owner[order]
        for k, automaton in enumerate(self.automata):
            out[:, k] = np.bincount(owner, weights=self._parsed(automaton, steps, used, following), minlength=len(texts))
        return out, size

    def _parsed(self, automaton: Automaton, steps: np.ndarray, used: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block; blocks are columns of ``steps``, longer ones first."""
        n = len(used)
        states = np.full(steps.shape, -1, dtype=np.int32)
        begins = np.zeros(steps.shape, dtype=bool)
        state = np.full(n, -1, dtype=np.int32)
        for at in range(self.BLOCK):
            live = int(np.searchsorted(-used, -at, side="left"))  # blocks longer than ``at``
            if not live:
                break
            c = steps[at, :live]
            # A letter that is in no phrase is a phrase, and what comes after it begins another one.
            go = automaton.step(state[:live], c) if at else np.full(live, -1, dtype=np.int32)
            stop = np.flatnonzero(go < 0)
            go[stop] = automaton.root.take(c[stop])
            begins[at, stop] = True
            states[at, :live] = go
            state[:live] = go
        count = begins.sum(0, dtype=np.int64)
        final = state
        todo = following[(following >= 0)]
        before = np.full(n, -1, dtype=np.int64)
        before[following[following >= 0]] = np.flatnonzero(following >= 0)
        for _ in range(self.ROUNDS):
            if not len(todo):
                return count
            # Walks of several blocks of one text start from what is known of the block before at that time.
            todo = self._go_on(automaton, steps, used, states, begins, count, final, todo, before)
            todo = following[todo]
            todo = todo[todo >= 0]
        ways = automaton.one() if len(todo) else {}
        for block in todo.tolist():
            while block >= 0 and self._walk(ways, automaton, steps, used, states, begins, count, final, block, before):
                block = int(following[block])
        return count

    def _go_on(self, automaton, steps, used, states, begins, count, final, todo, before) -> np.ndarray:
        """Walk the blocks ``todo`` from the state in which those before end; the ones that end in another state than they did."""
        todo = np.sort(todo)
        state = final[before[todo]].copy()
        new = np.zeros(len(todo), dtype=np.int64)
        old = np.zeros(len(todo), dtype=np.int64)
        total = begins[:, todo].sum(0, dtype=np.int64)
        live = np.arange(len(todo))
        changed = []
        for at in range(self.BLOCK):
            over = used[todo[live]] <= at
            if over.any():
                ended = live[over]
                count[todo[ended]] = new[ended]
                differs = ended[final[todo[ended]] != state[ended]]
                final[todo[ended]] = state[ended]
                changed.append(differs)
                live = live[~over]
            if not len(live):
                break
            c = steps[at, todo[live]]
            go = automaton.step(state[live], c)
            go[state[live] < 0] = -1
            stop = np.flatnonzero(go < 0)
            go[stop] = automaton.root.take(c[stop])
            new[live[stop]] += 1
            state[live] = go
            own = todo[live]
            old[live] += begins[at, own]
            same = go == states[at, own]
            met = live[same]
            count[todo[met]] = new[met] + total[met] - old[met]
            # The end of a block that was walked before and now meets its own parse is that of its own parse.
            last = states[used[todo[met]] - 1, todo[met]]
            changed.append(met[final[todo[met]] != last])
            final[todo[met]] = last
            live = live[~same]
        if len(live):
            count[todo[live]] = new[live]
            changed.append(live[final[todo[live]] != state[live]])
            final[todo[live]] = state[live]
        return todo[np.concatenate(changed)] if changed else todo[:0]

    def _walk(self, ways, automaton, steps, used, states, begins, count, final, block, before) -> bool:
        """Walk one block from the state in which that before ends; whether it ends in another state than it did."""
        state, root, width = int(final[before[block]]), automaton.root, automaton.width
        column, own = steps[: used[block], block].tolist(), states[: used[block], block].tolist()
        new = 0
        was = int(final[block])
        for at, c in enumerate(column):
            go = ways.get(state * width + c, -1) if state >= 0 else -1
            if go < 0:
                new += 1
                go = int(root[c])
            state = go
            if go == own[at]:
                count[block] = new + int(begins[at + 1 :, block].sum())
                final[block] = own[-1]
                return own[-1] != was
        count[block], final[block] = new, state
        return state != was

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and a score: the runner-up's share of both estimates, 1 if there is none."""
        some = [k for k, x in enumerate(texts) if x]
        phrases, size = self.phrases([texts[k] for k in some])
        bits = phrases * np.array(self.scale)[None, :] / np.maximum(size, 1)[:, None]
        out = [(UNKNOWN, 0.0)] * len(texts)
        for k, row, n in zip(some, bits, size, strict=True):
            if n and self.langs:
                best, *rest = np.argsort(row, kind="stable")[:2]
                out[k] = (self.langs[best], float(row[rest[0]] / (row[best] + row[rest[0]])) if rest else 1.0)
        return out


def identify(text: Column, samples: dict[str, str]) -> Column:
    """``struct<lang string, score double>`` for each text.

    A null text, or one without a letter, gets ``und`` and 0; so does every text if there is no sample. Equal
    estimates go to the first language by name. Only the text is read. Repeated rows get equal results.
    """

    @F.arrow_udf("lang string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = CrossParser.shared(samples)
        for batch in batches:
            out: list[tuple[str, float]] = []
            at = 0
            while at < len(batch):
                end, size = at, 0
                while end < len(batch) and (end == at or size < 2_000_000):
                    size += len(batch[end].as_buffer()) if batch[end].is_valid else 0
                    end += 1
                out += parser.predict(batch.slice(at, end - at).to_pylist())
                at = end
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=["lang", "score"])

    # Not to be moved by the optimiser, which would parse once for a filter on the language and again for its column.
    return predicted.asNondeterministic()(text.cast("string"))
