"""Word-level cache around a vocabulary file whose pre-tokeniser never crosses white space."""

from __future__ import annotations

import unicodedata

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from simloom.llm import worker

#: Punctuation that is split from the end of an unknown word, so that more words are known.
TAIL = ".,;:!?%&*$#)\"'"
#: Joins unknown words for one call of the encoder; words that hold it are encoded alone.
MARK = "\x01"


class WordTokenizer:
    """Encodes texts by whole words, keeping the ids of recent words.

    Valid for vocabularies that lower-case, drop white space and split at it, so that a text's ids are those of
    its words in order. Two generations of at most ``keep`` words bound the memory.
    """

    def __init__(self, path: str, keep: int = 250_000):
        self.tok = Tokenizer.from_file(path)
        self.keep = keep
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        # Words of normalised lower-case letters need neither normalising nor splitting, which take half the time.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = self._ids([MARK])[0]
        assert len(self.mark) == 1

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One encoder a worker process and vocabulary."""
        made = worker.kept("wordtokens", dict)
        if path not in made:
            made[path] = cls(path)
        return made[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        ends: dict[str, tuple[str, str]] = {}
        plain: list[str] = []
        odd: list[str] = []
        for w in words:
            core = w.rstrip(TAIL)
            if core.isalpha() and core == core.lower() and unicodedata.is_normalized("NFC", core):
                if core != w:
                    ends[w] = (core, w[len(core) :])
                plain.append(core)
            else:
                odd.append(w)
        known = self.new
        plain = sorted({w for w in plain if w not in known})
        odd = sorted({x for x in odd + [tail for _, tail in ends.values()] if x not in known})
        self._split(self.letters, plain)
        self._split(self.tok, [w for w in odd if MARK not in w])
        for w in odd:
            if MARK in w:
                known[w] = np.array(self._ids([w])[0], dtype="<u4").tobytes()
        for w, (core, tail) in ends.items():
            known[w] = known[core] + known[tail]

    def _split(self, tok: Tokenizer, words: list[str]) -> None:
        """Encode many words by one call and cut the ids at the marks between them."""
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(tok.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark[0])
            assert len(cuts) == len(some) - 1
            raw, low = ids.tobytes(), 0
            for w, cut in zip(some, [*cuts.tolist(), len(ids)], strict=True):
                self.new[w] = raw[4 * low : 4 * cut]
                low = cut + 1

    def encode(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text, followed by ``end_id`` if given."""
        # Lower case first, so that more words are known, unless that could make a control string or a final sigma.
        split = [(x if "<|" in x or "Σ" in x else x.lower()).replace("\n", " ").split(" ") for x in texts]
        need: set[str] = set()
        for words in split:
            need.update(words)
        if len(self.new) > self.keep:
            self.old, self.new = self.new, {"": b""}
        need.difference_update(self.new)
        if self.old:
            old = self.old
            again = [w for w in need if w in old]
            for w in again:
                self.new[w] = old[w]
            need.difference_update(again)
        self._learn(list(need))
        get = self.new.__getitem__
        end = np.array([] if end_id is None else [end_id], dtype="<u4").tobytes()
        return [np.frombuffer(b"".join(map(get, words)) + end, dtype="<u4") for words in split]
