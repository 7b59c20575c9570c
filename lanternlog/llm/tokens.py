"""Ids of whole texts by a public word-level BPE vocabulary, each distinct piece of text encoded once per worker."""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count, islice

import numpy as np

#: ASCII marks that are cut off a word's end when an ASCII letter stands before them: the vocabulary always cuts there.
MARKS = ".,!#$%&*|<>?;:"
#: How the vocabulary's whole-token literals begin; a word that has this is given to the tokenizer as it stands.
LITERAL = b"<|"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """White space ends every token of the vocabulary and is dropped, so a text's ids are its words' ids joined.

    A word is looked up by number; its ids are those of two pieces, the word without its closing marks and the marks.
    A word is only cut where an ASCII letter stands before the marks: other letters may become a letter and a mark when
    the tokenizer lower-cases or composes them, which the vocabulary joins with the marks. New pieces of letters only are
    encoded many to a call, as each ends with an end-of-word token; other pieces are encoded one by one. Both tables are
    emptied when they pass their limits, so memory is bounded.
    """

    def __init__(self, path: str, most_words: int = 250_000, most_pieces: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.most_words, self.most_pieces = most_words, most_pieces
        self._forget(True)

    def _forget(self, pieces: bool) -> None:
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.parts = np.zeros((0, 2), np.int32)
        if pieces:
            self.pieces = {"": 0}
            self.flat = np.zeros(0, np.uint32)
            self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, texts: list[str]) -> None:
        new = [t for t in dict.fromkeys(texts) if t not in self.pieces]
        letters, others = [t for t in new if t.isalpha()], [t for t in new if not t.isalpha()]
        flat, sizes = [], []
        for at in range(0, len(letters), 500):
            group = letters[at : at + 500]
            ids = self._encode([" ".join(group)])[0]
            ends = np.flatnonzero(self.is_end[ids])
            if len(ends) == len(group):
                flat.append(ids)
                sizes += np.diff(ends, prepend=-1).tolist()
            else:  # a letter became something else on its way
                found = self._encode(group)
                flat += found
                sizes += map(len, found)
        for at in range(0, len(others), 2_000):
            found = self._encode(others[at : at + 2_000])
            flat += found
            sizes += map(len, found)
        if new:
            self.pieces.update(zip(letters + others, count(len(self.pieces)), strict=False))
            ends = len(self.flat) + np.cumsum(sizes)
            self.starts = np.concatenate([self.starts, ends - sizes])
            self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])
            self.flat = np.concatenate([self.flat, *flat])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids joined, and where each text ends."""
        if len(self.pieces) > self.most_pieces:
            self._forget(True)
        elif len(self.words) > self.most_words:
            self._forget(False)
        split = [t.encode().split() for t in texts]
        known = len(self.words)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if len(self.words) > known:
            cores, marks = [], []
            for w in islice(self.words, known, None):
                if LITERAL in w:
                    cores.append(w.decode())
                    marks.append("")
                    continue
                whole = w.lower().decode()  # of bytes: ASCII letters only
                core = whole.rstrip(MARKS)
                if core and not (core[-1].isascii() and core[-1].isalpha()):
                    core = whole
                cores.append(core)
                marks.append(whole[len(core) :])
            self._learn(cores + marks)
            at = self.pieces.__getitem__
            new = np.stack([np.fromiter(map(at, x), np.int32, len(x)) for x in (cores, marks)], axis=1)
            self.parts = np.concatenate([self.parts, new])
        pieces = self.parts[numbers].ravel()
        sizes = self.sizes[pieces]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[pieces] - ends + sizes, sizes) + np.arange(total)]
        word_ends = np.concatenate([[0], ends])[2 * np.cumsum(counts)]
        return ids, word_ends


_of_this_worker: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker process's encoder: its tables serve all tasks that Spark gives the worker."""
    if path not in _of_this_worker:
        _of_this_worker[path] = WordEncoder(path)
    return _of_this_worker[path]
