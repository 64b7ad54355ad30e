"""Token ids of whole texts by a public byte-level tokenizer."""

from __future__ import annotations

import base64
from array import array
from dataclasses import dataclass

import numpy as np

#: Words longer than this are encoded anew each time.
LONG = 64
#: Words kept, the earliest seen, which are the frequent ones; others are encoded each
#: time. It changes no id.
KEPT = 600_000


@dataclass(frozen=True)
class TokenizerFiles:
    """Files of one vocabulary, present on every executor; None: the public ones."""

    vocabulary: str | None = None
    ranks: str | None = None
    pattern: str | None = None


class _Words(dict):
    """Word -> number of its ids. A missing word is encoded and stored.

    Ids of a space and a word without white space at its ends don't depend on what
    stands around them; a word that is not so gets -1.
    """

    def __init__(self, owner: Encoder, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, word: str) -> int:
        inner = bool(self.lead)
        if word and word[-1].isspace() or inner and (not word or word[0].isspace()):
            return -1
        ids = self.owner.plain((self.lead + word) if word else "")
        if len(word) > LONG or len(self) >= KEPT:
            return self.owner.store(ids, keep=False)
        self[word] = number = self.owner.store(ids)
        return number


class Encoder:
    """Ids equal to the vocabulary file's, by way of a memory of words."""

    def __init__(self, files: TokenizerFiles):
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        ranks_path = files.ranks or public.path("byte_bpe_50k.tiktoken")
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = files.pattern or public.PATTERN
        self.bpe = tiktoken.Encoding(
            "words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.whole = Tokenizer.from_file(files.vocabulary or public.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.plain = self.bpe.encode_ordinary
        self.kept, self.passing = (array("q"), array("I")), (array("q"), array("I"))
        self.first, self.inner = _Words(self, ""), _Words(self, " ")

    def store(self, ids: list[int], keep: bool = True) -> int:
        """The number of an entry: kept ones count up from 0, passing ones down from -2."""
        box = self.kept if keep else self.passing
        box[0].append(len(ids))
        box[1].extend(ids)
        return len(box[0]) - 1 if keep else -len(box[0]) - 1

    def _whole(self, text: str) -> int:
        """A text with special tokens or runs of white space, encoded as a whole."""
        if any(s in text for s in self.special):
            return self.store(self.whole.encode(text, add_special_tokens=False).ids, keep=False)
        return self.store(self.plain(text), keep=False)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, number of ids of each text). Null: none."""
        self.passing = (array("q"), array("I"))
        words: list[str] = []
        lasts = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            words += (text or "").split(" ")
            lasts[k] = len(words)
        code = np.fromiter(map(self.inner.__getitem__, words), np.int64, len(words))
        firsts = lasts - np.diff(lasts, prepend=0)
        code[firsts] = [self.first[words[k]] for k in firsts]
        whole = {k for k, text in enumerate(texts) if text and any(s in text for s in self.special)}
        whole.update(np.searchsorted(lasts, np.flatnonzero(code == -1), "right").tolist())
        for k in whole:
            code[firsts[k] : lasts[k]] = self.store([], keep=False)
            code[firsts[k]] = self._whole(texts[k])
        count = np.concatenate([self.kept[0], self.passing[0]]).astype(np.int64)
        start = np.cumsum(count) - count
        code = np.where(code < 0, len(self.kept[0]) - code - 2, code)
        count, start = count[code], start[code]
        end = np.cumsum(count)
        spot = np.repeat(start - (end - count), count) + np.arange(count.sum())
        ids = np.concatenate([self.kept[1], self.passing[1]]).astype(np.uint32)[spot]
        totals = np.append(0, end)
        return ids, totals[lasts] - totals[firsts]


_encoders: dict[TokenizerFiles, Encoder] = {}


def encoder(files: TokenizerFiles) -> Encoder:
    """One per worker process, so its memory of words outlives a task."""
    if files not in _encoders:
        _encoders[files] = Encoder(files)
    return _encoders[files]
