"""Whole-text encoding by white-space chunks, shared by the two tokenizer operators.

The tokenizer of ``word_bpe_49k.json`` lower-cases, folds white space and never forms a token across white
space, so a text's ids are the concatenation of its chunks' ids and a memo of chunks does most of the work.
"""

from __future__ import annotations

import unicodedata

import regex

#: White space as the tokenizer's normaliser sees it; ``str.split`` would also cut at the four ASCII separators.
SPLIT = regex.compile(r"[\t-\r\x20\x85\xa0  -     　]+")
#: Entries of a memo's younger half; bounds a worker's memory, results don't depend on it.
MEMO_ENTRIES = 500_000
MARKS = ".,;:!?|"


def split(text: str | None) -> list[str]:
    if not text:
        return []
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [x for x in SPLIT.split(text) if x]
    return text.split()


def plain_word(s: str) -> bool:
    """Whether ``s`` is one run of letters that normalising leaves alone but for lower-casing each letter."""
    return s.isalpha() and (s.isascii() or (unicodedata.is_normalized("NFC", s) and "Σ" not in s and "İ" not in s))


class ChunkMemo(dict):
    """chunk -> value. ``words(list)`` values lower-case plain words, ``others(list)`` any chunks; ``join`` joins two values.

    Two generations: when the younger is full it becomes the older, so frequent chunks stay.
    """

    def __init__(self, words, others, join, most: int = MEMO_ENTRIES):
        super().__init__()
        self.words, self.others, self.join, self.most = words, others, join, most
        self.old: dict = {}
        self.parts: dict = {}
        self.old_parts: dict = {}

    def __missing__(self, chunk: str):
        value = self.old.get(chunk)
        if value is None:
            value = self.fill([chunk])[chunk]
        self[chunk] = value
        return value

    def fill(self, chunks) -> dict:
        """Values of chunks, words of one call valued together."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        if len(self.parts) > self.most:
            self.old_parts, self.parts = self.parts, {}
        parts, old, split_up, need, rest = self.parts, self.old_parts, [], {}, []
        for chunk in chunks:
            core = chunk.rstrip(MARKS)
            if core and plain_word(core):
                low, tail = core.lower(), chunk[len(core) :]
                if low not in parts:
                    v = old.get(low)
                    if v is None:
                        need[low] = 1
                    else:
                        parts[low] = v
                if tail and tail not in parts:
                    parts[tail] = self.others([tail])[0]
                split_up.append((chunk, low, tail))
            else:
                rest.append(chunk)
        out = dict(zip(rest, self.others(rest), strict=True)) if rest else {}
        if need:
            need = list(need)
            parts.update(zip(need, self.words(need), strict=True))
        join = self.join
        for chunk, low, tail in split_up:
            out[chunk] = join(parts[low], parts[tail]) if tail else parts[low]
        return out

    def values_of(self, texts) -> list[list]:
        """Per text the values of its chunks."""
        cut = [split(t) for t in texts]
        self.learn(set().union(*cut).difference(self))
        get = self.__getitem__
        return [list(map(get, c)) for c in cut]

    def learn(self, fresh) -> None:
        """Take in distinct chunks that the younger half lacks."""
        if fresh:
            old = self.old
            known = {c: old[c] for c in fresh if c in old}
            values = self.fill([c for c in fresh if c not in known])
            self.update(known)
            self.update(values)
