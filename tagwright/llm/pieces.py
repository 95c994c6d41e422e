"""Exact token ids and counts from the public vocabularies, per worker process."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: white space other than space and line feed, in Unicode's or Python's sense,
#: and the format characters some regex engines count as white space
OTHER_SPACE = re.compile(
    "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]"
)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCounter:
    """Token counts by the ``tokenizers`` library with a bounded memory.

    The vocabulary's rules drop white space and never merge across it, so the
    count of a text is the sum over the pieces between spaces and line feeds.
    Counts of pieces are remembered in two generations: when the young one is
    full it becomes the old one, and what is still in use moves up again.
    A text with any other white space is encoded whole.
    """

    def __init__(self, path: str, generation: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.generation = generation
        self.young: dict[str, int] = {"": 0}
        self.old: dict[str, int] = {}

    def library(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if OTHER_SPACE.search(text):
            return self.library([text])[0]
        pieces = text.replace("\n", " ").split(" ")
        young = self.young
        try:
            return sum(map(young.__getitem__, pieces))
        except KeyError:
            pass
        if len(young) > self.generation:
            self.old, self.young = young, {"": 0}
            young = self.young
        missing = set()
        for p in set(pieces):
            if p not in young:
                n = self.old.get(p)
                if n is None:
                    missing.add(p)
                else:
                    young[p] = n
        new = list(missing)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            young.update(zip(part, self.library(part)))
        return sum(map(young.__getitem__, pieces))


_COUNTERS: dict[str, WordCounter] = {}


def word_counter(path: str) -> WordCounter:
    """One counter per worker process and vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounter(path)
    return _COUNTERS[path]


class ByteIds:
    """Ids of the byte-level vocabulary; its rank file gives the same ids as
    its ``tokenizers`` file at several times the speed.

    Long texts are encoded in segments that end where a visible character is
    followed by a space or line feed: no word of the vocabulary's pattern runs
    over such a place.
    """

    _CUT = re.compile(r"(?<=[^\W_])(?=[ \n])")

    def __init__(self, path: str, end_of_text: int = 50256, segment: int = 100_000):
        self.path = path
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={"<|endoftext|>": end_of_text},
        )
        self.segment = segment

    def segments(self, text: str):
        at = 0
        while len(text) - at > self.segment:
            cut = self._CUT.search(text, at + self.segment)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _segment_ids(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its regex engine gives up on white space of some 10^5 characters in a row
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(os.path.splitext(self.path)[0] + ".json")
            return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def ids(self, text: str) -> np.ndarray:
        parts = [self._segment_ids(s) for s in self.segments(text)]
        return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False)


_BYTE: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    if path not in _BYTE:
        _BYTE[path] = ByteIds(path)
    return _BYTE[path]
