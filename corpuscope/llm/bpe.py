"""Byte-level BPE of a tokenizer file, with a shortcut for whole tokens.

The merges of the file are run by a rank encoder over the file's own vocabulary. That gives
the library's ids if merges are listed in the order of the ids they make and if every
vocabulary string that is one pre-token is also reached by merging; both are proved when
the file is loaded, and ``tests/llm`` hold the ids against the library.

For counts, the pre-tokenizer's pattern never takes white space into a piece except as its
first character, so a text may be cut before every blank that is followed by other text, and
each stretch be counted alone. Natural text repeats its stretches, which makes most of the
work a dictionary look-up.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import regex

from .common import resident

#: White space as the pattern of the pre-tokenizer understands it.
BLANK = "\t-\r \x85\xa0  -     　"
STRETCH = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]")
#: Entries and length of an entry up to which stretches are remembered between batches.
MEMORY, LONGEST = 800_000, 48



class Bpe:
    """One tokenizer file, with the memories of a worker."""

    def __init__(self, content: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        spec = json.loads(content)
        steps = spec["pre_tokenizer"]
        added = spec["added_tokens"]
        plain = steps.get("type") == "ByteLevel" and steps.get("use_regex") and not steps.get("add_prefix_space")
        if not plain or spec["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("a byte-level tokenizer without normalizer and prefix blank is needed")
        self.special = {t["content"]: t["id"] for t in added}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.pieces = regex.compile(pattern)
        decoder = {c: b for b, c in byte_letters().items()}
        vocabulary = spec["model"]["vocab"]
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        ranks = {bytes(decoder[c] for c in entry): i for entry, i in vocabulary.items() if entry not in self.special}
        if any(a >= b for a, b in zip(made, made[1:])) or max((vocabulary[c] for c in decoder), default=0) >= made[0]:
            raise ValueError("merges are not listed in the order of the ids they make")
        self.rank = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = self._proved(ranks)
        self.counts: dict[str, int] = {}

    def _proved(self, ranks: dict[bytes, int]) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and that the library encodes alone as one token."""
        strings = []
        for entry in ranks:
            try:
                text = entry.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if self.pieces.findall(text) == [text]:
                strings.append(text)
        coded = self.library.encode_batch_fast(strings, add_special_tokens=False)
        whole = frozenset(s for s, e in zip(strings, coded) if len(e) == 1)
        if len(whole) < len(strings):
            raise ValueError("some vocabulary strings are not reached by merging")
        return whole

    def parts(self, text: str) -> list[str]:
        """The stretches of a text; strings of special tokens stand alone."""
        if not self.special or not self.at_special.search(text):
            return STRETCH.findall(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += STRETCH.findall(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + STRETCH.findall(text[at:])

    def encode(self, text: str) -> array:
        """The ids of a text as unsigned 32-bit numbers."""
        if not self.special or not self.at_special.search(text):
            return array("I", self.rank.encode_ordinary(text))
        out, at = array("I"), 0
        for m in self.at_special.finditer(text):
            out.extend(self.rank.encode_ordinary(text[at:m.start()]))
            out.append(self.special[m[0]])
            at = m.end()
        out.extend(self.rank.encode_ordinary(text[at:]))
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text: pre-tokens that are whole tokens count one, the rest is merged."""
        lists = [self.parts(t) for t in texts]
        if len(self.counts) > MEMORY:
            self.counts.clear()
        new = set().union(*lists).difference(self.counts)
        self.counts.update((s, self._count_new(s)) for s in new)
        at = self.counts.__getitem__
        out = [sum(map(at, x)) for x in lists]
        for s in new:
            if len(s) > LONGEST:
                del self.counts[s]
        return out

    def _count_new(self, stretch: str) -> int:
        if stretch in self.special:
            return 1
        whole, merge = self.whole, self.rank.encode_ordinary
        return sum(1 if p in whole else len(merge(p)) for p in self.pieces.findall(stretch))


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load(content: str, pattern: str) -> Bpe:
    """The tokenizer of a file's content, built once in each worker."""
    key = hashlib.sha1((content + pattern).encode()).hexdigest()
    return resident("bpe", "coder", key, lambda: Bpe(content, pattern))


def read(path: str) -> str:
    """A tokenizer file's content, read by the driver and sent along with the function that uses it."""
    with open(path, encoding="utf-8") as f:
        return f.read()
