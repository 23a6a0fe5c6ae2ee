"""Exact token ids of whole texts under the public tokenizers, with a bounded word memory.

``word_bpe`` is the lower-casing BPE with word ends: its ids are those of ``tokenizers``' ``encode(text,
add_special_tokens=False)``. A text of plain Latin-1 characters is cut into words here, with the tokenizer's own rule,
and each new word goes through the library once; any other text, and any that holds a special token's string, goes
through the library whole. ``byte_bpe`` is byte-level BPE by ``tiktoken``. Null counts as the empty text.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Words (with their ids) that a worker remembers.
MEMORY = 500_000
#: Characters that lower-casing, NFC, the white-space rule and the letter classes treat as in the pattern below.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The tokenizer's own split, for plain text in lower case; fixed by its file.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def resolve(path: str) -> str:
    """A tokenizer file's place on this machine: a path, or the name of a public file."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


class WordBpe:
    def __init__(self, path: str = WORD_BPE) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(resolve(path))
        vocab = self.lib.get_vocab()
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memory: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new words: all go through the library as one text, cut again at the word ends."""
        if len(self.memory) + len(words) > MEMORY:
            self.memory.clear()
        one = np.array(self.lib.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[one]) + 1
        if len(cuts) == len(words) and (not len(one) or cuts[-1] == len(one)):
            raw, a = one.tobytes(), 0
            for w, b in zip(words, (cuts * 4).tolist(), strict=True):
                self.memory[w] = raw[a:b]
                a = b
        else:
            for w in words:
                self.memory[w] = np.array(self.lib.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [SPLIT.findall(t.lower()) if PLAIN.fullmatch(t) and not SPECIAL.search(t) else None for t in texts]
        out, a = [b""] * len(texts), 0
        while a < len(texts):  # at most MEMORY / 2 new words at once
            new: set[str] = set()
            b = a
            while b < len(texts) and (b == a or len(new) < MEMORY // 2):
                if cut[b]:
                    new.update(cut[b])
                b += 1
            if fresh := sorted(w for w in new if w not in self.memory):
                known = len(self.memory) + len(fresh) <= MEMORY
                self.learn(fresh if known else sorted(new))
            get = self.memory.__getitem__
            for i in range(a, b):
                out[i] = b"".join(map(get, cut[i])) if cut[i] is not None else np.array(self.lib.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
            a = b
        return out


class ByteBpe:
    def __init__(self, path: str = BYTE_BPE) -> None:
        import public_tokenizers
        import tiktoken

        with open(resolve(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.lib.encode_ordinary(t), "<u4").tobytes() for t in texts]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.lib.encode_ordinary(t)) for t in texts]


@lru_cache(4)
def tokenizer(path: str) -> WordBpe | ByteBpe:
    """One tokenizer for each file and worker process."""
    return ByteBpe(path) if path.endswith(".tiktoken") else WordBpe(path)
