"""Token ids of a byte-level BPE vocabulary, word by word with a bounded memory of words seen.

The vocabulary's split rule never joins across a space that a non-space character follows, so a text can be
cut there and each piece looked up. Texts where a space stands before white space, or that hold a special token, go to
the tokenizer whole, which makes the ids equal to tokenizers.Tokenizer.encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import base64
import functools

SPECIAL = "<|endoftext|>"


class _Whole(Exception):
    """This text has to be encoded in one piece."""


class _Words(dict):
    def __init__(self, encode, lead: str, most: int):
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, word: str) -> bytes:
        if self.lead and (not word or word[0].isspace()):
            raise _Whole
        if len(self) >= self.most:
            self.clear()
        ids = self.encode(self.lead + word)
        if len(word) < 64:
            self[word] = ids
        return ids


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None, most: int = 400_000):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        packed = lambda ids: np.asarray(ids, "<u4").tobytes()
        self.exact = lambda text: packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.plain = self.exact
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("same-vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
            self.plain = lambda text: packed(fast(text))
        self.first, self.rest = _Words(self.plain, "", 1000), _Words(self.plain, " ", most)

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.exact(text)
        head, *tail = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.rest.__getitem__, tail))
        except _Whole:
            return self.plain(text)


@functools.lru_cache(2)
def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(vocabulary, ranks, pattern)


def public_vocabulary() -> dict[str, str]:
    """Arguments of encoder() for the 50k byte-level vocabulary; the files stay where they are installed."""
    import public_tokenizers as p

    return {"vocabulary": p.path("byte_bpe_50k.json"), "ranks": p.path("byte_bpe_50k.tiktoken"), "pattern": p.PATTERN}
