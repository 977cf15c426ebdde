"""Pre-tokens of the byte-level BPE file, and their ids through bounded worker caches.

The file splits a text by its pattern before any merge, so a text's ids are its pre-tokens' ids in a row.
Plain texts go through a faster merger built from the same file. Texts in which the library might split otherwise (characters outside the checked set, or a special
token's string) go to the library whole.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from pathlib import Path

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

FILE = "byte_bpe_50k.json"
CACHE_ENTRIES = 400_000
CACHE_CHARS = 128
PIECE = 1 << 19

#: Letters, digits and signs that every Unicode version since 6 classes alike; other texts take the library's own path.
_UNUSUAL = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-ſΑ-ΡΣ-ωА-я‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]")
_CUT = regex.compile(r"(?<=[^\s]) (?=[^\s])")


def tokenizer_path(name: str = FILE) -> str:
    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.cache
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


@functools.cache
def merger(path: str) -> tiktoken.Encoding | None:
    """A faster merger of the same file's vocabulary, if its merges are in the order of the ids they make; else None."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab["".join(m)] for m in merges]
    if made != sorted(made) or len(vocab) - len(merges) > 257:
        return None
    specials, signs = set(_specials(path)), _byte_signs()
    ranks = {bytes(signs[c] for c in token): n for token, n in vocab.items() if token not in specials}
    return tiktoken.Encoding(Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_signs() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


def plain_ids(text: str, path: str) -> list[int]:
    """Ids of a plain text, by the merger where there is one."""
    fast = merger(path)
    return fast.encode_ordinary(text) if fast else library_ids(text, path)


splitter = regex.compile(public_tokenizers.PATTERN).findall


def plain(text: str, path: str) -> bool:
    """Whether the text's pre-tokens can be encoded one by one."""
    return not _UNUSUAL.search(text) and not any(s in text for s in _specials(path))


def stretches(text: str) -> Iterator[str]:
    """The text in stretches of bounded length, cut only before a single space between two other characters, where a pre-token always begins."""
    at = 0
    while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def library_ids(text: str, path: str) -> list[int]:
    return tokenizer(path).encode(text, add_special_tokens=False).ids


class Cache(dict):
    """A dict that fills misses by encoding the pre-token, and starts anew beyond CACHE_ENTRIES so a worker's memory is bounded; pre-tokens over CACHE_CHARS aren't kept."""

    def __init__(self, of, first=()):
        super().__init__(first)
        self._of, self._first = of, dict(first)

    def __missing__(self, pretoken: str):
        if len(self) >= CACHE_ENTRIES + len(self._first):
            self.clear()
            self.update(self._first)
        value = self._of(pretoken)
        if len(pretoken) <= CACHE_CHARS:
            self[pretoken] = value
        return value
