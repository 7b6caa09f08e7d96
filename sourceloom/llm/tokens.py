"""Token ids of whole texts, with bounded caches over white-space chunks and words.

The word-level tokenizer drops white space and never merges across the words
that its pre-tokenizer cuts, so the ids of a text are the ids of its chunks in
order, and the ids of a chunk those of its words. Both repeat a lot, and only
unseen words reach the BPE model. Chunks with characters outside COMMON, or
with a special token's string, go through the whole tokenizer; the ids are the
same either way.
"""

from __future__ import annotations

import re

import numpy as np

from .common import keeps

#: chunks and words kept by a worker process before a cache starts anew
CACHE_CHUNKS, CACHE_WORDS = 400_000, 300_000
#: longer ones are not kept, so the caches' bytes are bounded too
CACHE_BYTES = 48

#: characters whose lower case, class and composed form are the same for Python and the tokenizer
_LETTERS = "À-ÖØ-öø-įı-ž"
_SIGNS = "¡-©«-¬®-±´¶-¸»¿×÷–—‘-‟•…€"
COMMON = re.compile(f"[\t-\r -~{_LETTERS}{_SIGNS}]*")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^\\sa-z0-9{_LETTERS}]+")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: its own if printable, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in own else next(rest) for b in range(256)}


_BYTE_LETTERS = byte_letters()
_open: dict[tuple[str, bool], "WordTokenizer"] = {}
keeps("tokens", _open.clear)


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, for UTF-8 texts."""

    def __init__(self, path: str, plain_specials: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.model = self.tokenizer.model
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()

    def _chunk(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if "<|" in text or not COMMON.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for word in WORDS.findall(text.lower()):
            ids = self.words.get(word)
            if ids is None:
                ids = self._word(word)
                if len(word) <= CACHE_BYTES:
                    self.words[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks = {}
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        known = self.chunks
        out = []
        for text in texts:
            # only spaces and line feeds cut; other white space stays inside a chunk
            chunks = text.replace(b"\n", b" ").split(b" ")
            try:
                out.append(b"".join(map(known.__getitem__, chunks)))
                continue
            except KeyError:
                pass
            long = {}
            for c in set(chunks).difference(known):
                (known if len(c) <= CACHE_BYTES else long)[c] = self._chunk(c)
            out.append(b"".join([known[c] if c in known else long[c] for c in chunks] if long else map(known.__getitem__, chunks)))
        return out


def tokenizer(path: str, plain_specials: bool = False) -> WordTokenizer:
    """One tokenizer for each file and worker process."""
    key = (path, plain_specials)
    if key not in _open:
        _open[key] = WordTokenizer(path, plain_specials)
    return _open[key]


def vocabulary(name: str) -> str:
    """The place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_bpe() -> str:
    return vocabulary("word_bpe_49k.json")
