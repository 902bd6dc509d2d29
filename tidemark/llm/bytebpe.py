"""Byte-level BPE through the tokenizers library, with the ids of repeated words kept per worker.

The encoding of a text is the concatenation of the encodings of its pre-tokens, which repeat. Each
worker sends a pre-token to the library once, many of them as one text with a mark before each, and joins
the ids afterwards. Texts with a character beyond Latin-1 go to the library whole, so that its own Unicode
tables decide.

With ``added`` the ids are the library's at its defaults: an added token such as ``<|endoftext|>`` in a text is
one id, and texts that hold one go to the library whole. Without it such a token is encoded like other text.
"""

from __future__ import annotations

import codecs
import os
import re
from itertools import chain

import numpy as np

END_ID = 2
KEPT_WORDS = 400_000

# The letters, numbers and spaces of Latin-1, for the pre-token pattern of this vocabulary.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = " \t\n\x0b\x0c\r\x85\xa0"
_PRE_TOKEN = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)

# The letters that byte-level vocabularies write for the 256 bytes: printable ones stand for themselves.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [x for x in range(256) if x not in _PRINTED]
LETTERS = "".join(chr(x if x in _PRINTED else 256 + _OTHERS.index(x)) for x in range(256))
MARK = LETTERS[0xFF]  # before every word that is learned; the byte occurs in no text
_GAP = "\ue000"  # the mark's place in text; no word has it, being Latin-1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Encodes batches of texts to the bytes of their ids, little-endian unsigned 32-bit."""

    def __init__(self, vocabulary: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = not added
        tokens = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.added = re.compile("|".join(map(re.escape, tokens))) if tokens else None
        self.inner = Tokenizer.from_file(vocabulary)  # for pre-tokens, in the letters of their bytes, a mark before each: no merge crosses a mark
        self.inner.encode_special_tokens = True
        self.inner.pre_tokenizer = None
        self.mark = self.inner.token_to_id(MARK)
        self.words: dict[str, bytes] = {}
        self.over = 0

    def _learn(self, words: list[str]) -> None:
        for a in range(0, len(words), 500):
            part = words[a : a + 500]
            body = (_GAP + _GAP.join(part)).encode().replace(_GAP.encode(), b"\xff")
            got = self.inner.encode_batch_fast([codecs.charmap_decode(body, "strict", LETTERS)[0]], add_special_tokens=False)[0]
            ids = np.array(got.ids, dtype="<u4")
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(part):
                raise ValueError(f"{len(part)} words came back as {len(marks)}: the vocabulary joins the byte 0xff to others")
            spans = map(slice, (4 * marks + 4).tolist(), (4 * np.append(marks[1:], len(ids))).tolist())
            self.words.update(zip(part, map(ids.tobytes().__getitem__, spans)))

    def _forget(self, new: list[str]) -> None:
        """Beyond the bound what a batch has brought goes again, as the frequent words came first; now and then all start anew."""
        if len(self.words) > KEPT_WORDS:
            self.over += 1
            if self.over % 4096:
                for w in new:
                    del self.words[w]
            else:
                self.words.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a in range(0, len(texts), 256):
            part = texts[a : a + 256]
            simple = [t.isascii() or _is_latin1(t) for t in part]
            if self.added:
                simple = [s and not self.added.search(t) for s, t in zip(simple, part)]
            pieces = [_PRE_TOKEN.findall(t) if s else None for t, s in zip(part, simple)]
            flat = list(chain.from_iterable(p for p in pieces if p is not None))
            found = list(map(self.words.get, flat))
            missing = [i for i, ids in enumerate(found) if ids is None]
            new = list(set(map(flat.__getitem__, missing)))
            self._learn(new)
            for i in missing:
                found[i] = self.words[flat[i]]
            end = 0
            for t, p in zip(part, pieces):
                if p is None:
                    ids = self.tokenizer.encode(t, add_special_tokens=False).ids
                    out.append(np.array(ids, dtype="<u4").tobytes())
                else:
                    start, end = end, end + len(p)
                    out.append(b"".join(found[start:end]))
            self._forget(new)
        return out


def _is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ENCODERS: dict[tuple[str, bool], ByteBpe] = {}


def encoder(vocabulary: str, added: bool = False) -> ByteBpe:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if (vocabulary, added) not in _ENCODERS:
        _ENCODERS[vocabulary, added] = ByteBpe(vocabulary, added)
    return _ENCODERS[vocabulary, added]
