"""Pre-tokens of byte-level BPE texts, and the library's ids for them.

A text is cut before each newline, and each space without a newline after it, that follows a non-space character.  No match of the byte-level pattern crosses
such a place and none looks behind it, so encoding the pieces one by one gives the ids of the whole text; '' joined, the
pieces are the text.  A piece is a run of white space and the characters up to the next one, so few distinct pieces make up
most of a corpus and can be looked up.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

_CUT = re.compile(r"(?<=\S)(?=\n| (?!\n))")
_RUN = re.compile(r"\s[ \n]")
#: Entries a worker keeps at most in a cache of pieces, and the longest piece that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48


def keys(text: str) -> list[str]:
    """The pieces of text by key: the first as it is, a later one without its leading space (a leading newline stays)."""
    if _RUN.search(text) is None:
        return text.replace("\n", " \n").split(" ") if text[:1] != "\n" else _general(text)
    return _general(text)


def _general(text: str) -> list[str]:
    first, *rest = _CUT.split(text)
    return [first, *(p[1:] if p[0] == " " else p for p in rest)]


def piece(key: str) -> str:
    """The piece of a later key.  Keys of later pieces start with a newline or lack the leading space, never both."""
    return key if key[:1] == "\n" else " " + key


def _alphabet() -> dict[str, int]:
    """The byte of each character of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Library:
    """The library's ids for pieces; one per worker and file.

    Where a byte-level file's merges are its ids in order (checked on loading), merging by rank gives the same ids; pieces
    without special strings then take that faster way.  Everything else is encoded by the tokenizers library itself.  With
    ``plain``, special strings inside texts are plain text; else they are matched as the library does by default.
    """

    _made: dict[tuple[str, bool], "Library"] = {}

    def __init__(self, name: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._by_rank(json.loads(self.tokenizer.to_str()), public_tokenizers.PATTERN)
        if self.ranked is not None:
            self.n_bytes = np.array([len(self.ranked.decode_single_token_bytes(i)) for i in range(self.ranked.n_vocab)])
        self.ids: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}

    @staticmethod
    def _by_rank(file: dict, pattern: str):
        import tiktoken

        model, before = file["model"], file.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
            return None
        vocabulary, byte = model["vocab"], _alphabet()
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))) or any(len(t) != 1 for t, i in vocabulary.items() if i < 256):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merged)}
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, name: str, plain: bool = False) -> "Library":
        if (name, plain) not in cls._made:
            cls._made[name, plain] = cls(name, plain)
        return cls._made[name, plain]

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers.

        Pieces that start with white space and don't end with it keep their ids when joined, and are encoded together.
        """
        out: list = [None] * len(pieces)
        if self.ranked is not None:
            joined = [i for i, p in enumerate(pieces) if p[:1] in (" ", "\n") and not p[-1:].isspace() and not any(t in p for t in self.added)]
            for at in range(0, len(joined), 20_000):
                part = joined[at : at + 20_000]
                ids = np.array(self.ranked.encode_ordinary("".join([pieces[i] for i in part])), "<u4")
                ends = np.cumsum([len(pieces[i].encode()) for i in part])
                stops = 4 * (np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1)
                data, start = ids.tobytes(), 0
                for i, stop in zip(part, stops.tolist()):
                    out[i] = data[start:stop]
                    start = stop
        alone = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(alone, self.tokenizer.encode_batch([pieces[i] for i in alone], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def lookup(batch: list[list[str]], cache: dict, make) -> list[list]:
    """For each document's later keys their cached values; make(pieces) gives the values of those that are not cached."""
    wanted = set(chain.from_iterable(batch))
    new = list(wanted.difference(cache))
    if len(cache) + len(new) > CACHE_ENTRIES:
        cache.clear()
        new = list(wanted)
    cache.update(zip(new, make([piece(k) for k in new])))
    found = [list(map(cache.__getitem__, ks)) for ks in batch]
    if len(cache) > CACHE_ENTRIES:  # a batch with more distinct pieces than a worker keeps
        cache.clear()
    for k in new:
        if len(k) > CACHE_CHARS:
            cache.pop(k, None)
    return found
