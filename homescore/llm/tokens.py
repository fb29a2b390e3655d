"""Token ids of whole texts by a public tokenizer, with a cache of words.

A text is cut only where the tokenizer's own splitting pattern always cuts, so the ids of the pieces,
joined, are those of the text. Each distinct piece is encoded once per worker while the cache lasts.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import compress, count, repeat
from operator import is_

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_RUN_OF_SPACES = re.compile(r"\s\s")
#: Of a text without such runs: a line end, or a word with the space before it.
_SPACED_PIECE = re.compile(r"\n| ?[^ \n]+| ")
#: What makes words safe to be cut here: this normaliser and splitting pattern, and words of ASCII but "'" and Latin-1's
#: letters. Lower case is then all that the normaliser does, and the pattern cuts between letters, digits (each by itself) and others.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[ !-&(-~À-ÖØ-öø-ÿ]+")
_PART = re.compile("[a-zß-öø-ÿ]+|[0-9]| |[^ a-z0-9ß-öø-ÿ]+")
#: No id of a vocabulary that knows it; its bytes are found only where it was put, since no id has its higher byte.
_BETWEEN = b"\xff\xff"
#: Plain words cut at once; bytes of texts looked up at once.
_JOINED, _TOGETHER = 1000, 1 << 18
#: Pieces a worker remembers, some 200 bytes each; beyond that it starts anew.
CACHE_PIECES = 300_000


def _bytes_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)


class WordIds:
    """text -> ids as little-endian unsigned 16-bit integers in bytes.

    `spaced=False`: the vocabulary drops white space (word ends are part of its pieces).
    `spaced=True`: byte-level pieces that carry the space before a word.
    """

    def __init__(self, path: str, spaced: bool, most: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.cache = Tokenizer.from_file(path), spaced, {"": b""}
        self.most = most
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need 16 bits")
        self.plain = None if spaced else _plain_tokenizer(path)
        #: Of parts of plain words, their ids.
        self.parts = {" ": _BETWEEN}
        #: Ids that end a part.
        self.ends = np.zeros(1 << 16, bool)
        if self.plain:
            suffix = self.plain.model.end_of_word_suffix
            self.ends[[i for token, i in self.plain.get_vocab(False).items() if token.endswith(suffix)]] = True

    def _encode(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [_bytes_of(x.ids) for x in found]

    def _learn(self, words: list[bytes]) -> None:
        """Put words and their ids into the cache; those of plain words come from their parts, of which new ones are encoded as one text."""
        other = [] if self.plain else words
        for k in range(0, len(words) if self.plain else 0, _JOINED):
            some = words[k : k + _JOINED]
            joined = str(b" ".join(some), "utf-8")
            if not _PLAIN.fullmatch(joined):
                fits = list(map(_PLAIN.fullmatch, joined.split(" ")))
                other += [word for word, fit in zip(some, fits) if not fit]
                some = list(compress(some, fits))
                joined = str(b" ".join(some), "utf-8")
            if some:
                parts = _PART.findall(joined.lower())
                new = list(set(parts).difference(self.parts))
                if new:
                    ids = np.array(self.plain.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u2")
                    stops = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist()
                    apart = map(ids.tobytes().__getitem__, map(slice, [0, *stops[:-1]], stops))
                    self.parts.update(zip(new, apart if len(stops) == len(new) else self._encode(new)))
                self.cache.update(zip(some, b"".join(map(self.parts.__getitem__, parts)).split(_BETWEEN)))
        self.cache.update(zip(other, self._encode([str(word, "utf-8") for word in other])))

    def all_ids(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """The ids of UTF-8 texts of an unspaced vocabulary, in order; new words of some texts are encoded together."""
        some, size = [], 0
        for text in texts:
            some.append(text or b"")
            size += len(some[-1])
            if size >= _TOGETHER:
                yield from self._together(some)
                some, size = [], 0
        yield from self._together(some)

    def _together(self, texts: list[bytes]) -> list[bytes]:
        cache = self.cache
        if len(cache) > self.most:
            cache.clear()
            self.parts = {" ": _BETWEEN}
        found, partly = [], []
        for text in texts:
            if b"<|" in text:
                found.append(self.ids(str(text, "utf-8")))
                continue
            words = text.split()
            ids = list(map(cache.get, words))
            unknown = [(k, words[k]) for k in compress(count(), map(is_, ids, repeat(None)))]
            if unknown:
                partly.append((len(found), unknown))
            found.append(ids if unknown else b"".join(ids))
        self._learn(list({word for _, unknown in partly for _, word in unknown}))
        for at, unknown in partly:
            ids = found[at]
            for k, word in unknown:
                ids[k] = cache[word]
            found[at] = b"".join(ids)
        return found

    def _pieces(self, text: str) -> list[bytes] | list[str] | None:
        """None where the text must be encoded as one."""
        if "<|" in text:  # special tokens, which may take white space with them
            return None
        if not self.spaced:
            return text.encode().split()
        if _RUN_OF_SPACES.search(text):
            return None
        if "\0" in text:
            return _SPACED_PIECE.findall(text)
        # the same pieces, and empty ones beside line ends
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = self._pieces(text)
        if pieces is None:
            return self._encode([text])[0]
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            pass
        if len(cache) > self.most:
            cache.clear()
            cache[""] = b""
        new = list(set(pieces).difference(cache))
        cache.update(zip(new, self._encode(new if self.spaced else [str(p, "utf-8") for p in new])))
        return b"".join(map(cache.__getitem__, pieces))


def _plain_tokenizer(path: str):
    """The tokenizer without what leaves lower-case plain words as they are; None if it does more than is known here."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    parts = [json.loads(x.__getstate__()) if x else {} for x in (found.normalizer, found.pre_tokenizer)]
    split = (parts[1].get("pretokenizers") or [{}])[0]
    known = parts[0].get("normalizers") == _NORMALIZERS and split.get("pattern") == {"Regex": _PATTERN} and split.get("invert")
    if not known or not getattr(found.model, "end_of_word_suffix", None) or found.get_vocab_size() > 0xFF00:
        return None
    found.normalizer = None
    found.model._resize_cache(0)  # each word comes once
    return found


_KNOWN: dict[tuple[str, bool, int], WordIds] = {}


def word_ids(path: str, spaced: bool, most: int = CACHE_PIECES) -> WordIds:
    """One per worker process, so that its cache serves all tasks of the process."""
    if (path, spaced, most) not in _KNOWN:
        _KNOWN[path, spaced, most] = WordIds(path, spaced, most)
    return _KNOWN[path, spaced, most]
