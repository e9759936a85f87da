"""Encoding whole texts with a tokenizer file, each distinct chunk of them once.

A byte-pair encoder works on pre-tokens independently. For the two pre-tokenizer settings that are recognised here, a
space or a line break between other characters always ends a pre-token, so a text's ids are the ids of its chunks, cut
before each of them, in a row. Arrow cuts a batch of texts and numbers its distinct chunks; the tokenizers library
gives the ids of each chunk once, a table keeps them, and a text's ids are gathered from it. A chunk of letters and a
closing comma or full stop is two pre-tokens for certain and shares the ids of its letters.

Where white space meets white space in a way that the first setting treats as one run, the text goes through the library
whole, as all texts do with other settings. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Opens a text's first chunk where a space before a chunk matters.
_FIRST = "\x02"
#: A text of more bytes goes through the library whole: Arrow's offsets in a batch are 32 bits wide.
_LONGEST = 1 << 29


class Encoder:
    """encode() gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        #: "spaced": a chunk's leading space is part of it; "bare": white space is dropped and case folded; or None.
        self.setting = self._known(config)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.odd = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, bool)

    @staticmethod
    def _known(config: dict) -> str | None:
        before, normal, model = config.get("pre_tokenizer") or {}, config.get("normalizer") or {}, config["model"]
        if model.get("type") != "BPE" or model.get("dropout") or any(not t.get("special") for t in config.get("added_tokens", [])):
            return None
        if not normal and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True):
            return "spaced"
        steps, cuts = normal.get("normalizers", []), before.get("pretokenizers", [])
        if [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"]:
            if steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " " and cuts[0]["pattern"] == {"Regex": _WORD_END_PATTERN} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]:
                return "bare"
        return None

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelled(self, chunk: str) -> str:
        """What the library sees of a chunk."""
        if self.setting == "bare" or chunk[:1] == "\n":
            return chunk
        return chunk[1:] if chunk[:1] == _FIRST else " " + chunk

    def _is_odd(self, chunk: str) -> bool:
        """Whether white space at the chunk's edges may belong to a longer run."""
        inner = chunk[1:] if chunk[:1] in ("\n", _FIRST) else chunk
        if chunk in ("\n", _FIRST):
            return False
        return not inner or unicodedata.category(inner[0])[0] in "ZC" or unicodedata.category(inner[-1])[0] in "ZC"

    def _add(self, chunks: list[str], many: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.number)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(chunks) > len(self.start):
            self.start, self.length, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.odd))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(chunks)] = self.used + np.cumsum(many) - many
        self.length[n : n + len(chunks)] = many
        if self.setting == "spaced":
            self.odd[n : n + len(chunks)] = [not c.isalpha() and self._is_odd(c) for c in chunks]
        self.number.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.used += len(ids)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids the chunks have, and all their ids in a row."""
        many = self.length[numbers]
        ends = np.cumsum(many)
        at = np.repeat(self.start[numbers] - (ends - many), many)
        at += np.arange(len(at))
        return many, self.ids[at]

    def _learn(self, chunks: list[str]) -> None:
        """Gives new chunks their ids and numbers."""
        whole, closed, known = {}, [], self.number
        for c in chunks:
            if c[-1:] in (",", ".") and (c[1:-1] if c[0] in ("\n", _FIRST) else c[:-1]).isalpha():
                closed.append(c)
                if c[:-1] not in known:
                    whole[c[:-1]] = None
            else:
                whole[c] = None
        whole = list(whole)
        if whole:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([self._spelled(c) for c in whole] if self.setting == "spaced" else whole, add_special_tokens=False)]
            many = np.fromiter(map(len, found), np.int64, len(found))
            self._add(whole, many, np.fromiter(chain.from_iterable(found), np.uint32, int(many.sum())))
        for mark in (",", "."):
            some = [c for c in closed if c[-1] == mark]
            if some:
                many, ids = self._gather(np.fromiter((known[c[:-1]] for c in some), np.int64, len(some)))
                last = np.frombuffer(self._library([mark])[0], np.uint32)
                self._add(some, many + len(last), np.insert(ids, np.repeat(np.cumsum(many), len(last)), np.tile(last, len(some))))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if self.setting is None or texts.nbytes > _LONGEST:
            return self._library(texts.to_pylist())
        if len(texts) == 0:
            return []
        if len(self.number) > self.most:
            self._forget()
        if self.setting == "spaced":
            run = lambda x: pc.match_substring(texts, x)
            odd = pc.or_(pc.or_(run("\n\n\n"), run("\n\n ")), pc.or_(pc.ends_with(texts, "\n\n"), run(_FIRST))).to_numpy(zero_copy_only=False)
            marked = pc.binary_join_element_wise(pa.scalar(_FIRST), pc.replace_substring(texts, "\n", " \n"), "")
        else:
            odd, marked = np.zeros(len(texts), bool), pc.replace_substring(texts, "\n", " ")
        cut = pc.split_pattern(marked, " ")
        edges = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        known = coded.dictionary
        chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known), " ")[0].as_py().split(" ")
        if self.setting == "bare":
            chunks = [c.lower() if c.isascii() else c for c in chunks]
        new = [c for c in dict.fromkeys(chunks) if c not in self.number]
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))[coded.indices.to_numpy()]
        many, flat = self._gather(numbers)
        ends = np.concatenate([[0], np.cumsum(many)])
        at = ends[edges]
        odd |= np.logical_or.reduceat(self.odd[numbers], edges[:-1])  # every text has a chunk
        out = [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        rest = np.flatnonzero(odd).tolist()
        for k, ids in zip(rest, self._library([texts[k].as_py() for k in rest]), strict=True):
            out[k] = ids
        return out


#: One encoder a process and file: Spark reuses its Python workers, and with them the cache. Tasks of other operators
#: drop it, so that it takes no memory from them.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, most: int = 1_000_000) -> Encoder:
    """most: distinct chunks to remember; a million take some 250 MB."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, most)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
