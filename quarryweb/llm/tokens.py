"""Token ids of whole texts, as little-endian unsigned 32-bit binaries."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


#: Latin-1 letters, then ASCII signs other than the apostrophe: the vocabulary's splitter always parts these two.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
#: The normalizer and the splitter that make this so, as the library shows them.
_NORMALIZER = r'''Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])'''
_SPLITTER = r'''Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])'''


def _is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordEncoder:
    """Encodes a text word by word and keeps the ids of recent words.

    The vocabulary drops white space and never merges across it, so a text's
    ids are those of its parts between spaces and line feeds, joined. Each new
    part goes through the tokenizers library once. Parts of plain letters,
    perhaps with signs after them, are encoded many at a time without the
    normalizer, which only lower-cases them. About `kept` parts stay in
    memory: once half as many are new, those that were not used since go.
    """

    def __init__(self, path: str, kept: int = 900_000):
        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.plain = self.mark = None
        if (repr(self.tokenizer.normalizer), repr(self.tokenizer.pre_tokenizer)) == (_NORMALIZER, _SPLITTER):
            plain = Tokenizer(self.tokenizer.model)  # shares the vocabulary
            plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            if len(ends := self._ids(plain, "!")) == 1:
                self.plain, self.mark = plain, ends[0]

    @staticmethod
    def _ids(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _one(self, word: str) -> bytes:
        return np.array(self._ids(self.tokenizer, word), "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        known, old, parts = self.known, self.old, []
        for word in new:
            if self.plain and word.isascii() and word.isalpha():
                parts.append((word, word.lower(), ""))
            elif self.plain and (m := _PLAIN.fullmatch(word)):
                parts.append((word, m[1].lower(), m[2]))
            else:
                known[word] = self._one(word)
        cores = {core for _, core, _ in parts}.difference(known)
        unknown = cores.difference(old)
        for core in cores - unknown:
            known[core] = old[core]
        if unknown:
            ids = np.array(self._ids(self.plain, " ! ".join(unknown)), "<u4")
            ends = (np.append(np.flatnonzero(ids == self.mark), len(ids)) * 4).tolist()
            data, at = ids.tobytes(), 0
            if len(ends) != len(unknown):
                raise AssertionError("the sign between words is among their ids")
            for core, end in zip(unknown, ends, strict=True):
                known[core] = data[at:end]
                at = end + 4
        for word, core, tail in parts:
            if tail:
                if tail not in known:
                    known[tail] = self._one(tail)
                known[word] = known[core] + known[tail]
            else:
                known[word] = known[core]

    def encode(self, text: str) -> bytes:
        if len(self.known) > self.kept // 2:
            self.old, self.known = self.known, {"": b""}
        # The vocabulary lower-cases; for Latin-1 that is the same for a text as a whole. Its special tokens tell cases apart.
        if self.plain and "<|" not in text and _is_latin(text):
            text = text.lower()
        words, known, old = text.replace("\n", " ").split(" "), self.known, self.old
        parts = list(map(known.get, words))
        if None in parts:
            gaps = [i for i, ids in enumerate(parts) if ids is None]
            new = {words[i] for i in gaps}
            unknown = new.difference(old)
            for word in new - unknown:
                known[word] = old[word]
            if unknown:
                self._learn(unknown)
            for i in gaps:
                parts[i] = known[words[i]]
        return b"".join(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordEncoder(path)


def token_ids(text: Column, end_id: int, path: str = VOCABULARY) -> Column:
    """The ids of a text and end_id after them; null and empty texts have end_id only."""
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder(path).encode
        return pa.array((encode(x.as_py() or "") + end for x in texts), pa.binary())

    return ids(text)
