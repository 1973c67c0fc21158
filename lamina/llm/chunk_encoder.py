"""Batch encoding by the tokenizers library with a bounded memo of text chunks.

A text is cut before every blank that follows a character which is not white space. Neither tokenizer here lets
a token cross such a place: their patterns match white space only at the start of a match, never after other
characters, and their look-aheads see no further than white space. So the ids of a text are the ids of its
chunks, one after the other, and the library has to encode each distinct chunk once. A new chunk of Latin
letters and signs is split and mapped to byte characters here, so that only the library's merge model runs; any
other goes through the whole library. The tests hold all of this against the library's encoding of whole texts,
for every code point.
"""

from __future__ import annotations

import gc
import json
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that one worker remembers; beyond it those seen in one text only are forgotten.
MEMO_CHUNKS = 1_000_000
#: Chunks that are split here; the rest is left to the library, whose Unicode tables may be newer than ours.
_PLAIN = re.compile("[\x00-\u024f]*")
#: Between parts that are mapped together; no plain chunk has it.
_BETWEEN = "\uffff"
_TWO_BLANKS = re.compile(r"\s ")
#: The same for Arrow, whose \s is ASCII alone: all characters that Python's \s has.
_TWO_BLANKS_RE2 = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_CUT = re.compile(r"(?<=\S) ")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: bytes that print as Latin-1
    characters stand for themselves, the others follow from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _steps(config: dict) -> tuple[str, bool]:
    """The splitting pattern of a tokenizer file, and whether it lowers case."""
    stage = config["pre_tokenizer"]
    stages = stage["pretokenizers"] if stage["type"] == "Sequence" else [stage]
    split = next((x["pattern"]["Regex"] for x in stages if x["type"] == "Split"), None)
    if split is None:
        import public_tokenizers

        split = public_tokenizers.PATTERN
    normalizer = config.get("normalizer") or {"normalizers": []}
    return split, any(x["type"] == "Lowercase" for x in normalizer.get("normalizers", [normalizer]))


class ChunkEncoder:
    """Encodes texts to arrays of ids. Not thread-safe; one for each worker, see `encoder`."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            pattern, self.lower = _steps(json.load(file))
        self.pattern = regex.compile(pattern)
        self.table = dict(enumerate(byte_characters()))
        self.between = _BETWEEN.encode().decode("latin-1").translate(self.table)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merge = self.tokenizer.model.tokenize
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.memo_chunks = memo_chunks
        self._reset()

    def _reset(self) -> None:
        self._at: dict[str, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._end = np.zeros(1 << 14, np.int64)  # chunk i has ids [end[i - 1], end[i])
        self._texts = np.zeros(1 << 14, np.int32)  # texts, or pieces of texts, that had chunk i
        self._used = 0

    def _forget(self) -> None:
        """Keeps the chunks seen in two texts or more, unless they are too many themselves."""
        keys, seen = list(self._at), self._texts[: len(self._at)] > 1
        if seen.sum() > self.memo_chunks // 2:
            return self._reset()
        kept = np.flatnonzero(seen)
        start = np.where(kept > 0, self._end[kept - 1], 0)
        ids, counts = self._gather(start, self._end[kept] - start), self._end[kept] - start
        self._reset()
        self._append([keys[i] for i in kept], ids, counts)

    def _append(self, chunks: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self._at), len(ids)
        while n + len(chunks) > len(self._end):
            self._end = np.concatenate([self._end, np.zeros_like(self._end)])
            self._texts = np.concatenate([self._texts, np.zeros_like(self._texts)])
        while self._used + m > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + m] = ids
        self._end[n : n + len(chunks)] = self._used + np.cumsum(counts)
        self._used += m
        self._at.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def _learn(self, chunks: list[str]) -> None:
        whole = " " + " ".join(chunks)
        if not _PLAIN.fullmatch(whole):
            lists = [self._fresh(" " + c) for c in chunks]
            self._append(chunks, np.array(list(chain.from_iterable(lists)), np.uint32), np.array([len(x) for x in lists], np.int64))
            return
        split, merge = self.pattern.findall, self.merge
        parts = [split(" " + c.lower()) for c in chunks] if self.lower else [split(" " + c) for c in chunks]
        flat = list(chain.from_iterable(parts))
        # Many chunks share a part, as their last sign: each distinct one is merged once.
        distinct = list(dict.fromkeys(flat))
        mapped = _BETWEEN.join(distinct).encode().decode("latin-1").translate(self.table).split(self.between) if distinct else []
        lists = [[t.id for t in merge(p)] for p in mapped]
        ids, sizes = np.array(list(chain.from_iterable(lists)), np.uint32), np.array([len(x) for x in lists], np.int64)
        place = dict(zip(distinct, range(len(distinct)), strict=True))
        part = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        n = sizes[part]
        before = np.cumsum(n) - n
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[part] - before, n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([len(p) for p in parts])]
        self._append(chunks, ids, np.diff(ends, prepend=0))

    def _fresh(self, chunk: str) -> list[int]:
        if not _PLAIN.fullmatch(chunk):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        parts, merge, table = self.pattern.findall(chunk.lower() if self.lower else chunk), self.merge, self.table
        return [t.id for p in parts for t in merge(p.encode().decode("latin-1").translate(table))]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of the whole text, without special tokens."""
        if not text:
            return np.zeros(0, np.uint32)
        parts = _CUT.split(text) if _TWO_BLANKS.search(text) else text.split(" ")
        # The first chunk has no blank before it, so it is not in the memo (a text that starts with a blank and
        # has no second one before its first word gives an empty first part).
        first = np.array(self._fresh(parts[0]), np.uint32)
        if len(parts) == 1:
            return first
        return np.concatenate([first, self._expand(parts, 1)])

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a batch. Arrow splits the texts and numbers their distinct chunks, so that the
        memo is asked once a chunk and batch. Many small lists come and go and no cycles, and looking for cycles would take a
        tenth of the time, so the collector rests meanwhile."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode_many(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.string())
        plain = np.flatnonzero(~pc.fill_null(pc.match_substring_regex(texts, _TWO_BLANKS_RE2), True).to_numpy(zero_copy_only=False)).tolist()
        out = [np.zeros(0, np.uint32)] * len(texts)
        for k in set(range(len(texts))).difference(plain):
            out[k] = self.encode(texts[k].as_py())
        if not plain:
            return out
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        codes = coded.indices.to_numpy()
        index = self._numbers(coded.dictionary.to_pylist())[codes]
        start = np.where(index > 0, self._end[index - 1], 0)
        n = self._end[index] - start
        n[offsets[:-1]] = 0  # first chunks have no blank before them, so they are not those of the memo
        ids = self._gather(start, n)
        place = np.concatenate([[0], np.cumsum(n)])
        for k, a, b, first in zip(plain, place[offsets[:-1]].tolist(), place[offsets[1:]].tolist(), lists.values.take(pa.array(offsets[:-1])).to_pylist(), strict=True):
            out[k] = np.concatenate([np.array(self._fresh(first), np.uint32), ids[a:b]])
        return out

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """Places of distinct chunks in the memo, learned where needed."""
        if len(self._at) + len(chunks) > self.memo_chunks:
            self._forget()
        index = np.fromiter(map(self._at.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(index < 0)
        if len(new):
            index[new] = np.arange(len(self._at), len(self._at) + len(new))
            self._learn([chunks[i] for i in new.tolist()])
        self._texts[index] += 1
        return index

    def _gather(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of ranges of the memo, one after the other."""
        before = np.cumsum(n) - n
        return self._ids[np.repeat(start - before, n) + np.arange(int(n.sum()))]

    def _expand(self, parts: list[str], begin: int) -> np.ndarray:
        # Long texts go through the memo in pieces, so that one text can't outgrow it.
        out = []
        for lo in range(begin, len(parts), 50_000):
            piece = parts[lo : lo + 50_000]
            distinct = list(dict.fromkeys(piece))
            place = dict(zip(distinct, self._numbers(distinct).tolist(), strict=True))
            index = np.fromiter(map(place.__getitem__, piece), np.int64, len(piece))
            start = np.where(index > 0, self._end[index - 1], 0)
            out.append(self._gather(start, self._end[index] - start))
        return out[0] if len(out) == 1 else np.concatenate(out)


@lru_cache(maxsize=2)
def encoder(path: str, memo_chunks: int = MEMO_CHUNKS) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file; workers are reused, and so is its memo."""
    return ChunkEncoder(path, memo_chunks)


def tokenizer_path(name: str) -> str:
    """Where an installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
