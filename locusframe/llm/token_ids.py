"""Token ids of whole texts by the tokenizers library, remembered by chunk.

The library spends its time on merges, and words repeat. A text is cut where its tokenizer's own
pre-tokenizer always cuts, each chunk is encoded once by the library and its ids are remembered as bytes;
a text's ids are its chunks' ids joined. The cuts are proved for the two kinds below only, by the patterns
of their files, so other files are refused.

A text that holds the sign that names of special tokens start with, as in <|endoftext|>, goes to the library whole,
so such a name gives its special id, as it does by the library's default.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters of Unicode's property White_Space, as a class of a pattern.
SPACES = r"\t-\r \x85\xa0  -     　"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,;:!?|%&$#*"
_ENDS = rf"(?=[{_MARKS}]*(?:[{SPACES}]|\Z))"
_TAIL = rf"[{_MARKS}]+(?=[{SPACES}]|\Z)"
#: Byte level: one space joins the word after it; of a longer run of white space the last character is left over.
BYTE_LEVEL = rf" ?[{_LETTERS}]+{_ENDS}|{_TAIL}| ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Word ends: white space only separates.
WORD_END = rf"[{_LETTERS}]+{_ENDS}|{_TAIL}|[^{SPACES}]+"
#: Fixed value: what names of special tokens of the files start with.
SPECIAL = "<|"
#: Strings that are remembered, twice at most.
MOST = 300_000
#: Bytes of text that are encoded at a time, unless one text is longer.
BLOCK = 1 << 22
_RUN = rf"[{SPACES}][{SPACES}]|\A[{SPACES}]|[{SPACES}]\z"
_WHOLE = re.compile(rf" ?[{_LETTERS}]+|[{_MARKS}]+").fullmatch
#: Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 and on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = dict.fromkeys(_PRINTED) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SIGNS = {b: b if c is None else c for b, c in _SIGNS.items()}


class Memory(dict):
    """What make gives for a string. When full, all becomes the older half, from which strings that come again are taken."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        name = os.path.basename(path)
        if name not in ("byte_bpe_50k.json", "word_bpe_49k.json"):
            raise ValueError(f"no proved cuts for {name}")
        self.byte_level = name.startswith("byte")
        self.cut = re.compile(BYTE_LEVEL if self.byte_level else WORD_END).findall
        # with the space that opens it a piece is most often one chunk, so one memory is enough
        self.pieces = Memory(self.by_piece, MOST)

    def by_library(self, chunk: str) -> bytes:
        if _WHOLE(chunk):  # the pre-tokenizer leaves these whole, so they go to the library's model at once
            signs = (chunk if self.byte_level else chunk.lower()).encode().decode("latin-1").translate(_SIGNS)
            return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def by_chunks(self, text: str) -> bytes:
        if SPECIAL in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def by_piece(self, piece: str) -> bytes:
        if _WHOLE(piece) or SPECIAL in piece or (cut := self.cut(piece)) == [piece]:
            return self.by_library(piece)
        return b"".join(map(self.pieces.__getitem__, cut))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and the end; null and empty texts have none.

        Texts are cut at spaces, equal pieces are found by Arrow, and each piece's ids are looked up once. At
        byte level a space opens the next piece, a line end opens a piece of its own, and a text is read as
        if a line end came before it, whose id is dropped again. That holds where white space stands alone;
        other texts go by chunks.
        """
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        if self.byte_level:
            odd = pc.or_(pc.match_substring_regex(column, _RUN), pc.equal(column, "")).to_numpy(zero_copy_only=False)
            line_ends = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(column, "\n", " \n"), pa.scalar("", pa.large_string()))
            lists = pc.split_pattern(line_ends, " ")
        else:
            odd = np.zeros(n, bool)
            lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        special = pc.match_substring(column, SPECIAL).to_numpy(zero_copy_only=False)
        odd = odd | special
        words = lists.flatten().dictionary_encode()
        pieces = words.dictionary
        if self.byte_level:
            pieces = pc.if_else(pc.starts_with(pieces, "\n"), pieces, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pieces, pa.scalar(" ", pa.large_string())))
        ids = list(map(self.pieces.__getitem__, pieces.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at, data = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        which = words.indices.to_numpy()
        own = size[which]
        ends = np.concatenate(([0], np.cumsum(own)))
        out = data[np.repeat(at[which] - ends[:-1], own) + np.arange(ends[-1])]
        offsets = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        lead = int(self.byte_level)
        if not odd.any():
            if not lead:
                return out, offsets
            keep = np.ones(len(out), bool)
            keep[offsets[:-1]] = False
            return out[keep], offsets - np.arange(n + 1)
        each = np.split(out, offsets[1:-1])
        parts = [np.frombuffer(self.by_chunks(column[i].as_py()), "<u4") if odd[i] else each[i][lead:] for i in range(n)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def rows(self, column: pa.Array, end: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
        """(row, ids with the end id) of each text; block: bytes of text that are encoded at a time."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))))
        first, stop = 0, end.to_bytes(4, "little")
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(size, size[first] + block, "right")) - 1)
            ids, at = self.encode_column(column.slice(first, last - first))
            raw = memoryview(ids).cast("B")
            for i in range(last - first):
                yield first + i, bytes(raw[at[i] * 4 : at[i + 1] * 4]) + stop
            first = last


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file; its memory lives as long as the process, or until forget."""
    return Encoder(path)


def forget() -> None:
    """Gives up the encoders that earlier tasks have left in this process, and their memory: workers live on and serve other operators."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and its memory hold each other
        give_back()


def give_back() -> None:
    """Gives what this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)
