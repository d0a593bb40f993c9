"""Byte-level BPE: content-defined chunks are encoded once and joined again exactly.

A rolling hash over the UTF-8 bytes cuts a text where its content says so, so that passages shared by documents
yield the same chunks. Each chunk is split at the first and last point where a non-space is followed by a space:
no pre-token crosses such a point, whatever stands around it. What lies between them (the core) is encoded once per
worker and reused. At each join the tail of the left chunk and the head of the right one are encoded anew as one
string; a chunk without such a point is taken into the join whole, and the join grows until both sides agree on a
point. The ids are therefore those of encoding the whole text at once.

Texts are encoded by ranks; the tokenizers library itself encodes what holds a run of white space of `LONG_RUN`
characters or more, for which the other's pattern matcher has no stack.

Null text counts as empty; an empty text has no ids. Repeated rows get repeated results, an empty table gives no rows,
other columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.common import bounded_batches

#: The pre-token pattern of byte-level BPE files (a fixed value of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A chunk ends where the window's hash has this many zero bits: 512 bytes on average.
WINDOW, MASK_BITS = 16, 9
#: Bytes of chunks that one worker keeps before it starts anew.
CACHE_BYTES = 48 << 20
CUT = re.compile(r"(?<=\S)(?=[ \n])")
LAST_CUT = re.compile(r"(?s:.*)(?<=\S)(?=[ \n])")
#: White space that is left to the library.
LONG_RUN = 1 << 14
LONG = re.compile(r"\s{%d}" % LONG_RUN)


def byte_alphabet() -> dict[str, int]:
    """Printable character for each byte, as byte-level vocabularies write them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A tokenizer file of the tokenizers library, encoded by ranks where the file is a plain byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, alphabet = spec["model"], spec.get("pre_tokenizer") or {}, byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        ordered = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        plain = ordered and spec.get("normalizer") is None and spec.get("post_processor") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex")
        plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", []))
        if not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.library = reference(path)
        self.by_rank = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.cores: dict[bytes, tuple[str, array, str] | None] = {}
        self.held = self.reused = self.made = 0

    def encode(self, text: str) -> list[int]:
        """The whole text at once."""
        if len(text) >= LONG_RUN and LONG.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.by_rank.encode(text, allowed_special="all", disallowed_special=())
        return self.by_rank.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return self.by_rank.decode_bytes(ids)

    def chunks(self, raw: bytes) -> Iterator[bytes]:
        """Content-defined pieces of a UTF-8 string; no character is cut."""
        if len(raw) <= WINDOW:
            yield raw
            return
        b = np.frombuffer(raw, np.uint8)
        h, step, base = b.astype(np.uint32), 1, 0x9E3779B1
        while step < WINDOW:  # hashes of windows of 2, 4, 8, ... bytes
            h = h[:-step] * np.uint32(base) + h[step:]
            base, step = base * base % (1 << 32), 2 * step
        ends = np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - MASK_BITS) == 0) + WINDOW
        ends = ends[ends < len(raw)]
        ends = ends[(b[ends] & 0xC0) != 0x80]
        last = 0
        for e in ends.tolist():
            yield raw[last:e]
            last = e
        yield raw[last:]

    def core(self, chunk: bytes) -> tuple[str, array, str] | None:
        if chunk in self.cores:
            self.reused += 1
            return self.cores[chunk]
        self.made += 1
        text, found = chunk.decode(), None
        if first := CUT.search(text):
            at = LAST_CUT.match(text).end()
            found = (text[: first.start()], array("I", self.encode(text[first.start() : at])), text[at:])
        self.held += 6 * len(chunk) + 400
        if self.held > CACHE_BYTES:
            self.cores, self.held = {}, 0
        self.cores[chunk] = found
        return found

    def encode_by_chunks(self, text: str) -> array:
        """As encode(), from reused chunks and repaired joins."""
        ids, join = array("I"), ""
        for chunk in self.chunks(text.encode()):
            if (got := self.core(chunk)) is None:
                join += chunk.decode()
            else:
                ids.extend(array("I", self.encode(join + got[0])))
                ids.extend(got[1])
                join = got[2]
        ids.extend(array("I", self.encode(join)))
        return ids


@lru_cache(2)
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def reference(path: str) -> Tokenizer:
    """What the ids must equal."""
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def transcode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string: every whole text encoded by chunks, and its ids decoded again."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [c.encode_by_chunks(t or "") for t in batch.column(1).to_pylist()]
            flat = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int32) if x else np.empty(0, np.int32) for x in ids]) if ids else np.empty(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            decoded = pa.array([c.decode(x).decode("utf-8", "replace") for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded], ["doc_id", "ids", "decoded"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
