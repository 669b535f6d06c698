"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 16 bytes says so, hence alike in whatever document a passage stands. A chunk
that is met again takes its ids from a table; only the joins are encoded anew: at each join the text from the last point in
the left chunk to the first point in the right chunk at which tokenisation provably restarts (a non-space before a white
space) is re-encoded, and the window grows over further chunks until the chunks' own token boundaries agree with both ends.

The table lives in the Python worker and is bounded in bytes, oldest chunks first out. Sharing it among tasks would put every
text through a shuffle, which costs more than encoding does; see README.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import load

#: Bytes: a chunk's least and greatest length; a cut falls on one position in MEAN on average.
LEAST, MEAN, MOST = 128, 512, 8192
#: Bytes of chunk text and ids that one worker keeps.
TABLE_BYTES = 32_000_000

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FIRST, _LAST = regex.compile(r"\S[ \n\r\t]"), regex.compile(r"(?r)\S[ \n\r\t]")
_GEAR = np.random.default_rng(7_919).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def default_vocabulary() -> str:
    """Where the public 50k byte-level BPE file lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of the tokenizers library's file at ``path``, encoded by ranks; special tokens in a text are found as it finds them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {t: i for t, i in ranks.items() if i not in special.values()}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: ids don't follow the order of merges, or it isn't plain byte-level BPE")
        self._encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes_of = {i: t for t, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        self._lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, t in self.bytes_of.items():
            self._lengths[i] = len(t)

    def encode(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self._encoding.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self._lengths[ids])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def cuts(data: bytes) -> list[int]:
    """Where chunks of ``data`` (UTF-8) end; depends on the 16 bytes before each end only, but for LEAST and MOST."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    at = np.flatnonzero((h[:-1] >> np.uint32(8)) % np.uint32(MEAN) == 0) + 1
    at = at[raw[at] & 0xC0 != 0x80].tolist()
    out, last = [], 0
    for p in [*at, n]:
        while p - last > MOST:
            q = last + MOST
            while raw[q] & 0xC0 == 0x80:
                q -= 1
            out.append(last := q)
        if p - last >= LEAST or p == n:
            out.append(last := p)
    return out


class ChunkEncoder:
    """Encodes texts by chunks; ``table`` keeps (first restart, last restart, ids between them) of each chunk."""

    def __init__(self, vocab: Vocabulary, table_bytes: int = TABLE_BYTES):
        self.vocab, self.left, self.table = vocab, table_bytes, {}
        self.reused = self.made = 0

    def _chunk(self, chunk: bytes) -> tuple[int, int, np.ndarray] | None:
        if chunk in self.table:
            self.reused += 1
            return self.table[chunk]
        self.made += 1
        text, found = chunk.decode(), None
        if first := _FIRST.search(text):
            last = _LAST.search(text)
            ids = self.vocab.encode(text)
            ends = self.vocab.ends(ids)
            a, b = len(text[: first.start() + 1].encode()), len(text[: last.start() + 1].encode())
            i, j = np.searchsorted(ends, (a, b))
            if ends[i] == a and ends[j] == b:  # the chunk's own boundaries agree with the restarts
                found = a, b, ids[i + 1 : j + 1].copy()
        self.table[chunk] = found
        self.left -= 2 * len(chunk) + 300
        while self.left < 0:
            old = next(iter(self.table))
            del self.table[old]
            self.left += 2 * len(old) + 300
        return found

    def encode(self, text: str) -> np.ndarray:
        data, out, open_, start = text.encode(), [], [], 0
        for end in cuts(data):
            chunk = data[start:end]
            start = end
            known = self._chunk(chunk)
            if known is None:  # no agreement in here: the window grows over the chunk
                open_.append(chunk)
                continue
            a, b, ids = known
            out.append(self.vocab.encode((b"".join(open_) + chunk[:a]).decode()))
            out.append(ids)
            open_ = [chunk[b:]]
        if open_:
            out.append(self.vocab.encode(b"".join(open_).decode()))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


_workers: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder: chunks stay known from one batch and one task to the next."""
    if path not in _workers:
        _workers[path] = ChunkEncoder(vocabulary(path))
    return _workers[path]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = (), keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id_col, n_tokens, ids_sha256, decoded_sha256, the columns in ``keep``; ids or the decoded text on demand.

    A null text counts as empty and has no tokens; texts are encoded whole; special tokens' strings in a text become those tokens.
    """
    path = path or default_vocabulary()
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for t in b.column(0):
                ids = enc.encode(t.as_py() or "")
                back = enc.vocab.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(ids.astype(np.int32))
                if keep_text:
                    texts.append(back)
            more = ([pa.array(all_ids, pa.list_(pa.int32()))] if keep_ids else []) + ([pa.array(texts, pa.string())] if keep_text else [])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), *more], names=names)

    kept = [id_col, *(k for k in keep if k != id_col)]
    names = [f"k{i}" for i in range(len(kept))] + ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_text
    schema = ", ".join([*(f"k{i} {fields[k]}" for i, k in enumerate(kept)), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * keep_ids, *["decoded string"] * keep_text])
    out = docs.select(F.col(text_col).cast("string").alias("t"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(kept))).mapInArrow(run, schema)
    return out.withColumnsRenamed({f"k{i}": k for i, k in enumerate(kept)})


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level BPE."""
    return encoded(load(spark, sf_dir, "documents"))
