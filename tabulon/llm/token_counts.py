"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch are put into a trie (their sorted order is its depth-first walk, so the path from the root
is all that is held). Each node's forward score, the best segmentation of its prefix, is computed once however many
pre-tokens share the prefix; the token count at a terminal node is stored for the pre-token, and a document's count is the
sum over its pre-tokens. Pre-tokens that stay known are bounded in number per worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import load
from .bpe import PATTERN

#: Pre-tokens whose counts a worker keeps.
KNOWN = 400_000
#: Characters of text whose pre-tokens are counted together.
AT_ONCE = 1_000_000
#: Bits that count pieces beside a cost: a text of Spark has less than 2**31 bytes.
PIECE_BITS = 31
_WORDS = regex.compile(PATTERN)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Unigram:
    """Scores of a rank file under Zipf's law: a piece of rank r costs log2(r + 2), in integer steps of 1/4096 bit.

    Integer costs make ties exact; of equal costs the segmentation of fewer pieces counts. All single bytes are pieces.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        top = len(ranks) + 1
        # cost and piece in one integer: cost first, then the number of pieces, with more bits than a text can have pieces
        self.cost = {t: (round(4096 * log2(r + 2)) << PIECE_BITS) + 1 for t, r in ranks.items()}
        for b in range(256):
            self.cost.setdefault(bytes([b]), (round(4096 * log2(top + 2)) << PIECE_BITS) + 1)
        # every ending of a piece: its cost, or 0 if it isn't a piece itself; what is missing ends no piece
        self._endings = {t[i:]: 0 for t in self.cost for i in range(len(t))} | self.cost

    def counts(self, words: list[bytes]) -> list[int]:
        """Pieces in the best segmentation of each of ``words``, which are sorted and distinct."""
        endings, path, before, out = self._endings.get, [0], b"", []
        for w in words:
            n, k = len(w), 0
            for a, b in zip(before, w):  # noqa: B905  the shorter one ends the shared prefix
                if a != b:
                    break
                k += 1
            del path[k + 1 :]
            for j in range(k + 1, n + 1):
                best = path[j - 1] + endings(w[j - 1 : j])
                for i in range(j - 2, -1, -1):
                    c = endings(w[i:j])
                    if c is None:
                        break
                    if c and path[i] + c < best:
                        best = path[i] + c
                path.append(best)
            out.append(path[n] & (1 << PIECE_BITS) - 1)
            before = w
        return out


@lru_cache(2)
def unigram(path: str) -> Unigram:
    return Unigram(path)


_known: dict[str, dict[str, int]] = {}


def count_batch(texts: list[str], model: Unigram, known: dict[str, int]) -> tuple[list[int], list[int]]:
    """(pre-tokens, tokens) of each text; ``known`` grows by what is new and is emptied beyond KNOWN."""
    words = [_WORDS.findall(t) for t in texts]
    if len(known) > KNOWN:
        known.clear()
    new = {x for w in words for x in w}.difference(known)
    spelled = sorted((x.encode(), x) for x in new)
    known.update(zip((x for _, x in spelled), model.counts([b for b, _ in spelled]), strict=True))
    get = known.__getitem__
    return [len(w) for w in words], [sum(map(get, w)) for w in words]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, n_pretokens, n_tokens) per row of ``docs``; null and empty texts have 0.

    Texts are counted whole, however long; rows that repeat an id or a text stay rows of their own with equal counts; an
    empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    path = path or default_ranks()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = unigram(path), _known.setdefault(path, {})
        for b in batches:
            pre, tok, held, size = [], [], [], 0

            def flush(pre: list = pre, tok: list = tok) -> None:
                p, t = count_batch(held, model, known)
                pre.extend(p)
                tok.extend(t)
                held.clear()

            for t in b.column(1):
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size > AT_ONCE:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(pre, np.int64)), pa.array(np.array(tok, np.int64))], names=["id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts(load(spark, sf_dir, "documents"))
