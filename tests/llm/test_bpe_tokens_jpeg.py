import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabulon.llm import bpe, jpeg, token_counts

RANDOM = random.Random(3)
PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "😀", "漢", "1", "'s", "<|endoftext|>", ".", "\x1c", "<|endof", "text|>", "\x85", " ", "the ", "whole "]
TEXTS = ["", " ", "a", "漢" * 9000, " " * 20000, "x" * 9000] + ["".join(RANDOM.choice(PIECES) for _ in range(RANDOM.randint(0, 3000))) for _ in range(60)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_chunks_agree_with_the_library(library):
    enc = bpe.ChunkEncoder(bpe.vocabulary(bpe.default_vocabulary()), table_bytes=50_000)
    for _ in range(2):
        for t in TEXTS:
            ids = enc.encode(t)
            want = library.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want and enc.vocab.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_shared_passages_are_encoded_once():
    enc = bpe.ChunkEncoder(bpe.vocabulary(bpe.default_vocabulary()))
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(4000))
    enc.encode("one " + passage)
    made = enc.made
    enc.encode("another beginning, then " + passage)
    assert enc.reused > 20 and enc.made - made < 6


def test_encoded_table(spark, library):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(99, None, "x"), (99, None, "x"), (None, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(docs).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want) and bpe.encoded(docs.limit(0)).count() == 0


def test_unigram_counts(spark):
    model = token_counts.unigram(token_counts.default_ranks())

    def brute(w):
        best = [(0, 0)] + [None] * len(w)
        for j in range(1, len(w) + 1):
            best[j] = min((best[i][0] + (model.cost[w[i:j]] >> 24), best[i][1] + 1) for i in range(max(0, j - 200), j) if w[i:j] in model.cost)
        return best[-1][1]

    words = sorted({w.encode() for t in TEXTS[6:30] for w in token_counts._WORDS.findall(t)} | {b"=" * 300, b" international", b" internationally"})
    assert model.counts(words) == [brute(w) for w in words]
    docs = spark.createDataFrame([(1, "hello world, hello"), (2, None), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs).collect())
    assert got == [(1, sum(brute(w.encode()) for w in token_counts._WORDS.findall("hello world, hello"))), (2, 0), (2, 0), (3, 0)]


@pytest.mark.parametrize("max_rows", [jpeg.MAX_ROWS, 2])
def test_payload_round_trip(max_rows):
    r = np.random.default_rng(0)
    payloads = [jpeg.payload_of(t)[1] for t in TEXTS[:30]] + [r.integers(0, 256, 64 * k, np.uint8).tobytes() for k in (1, 3, 50)] + [b"\xff" * 640, bytes([0, 255] * 32)]
    media = jpeg.store_payload(payloads, max_rows)
    for p, images in zip(payloads, jpeg.read_images([np.frombuffer(m, np.uint8) for m in media]), strict=True):
        assert b"".join(i.thumbnail.tobytes() for i in images) == p


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, v, n):
        self.s += format(v, f"0{n}b") if n else ""

    def bytes(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")


def colour_image(width, height, restart, seed):
    """A baseline JPEG of three components, 4:2:0, with AC coefficients, and its luminance DC levels, made block by block."""
    r = random.Random(seed)
    dc_bits, dc_sym = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
    ac_sym = (0x00, 0xF0, 0x01, 0x12, 0x23, 0x31)
    ac_bits = (0, 1, 2, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    dc = {s: (c, n) for s, c, n in jpeg._codes(dc_bits, dc_sym)}
    ac = {s: (c, n) for s, c, n in jpeg._codes(ac_bits, ac_sym)}
    across, down = -(-width // 16), -(-height // 16)
    levels, out, pred, bits, n = np.zeros((down * 2, across * 2), int), b"", [0, 0, 0], Bits(), 0

    def amplitude(v, size):
        bits.put(v if v >= 0 else v + (1 << size) - 1, size)

    for y in range(down):
        for x in range(across):
            if restart and n and n % restart == 0:
                out += bits.bytes() + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
                bits, pred = Bits(), [0, 0, 0]
            n += 1
            for c, (dy, dx) in [(0, (0, 0)), (0, (0, 1)), (0, (1, 0)), (0, (1, 1)), (1, (0, 0)), (2, (0, 0))]:
                v = r.randint(-60, 60)
                if c == 0:
                    levels[2 * y + dy, 2 * x + dx] = v
                d, pred[c] = v - pred[c], v
                size = abs(d).bit_length()
                bits.put(*dc[size])
                amplitude(d, size)
                k = 1
                while k < 64 and r.random() < 0.8:
                    s = r.choice(ac_sym[1:])
                    run, size = s >> 4, s & 15
                    if k + run > 63:
                        break
                    bits.put(*ac[s])
                    if size:
                        amplitude(r.choice([-1, 1]) * r.randint(1 << size - 1, (1 << size) - 1), size)
                    k += run + 1
                if k < 64:
                    bits.put(*ac[0])
    out += bits.bytes()
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, 16, *[9] * 63])) + seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(0xC4, bytes([0, *dc_bits, *dc_sym, 0x10, *ac_bits, *ac_sym])) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return head + out + b"\xff\xd9", np.clip((levels * 16 + 4 >> 3) + 128, 0, 255)


def test_colour_images_with_restarts():
    made = [colour_image(w, h, k, i) for i, (w, h, k) in enumerate([(16, 16, 0), (40, 33, 0), (64, 64, 3), (100, 20, 1)])]
    found = jpeg.read_images([np.frombuffer(m, np.uint8) for m, _ in made] + [np.frombuffer(made[0][0][:-9] + b"\xff\xd9", np.uint8)])
    for (_, want), got in zip(made, found, strict=False):
        assert np.array_equal(got[0].thumbnail, want)
    assert isinstance(found[-1], str)


def test_media_tables(spark):
    docs = spark.createDataFrame([(1, "a", 0), (2, None, 0), (2, None, 0), (3, "é" * 50000, 0)], "doc_id long, text string, media_bytes int")
    rows = jpeg.stored_texts(docs, keep_media=True).collect()
    assert len(rows) == 4
    for r in rows:
        n, payload = jpeg.payload_of({1: "a", 2: None, 3: "é" * 50000}[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.media_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest(), hashlib.sha256(r.media).hexdigest())
    media = spark.createDataFrame([(r.doc_id, bytes(r.media)) for r in rows] + [(7, None), (8, b"no image")], "id long, m binary")
    got = {r.id: r for r in jpeg.media_features(media, "m", "id").collect()}
    assert got[1].width == 512 and got[7].error and got[8].error and got[3].images == 1
    assert jpeg.stored_texts(docs.limit(0)).count() == 0
