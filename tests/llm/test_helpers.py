"""Vectorised text buffers, tokenization, codecs and packing against plain Python."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import packing, token_output, tokenize
from lodestone.llm.near_dedup import elements, signatures, similar
from lodestone.llm.textbuf import buffers, chunks, shingles, words

TEXTS = ["", None, "one", "Ab cd  ef,gh\n12é", "a b c d e f", "ÀÉ x", "the THE The", "日本 語 text"]


def plain_words(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_and_shingles():
    buf, offsets = buffers(pa.array(TEXTS))
    hashes, counts = words(buf, offsets)
    assert counts.tolist() == [len(plain_words(t)) for t in TEXTS]
    flat = [w for t in TEXTS for w in plain_words(t)]
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (hashes[i] == hashes[j]) == (a == b)
    s, row = shingles(hashes, counts, 5)
    want = [max(len(plain_words(t)) - 4, 1 if plain_words(t) else 0) for t in TEXTS]
    assert np.bincount(row, minlength=len(TEXTS)).tolist() == want
    assert buffers(pa.array([], pa.string()))[1].tolist() == [0]
    assert [list(c) for c in [chunks(np.array([0, 3, 9, 10]), 4)]] == [[(0, 1), (1, 2), (2, 3)]]


@pytest.mark.parametrize("make", [tokenize.byte_encoder, tokenize.word_encoder])
def test_encoders_equal_the_library(make):
    encoder, rng = make(), random.Random(5)
    alphabet = "ab cdE\n\t 'sS't\r129²¼_-!<|endoftext|>  éÉſİŉßÀÞ÷×ÿ xyz日本IJ"
    for _ in range(60):
        texts = [None if rng.random() < 0.05 else "".join(rng.choices(alphabet[: rng.randint(4, len(alphabet))], k=rng.randint(0, 40))) for _ in range(20)]
        ids, counts = encoder.encode(*buffers(pa.array(texts, pa.string())))
        ends = np.cumsum(counts)
        for t, e, n in zip(texts, ends, counts):
            assert ids[e - n : e].tolist() == (encoder.library(t).tolist() if t else [])


@pytest.mark.parametrize(("make", "name"), [(tokenize.byte_encoder, "byte_bpe_50k.json"), (tokenize.word_encoder, "word_bpe_49k.json")])
def test_encoders_equal_a_fresh_library(make, name):
    """Also where a text holds an added token's literal."""
    from tokenizers import Tokenizer

    encoder, fresh, rng = make(), Tokenizer.from_file(tokenize.default_path(name)), random.Random(8)
    literals = [t.content for t in fresh.get_added_tokens_decoder().values()]
    assert literals
    parts = [*literals, *[x.upper() for x in literals], literals[0][:-1], literals[0][1:], " one", "two ", "  ", "3", "it's", "\n", "é", "."]
    texts = ["one <|endoftext|> two", "plain words", *literals, *["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(300)]]
    ids, counts = encoder.encode(*buffers(pa.array(texts)))
    for t, e, n in zip(texts, np.cumsum(counts), counts):
        assert ids[e - n : e].tolist() == fresh.encode(t, add_special_tokens=False).ids, t


def test_encoder_forgets_without_harm(monkeypatch):
    encoder = tokenize.PieceEncoder(tokenize.default_path("byte_bpe_50k.json"), False)
    monkeypatch.setattr(tokenize, "CACHE_PIECES", 3)
    for text in ["some words here and there", "other words now", "some words here and there"]:
        ids, _ = encoder.encode(*buffers(pa.array([text])))
        assert ids.tolist() == encoder.library(text).tolist()


@pytest.mark.parametrize("n", [1, 2, 4095, 4096, 4097, 30_000])
def test_codec_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype(np.uint32)
    table = token_output.Table.of([ids])
    again = token_output.Table.from_bytes(table.to_bytes())
    block = token_output.pack_block([3, None], np.array([n - 1, 1]), ids, table)
    doc_ids, lengths, back = token_output.unpack_block(block, again)
    assert doc_ids == [3, None] and lengths.tolist() == [n - 1, 1] and (back == ids).all()
    with pytest.raises(ValueError, match="checksum"):
        token_output.unpack_block(block[:-1] + bytes([block[-1] ^ 1]), again)


def test_frequencies_keep_every_id():
    freq = token_output.scaled(np.array([10**12, 1, 1, 5]))
    assert freq.sum() == 1 << token_output.SCALE_BITS and freq.min() >= 1


def test_best_fit_and_bound():
    rng = random.Random(1)

    def optimum(sizes, capacity):
        best = [len(sizes)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + sizes[i] <= capacity:
                    bins[j] += sizes[i]
                    go(i + 1, bins)
                    bins[j] -= sizes[i]
            bins.append(sizes[i])
            go(i + 1, bins)
            bins.pop()

        go(0, [])
        return best[0]

    for _ in range(200):
        capacity = rng.choice([10, 13, 20])
        sizes = sorted((rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 8))), reverse=True)
        where, offset, fills = packing.best_fit(np.array(sizes), capacity)
        bound = packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        assert bound <= optimum(sizes, capacity) <= len(fills)
        assert max(fills) <= capacity and np.bincount(where, weights=sizes).tolist() == fills.tolist()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 1 << 44, n, dtype=np.uint64) for n in (400, 50, 50))
    x, row = np.concatenate([common, a, common, b]), np.repeat([0, 1], 450)
    sig = signatures(x, row, np.ones(len(x)), 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.08
    assert (signatures(x, row, np.ones(len(x)), 2, 512) == sig).all()
    s, r, many = elements(*buffers(pa.array(["a b c d e a b c d e f", ""])), 5)
    assert r.tolist() == [0] * 6 and sorted(many.tolist()) == [1] * 5 + [2]
    sets = [np.sort(rng.choice(1000, 80, replace=False)).astype(np.uint64) for _ in range(12)] + [np.arange(80, dtype=np.uint64), np.arange(8, 80, dtype=np.uint64)]
    want = [[len(set(p) & set(q)) / len(set(p) | set(q)) >= 0.8 for q in map(np.ndarray.tolist, sets)] for p in map(np.ndarray.tolist, sets)]
    assert similar(sets, sets, 0.8).tolist() == want


def test_crc_is_over_little_endian_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\2\0\0\0")


def thue_morse(n, a="a", b="b"):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out[:n]


@pytest.mark.parametrize(("make", "name"), [(tokenize.byte_encoder, "byte_bpe_50k.json"), (tokenize.word_encoder, "word_bpe_49k.json")])
@pytest.mark.parametrize("hashed", ["as it is", "to three values"])
def test_pieces_are_told_apart_by_bytes(make, name, hashed, monkeypatch):
    """Long regular runs whose polynomial hashes are equal, and a hash that hardly tells pieces apart."""
    from tokenizers import Tokenizer

    fresh, rng = Tokenizer.from_file(tokenize.default_path(name)), random.Random(4)
    encoder = tokenize.PieceEncoder(tokenize.default_path(name), make is tokenize.word_encoder)
    if hashed != "as it is":
        plain = tokenize.run_hashes
        monkeypatch.setattr(tokenize, "run_hashes", lambda *a: plain(*a) % np.uint64(3))
    texts = [t for n in (1024, 2048) for t in (thue_morse(n), thue_morse(n, "b", "a"))] + ["one two", "two  one\n3 ", "", "One, two"]
    texts += [" ".join(rng.choice(["aa", "bb", "ab", "c", "12"]) for _ in range(9)) for _ in range(20)]
    for batch in (texts, texts[::-1]):
        ids, counts = encoder.encode(*buffers(pa.array(batch)))
        for t, e, n in zip(batch, np.cumsum(counts), counts):
            assert ids[e - n : e].tolist() == fresh.encode(t, add_special_tokens=False).ids, t[:40]


def test_long_regular_words_differ():
    buf, offsets = buffers(pa.array([thue_morse(2048) + " x", thue_morse(2048, "b", "a") + " x"]))
    hashes, counts = words(buf, offsets)
    assert counts.tolist() == [2, 2] and hashes[0] != hashes[2] and hashes[1] == hashes[3]
