"""Exact, cached use of the public tokenizers on whole Arrow batches.

Both vocabularies split a text into small pieces first and apply byte-pair
merges inside each piece only, so a text's ids are the ids of its pieces, one
after another.  Pieces repeat endlessly in prose: here numpy splits a batch of
texts at once, each distinct piece goes through the ``tokenizers`` library's
own model once per worker, and the ids are gathered from that cache.

Texts of ASCII and Latin-1 letters without an apostrophe (whose contractions
have rules of their own) are split here; any other text, and one that holds an
added token's literal (which is an id of its own), goes to the library whole,
with the same result and less speed.  A piece is found in the cache by a hash
and taken from there only when all its bytes are the same; where they aren't
the text goes to the library as well.

Special tokens: nothing is added to a text; the literal of one that stands in a
text is that token, as the library has it by default.
"""

from __future__ import annotations

import numpy as np

from .textbuf import LOWER, chunks, run_hashes

#: Pieces kept per worker; the cache starts afresh beyond it (results don't change).
CACHE_PIECES = 600_000
CACHE_BYTES = 64 << 20

_SPACE, _LETTER, _DIGIT, _OTHER, _UNUSUAL = range(5)
_CLASS = np.full(256, _UNUSUAL, dtype=np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x80:0xC0] = _LETTER  # only after 0xC3
_CLASS[0xC3] = _LETTER
_CLASS[0x27] = _UNUSUAL


#: Masks of the first 0 to 8 bytes of a number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_SPARE = np.zeros(8, np.uint8)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; buf ends with eight spare bytes."""
    return np.ndarray(len(buf) - 8, "<u8", buf, strides=(1,))


def _byte_letters() -> str:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(other)) for b in range(256))


class PieceEncoder:
    """Encodes whole texts to ids; `lower_words`: the lower-casing word vocabulary."""

    def __init__(self, path: str, lower_words: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # in any case of letters: some are looked for in the lower-cased text
        self.added = [t.content.encode("utf-8").lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.lower_words, self.letters = lower_words, _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of pieces
        self.where = np.zeros(0, np.int64)  # of a piece's ids in self.flat
        self.many = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.text_at = np.zeros(0, np.int64)  # of a piece's bytes in self.text
        self.size = np.zeros(0, np.int64)
        self.text = _SPARE

    def library(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and each row's number of ids."""
        parts, counts = [], []
        for lo, hi in chunks(offsets):
            ids, n = self._chunk(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            parts.append(ids)
            counts.append(n)
        return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        odd = np.concatenate([self._odd(buf), self._literals(buf)])
        odd_rows = np.unique(np.searchsorted(offsets, odd, side="right") - 1)
        if not len(odd_rows):
            ids, n, unlike = self._pieces(buf, offsets)
            if not len(unlike):
                return ids, n
            odd_rows = unlike
        plain, out = np.setdiff1d(np.arange(rows), odd_rows), [None] * rows
        if len(plain):
            own = np.concatenate([buf[offsets[r] : offsets[r + 1]] for r in plain])
            ids, n, unlike = self._pieces(own, np.concatenate([[0], np.cumsum(np.diff(offsets)[plain])]))
            for r, x in zip(plain, np.split(ids, np.cumsum(n)[:-1])):
                out[r] = x
            odd_rows = np.concatenate([odd_rows, plain[unlike]])
        for r in odd_rows:
            out[r] = self.library(buf[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8"))
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _literals(self, buf: np.ndarray) -> np.ndarray:
        """Places where an added token's literal begins."""
        raw, places = LOWER[buf].tobytes(), []
        for literal in self.added:
            at = raw.find(literal)
            while at >= 0:
                places.append(at)
                at = raw.find(literal, at + 1)
        return np.array(places, np.int64)

    @staticmethod
    def _odd(buf: np.ndarray) -> np.ndarray:
        """Places of bytes that the fast path doesn't know: all but ASCII and U+00C0 to U+00FF without its two signs."""
        odd = _CLASS[buf] == _UNUSUAL
        lead = np.flatnonzero(buf == 0xC3)
        follow = np.zeros(len(buf), dtype=bool)
        inside = lead[lead + 1 < len(buf)] + 1
        follow[inside] = True
        odd |= (buf >= 0x80) & (buf < 0xC0) & ~follow
        odd[inside[(buf[inside] == 0x97) | (buf[inside] == 0xB7)]] = True
        return np.flatnonzero(odd)

    def _pieces(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, each row's number of ids, and the rows with a piece whose bytes aren't those of the cached one."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int64)
        kind = _CLASS[buf]
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[offsets] = True
        fresh = np.empty(len(buf), dtype=bool)
        fresh[0] = True
        fresh[1:] = kind[1:] != kind[:-1]
        fresh |= edge[:-1]
        if self.lower_words:
            buf = LOWER[buf]
            after = np.flatnonzero(buf[:-1] == 0xC3) + 1
            low = buf[after]
            buf[after] = np.where(low < 0x9F, low + 0x20, low)
            keep = kind != _SPACE
            fresh |= kind == _DIGIT
            starts = np.flatnonzero(fresh & keep)
        else:
            # A blank before a run belongs to it; of more white space the last character stands apart.
            text = np.flatnonzero(fresh & (kind != _SPACE))
            text = text[(text > 0) & ~edge[text]]
            text = text[kind[text - 1] == _SPACE]
            fresh[text - 1] = True
            fresh[text[buf[text - 1] == 0x20]] = False
            keep = np.ones(len(buf), dtype=bool)
            starts = np.flatnonzero(fresh)
        per_row = np.diff(np.searchsorted(starts, offsets, side="left"))
        hashes = run_hashes(buf, keep, starts)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        ends = self._ends(keep, starts)
        self._learn(distinct, first, buf, starts, ends)
        at = np.searchsorted(self.known, distinct)[inverse]
        where, many = self.where[at], self.many[at]
        unlike = self._unlike(at, buf, starts, ends)
        upto = np.cumsum(many)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.flat[np.repeat(where - (upto - many), many) + np.arange(total)]
        sums = np.concatenate([[0], upto])
        return ids, np.diff(sums[np.concatenate([[0], np.cumsum(per_row)])]), np.unique(np.searchsorted(offsets, unlike, side="right") - 1)

    @staticmethod
    def _ends(keep: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where each piece ends; white space that no piece holds may follow."""
        ends = np.append(starts, len(keep))[1:]
        if keep.all():
            return ends
        gaps = np.append(np.flatnonzero(~keep), len(keep))
        return np.minimum(ends, gaps[np.searchsorted(gaps, starts)])

    def _unlike(self, at: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of pieces whose bytes aren't those of the cached piece of the same hash, eight bytes at a time."""
        sizes = ends - starts
        wrong = sizes != self.size[at]
        mine, theirs = _eights(np.concatenate([buf, _SPARE])), _eights(self.text)
        rows, done = np.flatnonzero(~wrong), 0
        while len(rows):
            left = sizes[rows] - done
            same = (mine[starts[rows] + done] ^ theirs[self.text_at[at[rows]] + done]) & _FIRST[np.minimum(left, 8)] == 0
            wrong[rows[~same]] = True
            rows, done = rows[same & (left > 8)], done + 8
        return starts[wrong]

    def _learn(self, distinct: np.ndarray, first: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Runs the library's model on the pieces that aren't known yet."""
        if len(self.known) + len(distinct) > CACHE_PIECES or len(self.text) + len(buf) > CACHE_BYTES:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if not new.any():
            return
        begin, limit = starts[first[new]], ends[first[new]]
        raw, letters, tokenize = buf.tobytes(), self.letters, self.tokenizer.model.tokenize
        ids, many = [], []
        for b, e in zip(begin.tolist(), limit.tolist()):
            got = [t.id for t in tokenize(raw[b:e].decode("latin-1").translate(letters))]
            ids += got
            many.append(len(got))
        many = np.array(many, np.int64)
        where = len(self.flat) + np.cumsum(many) - many
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
        size = limit - begin
        text_at = len(self.text) - 8 + np.cumsum(size) - size
        self.text = np.concatenate([self.text[:-8], np.frombuffer(b"".join(raw[b:e] for b, e in zip(begin.tolist(), limit.tolist())), np.uint8), _SPARE])
        known = np.concatenate([self.known, distinct[new]])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.where, self.many, self.text_at, self.size = (np.concatenate(both)[order] for both in ((self.where, where), (self.many, many), (self.text_at, text_at), (self.size, size)))


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_encoder(path: str | None = None) -> PieceEncoder:
    """Byte-level vocabulary; one instance per worker and path."""
    key = (path or default_path("byte_bpe_50k.json"), False)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def word_encoder(path: str | None = None) -> PieceEncoder:
    """Lower-casing word vocabulary; one instance per worker and path."""
    key = (path or default_path("word_bpe_49k.json"), True)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]
