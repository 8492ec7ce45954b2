"""SentencePiece encoding and decoding in batched numpy.

A text is cut where no piece can span (before a space mark that follows something else), the distinct
words of a batch are encoded once, and words of equal length advance together: at each end position
the hashes of all substrings ending there probe the sorted piece keys, and the best candidate's
length is stored as the backpointer.

For a unigram model the best candidate has the largest summed score. A BPE model's scores are merge
ranks whose sum has no meaning (the plain Viterbi path differs from the model's own segmentation), so
there a candidate must besides form a stable pair with the piece before it: merging both from
characters leaves exactly the two. A segmentation is the model's own if and only if all its
neighbours are stable, and each prefix has one, so the longest stable candidate is the answer.

Null text encodes to an empty list, as the empty text does, and decodes to the empty text. Rows are
kept one for one, repeated ones too; an empty table gives an empty result; further columns are
ignored. Characters without a piece become byte pieces (or the unknown piece if the model has none).
U+2581 in a text decodes to a space, as in the format itself.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import need

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The format's space mark, piece types, model types and penalty of an unknown character.
SPACE, NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = "▁", 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OUT = -1  # stands for an unknown character
_LONG = 48
_CELLS = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of a serialized message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            n, at = {1: (8, at), 5: (4, at)}.get(tag & 7) or number(at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values lo[i], lo[i] + 1, ... (n[i] of them) for each i in turn."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _merged(text: str, rank: dict[str, int]) -> list[str]:
    """Plain BPE of one string: merge the best-ranked neighbours, leftmost first."""
    parts = list(text)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], 1 << 40), i))
        if parts[best] + parts[best + 1] not in rank:
            return parts
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


#: Every byte that is not part of a character becomes a replacement character of its own.
codecs.register_error("each-byte-replaced", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class _Numbers(dict):
    """Numbers words in the order of their first lookup."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


#: Of the words of at most ``_LONG`` characters, so many ids are remembered in a task before it starts afresh;
#: longer words (an unspaced text is one) are never remembered. Slots for neighbours found stable or not.
MEMO, SLOTS = 2_000_000, 1 << 18


class Pieces:
    """A model file as sorted arrays. Its size is that of the vocabulary, whatever the input."""

    def __init__(self, model: bytes, kind: int | None = None) -> None:
        names, scores, types, trainer, normal = [], [], [], {}, {3: 1, 4: 1, 5: 1}
        for field, value in _fields(model):
            if field == 1:
                piece = {3: NORMAL} | dict(_fields(value))
                names.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                types.append(piece[3])
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal |= dict(_fields(value))
        self.names, self.kind = names, kind or trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normal.get(2) or normal[4] or not normal[5] or USER in types:
            raise ValueError("only unigram and BPE models without text normalisation or user-defined pieces are supported")
        self.prefix = SPACE if normal[3] else ""
        self.unknown = types.index(UNKNOWN)
        self.bytes = np.full(256, self.unknown)
        for i, t in enumerate(types):
            if t == BYTE:
                self.bytes[int(names[i][3:5], 16)] = i
        self.falls_back = BYTE in types
        rank = {names[i]: k for k, i in enumerate(sorted((i for i, t in enumerate(types) if t in (NORMAL, UNUSED)), key=lambda i: -scores[i]))}
        ids = {names[i]: i for i, t in enumerate(types) if t in (NORMAL, UNUSED)}
        if any(SPACE in n.lstrip(SPACE) for n in ids):
            raise ValueError("a piece spans words")
        splits: dict[str, tuple[str, str]] = {}
        if self.kind == BPE:
            for n in list(ids):
                if len(n) > 1:
                    inner = {m: rank[m] for k in range(len(n)) for j in range(k + 2, len(n) + 1) if (m := n[k:j]) in rank and m != n}
                    parts = _merged(n, inner)
                    if len(parts) == 2:
                        splits[n] = (parts[0], parts[1])
                    else:
                        del ids[n]  # no merge forms it
        order = sorted(ids, key=ids.get)
        self.piece_ids = np.array([ids[n] for n in order])
        at = {n: k for k, n in enumerate(order)}
        self.width = max(map(len, order), default=1)
        self.chars = np.zeros((len(order), self.width), np.uint32)
        for k, n in enumerate(order):
            self.chars[k, : len(n)] = [ord(c) for c in n]
        self.lengths = np.array([len(n) for n in order])
        self.scores = np.array([scores[ids[n]] for n in order])
        self.least = min(self.scores, default=0.0) - UNKNOWN_PENALTY
        keys = self._hash(self.chars, self.lengths)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys >> np.uint64(44)] = True
        # Merge ranks; a single character has none. Halves of the last merge; pairs that merge.
        self.rank = np.array([rank[n] if len(n) > 1 else -1 for n in order])
        self.left, self.right = np.arange(len(order)), np.arange(len(order))
        pairs = []
        for n, k in at.items():
            if n in splits:
                a, b = splits[n]
                self.left[k], self.right[k] = at[a], at[b]
                if max(self.rank[at[a]], self.rank[at[b]]) >= self.rank[k]:
                    raise ValueError("a merge outranks the ones it is made of")
            if len(n) > 1:
                pairs += [(at[n[:j]] * len(order) + at[n[j:]], self.rank[k]) for j in range(1, len(n)) if n[:j] in at and n[j:] in at]
        pairs.sort()
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
        beside = {(ord(a) << 32) | ord(b) for n in order for a, b in zip(n, n[1:], strict=False)}
        self.beside = np.array(sorted(beside), np.uint64)
        self.texts = [b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else bytes([int(n[3:5], 16)]) if t == BYTE else n.replace(SPACE, " ").encode() for n, t in zip(names, types, strict=True)]
        self.spaced = np.array([n.startswith(SPACE) for n in names])
        self.silent = np.array([t == CONTROL for t in types])
        self.slot_keys, self.slot_values = np.full(SLOTS, -1), np.zeros(SLOTS, bool)
        self._forget()

    def _forget(self) -> None:
        self.memo, self.memo_ids, self.memo_ends, self.memo_used = _Numbers(), np.zeros(1 << 12, np.int32), np.zeros(1 << 10, np.int64), 0

    def _remember(self, ids: np.ndarray, n: np.ndarray) -> None:
        """Appends to arrays that double when they are full. ``memo_ends[k + 1]`` is where word k ends."""
        used, words = self.memo_used, len(self.memo) - len(n)
        while used + len(ids) > len(self.memo_ids):
            self.memo_ids = np.concatenate((self.memo_ids, np.zeros_like(self.memo_ids)))
        while len(self.memo) + 1 > len(self.memo_ends):
            self.memo_ends = np.concatenate((self.memo_ends, np.zeros_like(self.memo_ends)))
        self.memo_ids[used : used + len(ids)] = ids
        self.memo_ends[words + 1 : len(self.memo) + 1] = used + np.cumsum(n)
        self.memo_used = used + len(ids)

    @classmethod
    def load(cls, path: str = MODEL, kind: int | None = None) -> Pieces:
        return cls(Path(path).read_bytes(), kind)

    @staticmethod
    def _hash(chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chars), np.uint64)
        for k in range(chars.shape[1]):
            out = np.where(k < lengths, out * _BASE + chars[:, k] + np.uint64(1), out)
        return out

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_stable``, of which the last answer is kept in each slot."""
        ok = a == _OUT
        ask = np.flatnonzero(~ok)
        key = a[ask] * len(self.lengths) + b[ask]
        slot = (key.view(np.uint64) * _BASE >> np.uint64(64 - SLOTS.bit_length() + 1)).view(np.int64)
        new = np.flatnonzero(self.slot_keys[slot] != key)
        ok[ask] = self.slot_values[slot]
        if len(new):
            fresh = self._stable(a[ask[new]], b[ask[new]])
            ok[ask[new]] = fresh
            # Two new pairs may share a slot: the pair that the key is left with gives the value too.
            self.slot_keys[slot[new]] = key[new]
            own = self.slot_keys[slot[new]] == key[new]
            self.slot_values[slot[new][own]] = fresh[own]
        return ok

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the neighbours a, b as they are: their merges are undone, last first,
        and at no time does a merge across the border come before the one undone."""
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a != _OUT) & (b != _OUT))
        a, b = a[live], b[live]
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            key = a * len(self.lengths) + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
            clash = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit) if len(self.pair_keys) else np.zeros(len(key), bool)
            ok[live[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~clash & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def _probe(self, codes: np.ndarray, hashes: np.ndarray, powers: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, length and piece of every substring that ends at ``end`` and is a piece."""
        ks = np.arange(1, min(end, self.width) + 1)
        subs = hashes[:, end : end + 1] - hashes[:, end - ks] * powers[ks]
        row, col = np.nonzero(self.filter[subs >> np.uint64(44)])
        sub, k = subs[row, col], ks[col]
        at = np.minimum(np.searchsorted(self.keys, sub), len(self.keys) - 1)
        piece = self.order[at]
        hit = (self.keys[at] == sub) & (self.lengths[piece] == k)
        row, k, piece = row[hit], k[hit], piece[hit]
        same = np.ones(len(row), bool)
        for j in range(min(end, self.width)):
            inside = np.flatnonzero(j < k)
            same[inside] &= codes[row[inside], end - k[inside] + j] == self.chars[piece[inside], j]
        return row[same], k[same], piece[same]

    def _advance(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of equal length: the piece that ends at each position, and its length."""
        n, size = codes.shape
        hashes = np.zeros((n, size + 1), np.uint64)
        powers = np.cumprod(np.append(np.uint64(1), np.full(self.width, _BASE)))
        for i in range(size):
            hashes[:, i + 1] = hashes[:, i] * _BASE + codes[:, i] + np.uint64(1)
        last, back = np.full((n, size + 1), _OUT), np.ones((n, size + 1), np.int64)
        total = np.zeros((n, size + 1)) if self.kind == UNIGRAM else None
        for end in range(1, size + 1):
            row, k, piece = self._probe(codes, hashes, powers, end)
            if total is None:
                before = np.where(k == end, _OUT, last[row, end - k])
                fit = self.stable(before, piece)
                row, k, piece = row[fit], k[fit], piece[fit]
                value = k.astype(float)
            else:
                value = total[row, end - k] + self.scores[piece]
                single = np.zeros(n, bool)
                single[row[k == 1]] = True
                other = np.flatnonzero(~single)
                row, k, piece = np.append(row, other), np.append(k, np.ones(len(other), np.int64)), np.append(piece, np.full(len(other), _OUT))
                value = np.append(value, total[other, end - 1] + self.least)
            order = np.lexsort((value, row))  # the largest value of each row comes last
            row, k, piece, value = row[order], k[order], piece[order], value[order]
            top = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.zeros(0, np.int64)
            last[row[top], end], back[row[top], end] = piece[top], k[top]
            if total is not None:
                total[row[top], end] = value[top]
        return last, back

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start, owner = np.cumsum(size) - size, np.arange(len(words))
        if self.kind == BPE and size.max(initial=0) > _LONG:  # cut between characters that no piece has side by side
            cut = np.ones(len(flat), bool)
            cut[1:] = ~np.isin(flat[:-1].astype(np.uint64) << np.uint64(32) | flat[1:], self.beside)
            long_ = size > _LONG
            keep = np.repeat(~long_, size)
            cut[keep] = False
            cut[start[size > 0]] = True
            owner = np.repeat(owner, size)[cut]
            start = np.flatnonzero(cut)
            size = np.diff(np.append(start, len(flat)))
        counts, parts = np.zeros(len(size), np.int64), []
        order = np.argsort(size, kind="stable")
        lengths = size[order]
        lo = int(np.searchsorted(lengths, 1))
        while lo < len(order):
            # Long words advance with those of up to a quarter more, padded: what comes later changes no prefix.
            n = int(lengths[lo]) if lengths[lo] <= _LONG else int(lengths[lo]) * 5 // 4
            hi = min(int(np.searchsorted(lengths, n, side="right")), lo + max(1, _CELLS // n))
            rows, n = order[lo:hi], int(lengths[hi - 1])
            codes = flat[np.minimum(start[rows][:, None] + np.arange(n), len(flat) - 1)]
            parts.append((rows, *self._ids(codes, size[rows])))
            counts[rows] = parts[-1][2]
            lo = hi
        offset = np.cumsum(counts) - counts
        ids = np.zeros(counts.sum(), np.int32)
        for rows, got, n in parts:
            ids[_spread(offset[rows], n)] = got
        per_word = np.bincount(owner, counts, minlength=len(words)).astype(np.int64)
        return ids, per_word

    def _ids(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, row after row, and each row's number of them; a row's word has ``sizes`` of its characters."""
        last, back = self._advance(codes)
        n, size = codes.shape
        used = np.zeros((n, size + 1), bool)
        at = sizes.copy()
        live = np.arange(n)
        while len(live):
            used[live, at[live]] = True
            at[live] -= back[live, at[live]]
            live = live[at[live] > 0]
        row, end = np.nonzero(used)
        piece = last[row, end]
        known = piece != _OUT
        ids = np.where(known, self.piece_ids[np.where(known, piece, 0)], self.unknown)
        n_ids = np.ones(len(row), np.int64)
        if self.falls_back and not known.all():
            strange = np.flatnonzero(~known)
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[row[strange], end[strange] - 1].tolist()]
            n_ids[strange] = [len(x) for x in raw]
            out = np.repeat(ids, n_ids)
            out[_spread((np.cumsum(n_ids) - n_ids)[strange], n_ids[strange])] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
            ids = out
        return ids, np.bincount(row, n_ids, minlength=n).astype(np.int64)

    _cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of the texts in it (one more than texts)."""
        if self.memo_used > MEMO:
            self._forget()
        old, number, space = len(self.memo), self.memo.__getitem__, SPACE
        places, per_text, long_ = [], np.zeros(len(texts), np.int64), _Numbers()
        for i, text in enumerate(texts):
            if text:
                words = self._cut.findall(self.prefix + text.replace(" ", space))
                per_text[i] = len(words)
                places.extend([number(w) if len(w) <= _LONG else ~long_[w] for w in words])
        if len(self.memo) > old:
            self._remember(*self._words(list(islice(self.memo, old, None))))
        place = np.array(places, np.int64)
        known = place >= 0
        own_ids, own_n = self._words(list(long_))
        own_ends = np.concatenate(([0], np.cumsum(own_n)))
        # Words of this call only stand behind the remembered ones.
        at = np.where(known, place, 0)
        start, end = self.memo_ends[at], self.memo_ends[at + 1]
        late = ~place[~known]
        start[~known], end[~known] = self.memo_used + own_ends[late], self.memo_used + own_ends[late + 1]
        n = end - start
        ids = np.concatenate((self.memo_ids[: self.memo_used], own_ids)) if len(own_ids) else self.memo_ids
        out = ids[_spread(start, n)]
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(per_text)))]
        return out, ends

    def decode(self, ids) -> str:
        """Text of a list of ids; a null list gives the empty text."""
        ids = np.asarray([] if ids is None else ids, np.int64)
        raw = b"".join([self.texts[i] for i in ids.tolist()])
        spoken = ids[~self.silent[ids]]
        if self.prefix and len(spoken) and self.spaced[spoken[0]]:
            raw = raw[1:]
        return raw.decode("utf-8", "each-byte-replaced")


#: Texts are encoded in groups of about so many code points, which bounds a task's memory.
GROUP = 4_000_000


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids, n_tokens, round_trip)`` a row; round_trip: decoding gives the text again."""
    rows = need(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _groups(texts):
                ids, ends = pieces.encode(texts[lo:hi])
                same = [pieces.decode(ids[a:b]) == (t or "").replace(SPACE, " ") for t, a, b in zip(texts[lo:hi], ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(ends), pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` from rows with ``doc_id`` and ``ids``."""
    rows = need(encoded, "doc_id", "ids")
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents``, with a digest of them and the round trip."""
    found = encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_tokens", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "round_trip", "ids")
