"""Byte-level BPE encoding and decoding, and exact token counts with a whole-token shortcut.

The tokenizer files are read by every worker from a path, which is a parameter; they are public, of fixed size, and the
same on every machine.  Encodings of distinct words are kept in a bounded table per worker.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PairTable, merge_all
from .common import map_texts
from .hashing import IS_SPACE, Batch, ranges_hash

#: Distinct segments (32 bytes each) and ids (4 bytes) that a worker keeps; beyond that the store starts anew.
CACHE_SEGMENTS, CACHE_IDS = 800_000, 8_000_000


# --- byte-level BPE -------------------------------------------------------------------------------------------------


class ByteBpe:
    """A byte-level BPE by ranks.  `encode_words` encodes pre-tokens, each by itself."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], i, i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).T.reshape(4, -1))

    @classmethod
    @functools.cache
    def load(cls, path: str) -> "ByteBpe":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        whole = [self.ranks.get(w, -1) for w in words]
        out = list(np.array(whole, np.int32).reshape(-1, 1))
        rest = [k for k, i in enumerate(whole) if i < 0]
        if rest:
            sizes = [len(words[k]) for k in rest]
            flat = self.single[np.frombuffer(b"".join(words[k] for k in rest), np.uint8)]
            for k, ids in zip(rest, merge_all(flat, sizes, self.pairs)):
                out[k] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class SegmentStore:
    """Encodings of distinct text segments in a worker, by 128-bit hashes; the ids are in one flat array.

    Sorted keys are kept in a large level and a small one that is merged into it now and then.  A segment whose first 64
    bits equal another's but not the second 64 is encoded anew each time.  Bounded in segments and in ids.
    """

    def __init__(self, most: int = CACHE_SEGMENTS, most_ids: int = CACHE_IDS):
        self.most, self.most_ids = most, most_ids
        self.clear()

    def clear(self) -> None:
        empty = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        self.levels = [empty, empty]  # (first hash, second hash, place) by first hash
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def __len__(self) -> int:
        return sum(len(keys) for keys, _, _ in self.levels)

    def _append(self, ids: list[np.ndarray]) -> np.ndarray:
        """Put ids at the end of the flat array: (start, size) of each."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        start, total = self.used + np.cumsum(sizes) - sizes, int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.int32)])
        if total:
            self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.used += total
        return np.column_stack([start, sizes])

    def _insert(self, keys: np.ndarray, second: np.ndarray, place: np.ndarray) -> None:
        large, small = self.levels
        parts = [small, (keys, second, place)]
        merge = (len(small[0]) + len(keys)) * 4 > len(large[0])
        joined = [np.concatenate(x) for x in zip(*([large] if merge else []), *parts)]
        order = np.argsort(joined[0], kind="stable")
        level = tuple(x[order] for x in joined)
        self.levels = [level, tuple(x[:0] for x in level)] if merge else [large, level]

    def encode(self, batch: Batch, start: np.ndarray, end: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offset): the ids of segment i are ids[offset[i]:offset[i + 1]].

        `encode` gets the bytes of the distinct segments that are not yet in the store.
        """
        one, two = ranges_hash(batch.buffer, start, end, both=True)
        keys, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        second = two[first]
        if len(self) > self.most or self.used > self.most_ids:
            self.clear()
        place, clash = np.full((len(keys), 2), -1), np.zeros(len(keys), bool)
        for have, have_second, have_place in self.levels:
            at = np.searchsorted(have, keys)
            hit = np.flatnonzero(at < len(have))
            hit = hit[have[at[hit]] == keys[hit]]
            same = have_second[at[hit]] == second[hit]
            place[hit[same]] = have_place[at[hit[same]]]
            clash[hit[~same]] = True
        raw = batch.buffer.tobytes()
        cut = lambda some: [raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())]
        new = np.flatnonzero(place[:, 1] < 0)
        if len(new):
            place[new] = self._append(encode(cut(first[new])))
            fresh = new[~clash[new]]
            self._insert(keys[fresh], second[fresh], place[fresh])
        place = place[inverse]
        wrong = np.flatnonzero(two != second[inverse])
        if len(wrong):
            place[wrong] = self._append(encode(cut(wrong)))
        offset = np.concatenate([[0], np.cumsum(place[:, 1])])
        index = np.repeat(place[:, 0] - offset[:-1], place[:, 1]) + np.arange(offset[-1])
        return self.flat[index], offset


@functools.cache
def store(path: str) -> SegmentStore:
    return SegmentStore()


def pattern_segments(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of segments at whose edges a GPT-style pattern always cuts, in order.

    A word is a run of bytes that are not ASCII white space, with one space before it if there is one.  Of a run of white
    space before a word the last character is the word's own if it is a space and else stands alone, the others are one
    segment; a run at the end of a text is one segment.  Texts with other white space must not be passed.
    """
    last = np.zeros(len(batch.buffer) + 1, bool)
    last[batch.offset[1:] - 1] = True
    last[-1] = True
    white = np.append(IS_SPACE[batch.buffer], True)
    run = white & ~last
    a = np.flatnonzero(run & ~np.concatenate([[False], run[:-1]]))
    b = np.flatnonzero(~run & np.concatenate([[False], run[:-1]]))
    word = ~white
    s = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    e = np.flatnonzero(~word & np.concatenate([[False], word[:-1]]))
    before = np.zeros(len(s), bool)
    inner = s > 0
    before[inner] = (batch.buffer[s[inner] - 1] == 0x20) & ~last[s[inner] - 1]
    ends_text = last[b]
    own = ~ends_text & (batch.buffer[b - 1] == 0x20)
    alone = ~ends_text & ~own
    stop = np.where(ends_text, b, b - 1)
    full = stop > a
    start = np.concatenate([s - before, a[full], b[alone] - 1])
    end = np.concatenate([e, stop[full], b[alone]])
    order = np.argsort(start, kind="stable")
    return start[order], end[order]


#: White space beyond ASCII's, and the separators that some libraries count as white space.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def encode_texts(texts: list[str | None], bpe: ByteBpe, pattern: str, segments: SegmentStore) -> list[np.ndarray]:
    """Ids of each text: every match of the pattern is encoded by itself."""
    split = regex.compile(pattern).findall
    odd = [bool(t) and OTHER_SPACE.search(t) is not None for t in texts]
    batch = Batch.of("" if o else t for t, o in zip(texts, odd))

    def encode(some: list[bytes]) -> list[np.ndarray]:
        words = [split(x.decode("utf-8", "surrogatepass")) for x in some]
        known = {w: k for k, w in enumerate(set().union(*words))}
        ids = bpe.encode_words([w.encode("utf-8", "surrogatepass") for w in known])
        return [ids[known[w[0]]] if len(w) == 1 else np.concatenate([ids[known[x]] for x in w]) for w in words]

    start, end = pattern_segments(batch)
    ids, offset = segments.encode(batch, start, end, encode)
    edge = offset[np.searchsorted(start, batch.offset)]
    out = [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    for k in np.flatnonzero(odd):
        out[k] = np.concatenate(bpe.encode_words([w.encode("utf-8", "surrogatepass") for w in split(texts[k])]))
    return out


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with `with_ids`) of each text.

    Null texts count as empty: no tokens and the digests of nothing.  Special tokens get no special handling.  Repeated
    rows are all returned; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded binary" if with_ids else "")

    def encode(texts, batch):
        bpe = ByteBpe.load(path)
        found = encode_texts(texts, bpe, pattern, store(path))
        ids = [i.astype("<u4").tobytes() for i in found]
        decoded = [bpe.decode(i) for i in found]
        out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(i) for i in found], pa.int64())}
        out |= {"ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())}
        return out | ({"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.binary())} if with_ids else {})

    return map_texts(rows, "text", schema, encode)


# --- token counts ---------------------------------------------------------------------------------------------------


class PieceBpe:
    """A BPE over characters with byte fallback, in which a space is the letter U+2581 and texts get one in front."""

    SPACE = "▁"

    def __init__(self, pieces: list[str], scores: list[float], usable: list[bool]):
        kept = [(p, -s, i) for i, (p, s, u) in enumerate(zip(pieces, scores, usable)) if u]
        self.id_of = {p: i for p, _, i in kept}
        order = {v: r for r, v in enumerate(sorted({r for _, r, _ in kept}))}
        pairs = [(self.id_of[p[:k]], self.id_of[p[k:]], order[r], i) for p, r, i in kept for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
        self.pairs = PairTable(*np.array(pairs, np.int64).T.reshape(4, -1))
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i

    @classmethod
    @functools.cache
    def load(cls, path: str) -> "PieceBpe":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in n]
        return cls([model.id_to_piece(i) for i in n], [model.get_score(i) for i in n], [not s for s in special])

    def merge_counts(self, words: list[str]) -> list[int]:
        """Tokens of each word by merging; a character outside the vocabulary is one token for each UTF-8 byte."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat, sizes = self.char_ids[code], np.array([len(w) for w in words], np.int64)
        out = np.array([len(m) for m in merge_all(flat, sizes, self.pairs)], np.int64)
        unknown = np.where(flat < 0, (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF), 0)
        return (out + np.bincount(np.repeat(np.arange(len(words)), sizes), unknown, minlength=len(words))).astype(np.int64).tolist()

    @functools.cached_property
    def whole_tokens(self) -> frozenset[str]:
        """The offline proof: the vocabulary strings that the merges turn into exactly one token."""
        pieces = list(self.id_of)
        return frozenset(p for p, n in zip(pieces, self.merge_counts(pieces)) if n == 1)

    @functools.cached_property
    def breaks(self) -> np.ndarray:
        """Bytes at which a text can be cut: ASCII control characters that no piece of the vocabulary contains."""
        inside = set().union(*self.id_of)
        return np.array([b < 32 and chr(b) not in inside for b in range(256)])

    def check_spaces(self) -> None:
        """Cutting before a run of spaces is exact only if no piece has a space after another character."""
        if any(self.SPACE in p.lstrip(self.SPACE) for p in self.id_of):
            raise ValueError("the vocabulary has pieces that run over a space")

    def count(self, texts: list[str | None], segments: SegmentStore, whole: frozenset[str]) -> np.ndarray:
        """Tokens of each text.  Pre-tokens are a run of spaces with what follows it, between breaks; those in `whole` are one."""
        texts = [" " + t.replace(self.SPACE, " ") if t else "" for t in texts]
        batch = Batch.of(texts)
        stop = self.breaks[batch.buffer]
        last = batch.offset[1:] - 1
        stop[last] = True  # the separator after each text
        space = (batch.buffer == 0x20) & ~stop
        cut = np.ones(len(stop), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | stop[:-1]
        start = np.flatnonzero(cut & ~stop)
        edge = np.flatnonzero(cut | stop)
        end = np.append(edge, len(stop))[np.searchsorted(edge, start, side="right")]

        def encode(some: list[bytes]) -> list[np.ndarray]:
            words = [x.decode("utf-8", "surrogatepass").replace(" ", self.SPACE) for x in some]
            counts = np.ones((len(words), 1), np.int32)
            rest = [k for k, w in enumerate(words) if w not in whole]
            counts[rest, 0] = self.merge_counts([words[k] for k in rest])
            return list(counts)

        counts, _ = segments.encode(batch, start, end, encode)
        text = np.searchsorted(batch.offset, start, side="right") - 1
        total = np.bincount(text, counts, minlength=len(texts)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(stop)])
        return total + cuts[batch.offset[1:]] - cuts[batch.offset[:-1]] - 1


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each text.

    Null texts count as empty: 0 bytes, 0 tokens.  No begin or end tokens, no truncation; strings of special tokens are
    ordinary text.  Repeated rows are all returned; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    PieceBpe.load(path).check_spaces()
    proved = docs.sparkSession.sparkContext.broadcast(PieceBpe.load(path).whole_tokens)  # at most the vocabulary

    def count(texts, batch):
        tokens = PieceBpe.load(path).count(texts, store(path), proved.value)
        sizes = np.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], np.int64)
        return {"doc_id": batch.column("doc_id"), "n_bytes": sizes, "n_tokens": tokens, "over_limit": tokens > limit}

    return map_texts(rows, "text", "doc_id long, n_bytes long, n_tokens long, over_limit boolean", count)
