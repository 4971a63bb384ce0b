"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut into words: before white space marks, and around characters that no longer piece holds, so that no piece
can cross a cut. Of the words that a worker has not met lately, all substrings up to the longest piece are looked up in
the piece table by their 64-bit hashes, which gives each word's lattice: an array of edges by (start, length). Then all
words are folded together, each by its best edge in each round, and documents take the segmentations of their words.
All of this is numpy within one mapInArrow; there is no join and nothing is shuffled.

The fold replays merges: the best-scored edge that spans two neighbouring segments joins them, the leftmost of equals,
until none is left. That is what a piece table of kind BPE stands for; a Viterbi fold (the path with the largest sum of
scores) gives other pieces than the library does for such a table. Models of kind unigram are folded by Viterbi, whole
texts at a time; models that are neither, or that normalise texts, are refused. The README has figures of the relational
form, a join of exploded substrings with a higher-order aggregate, and of Viterbi over a BPE table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, map_arrow, table

MARK = "▁"
#: Words of more characters are merged one by one with a heap.
LONG = 64
#: Words whose segmentations a worker remembers before it starts anew.
HELD = 250_000
#: Characters of new words whose lattice is held at once, 16 edges of 4 bytes each.
BLOCK = 200_000
NONE = np.int32(1 << 30)
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash by which most substrings are told to be no piece.
TOP_BITS = 18


def fields(message: bytes) -> dict[int, list]:
    """The values of a protocol-buffer message by field number: whole numbers, bytes, and 4 or 8 raw bytes."""
    out: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            found: int | bytes = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            found = message[at : at + size]
            at += size
        out.setdefault(key >> 3, []).append(found)
    return out


def kind_of(path: str) -> str:
    """`unigram` or `bpe`, for models whose texts are only cut at white space; an error for all others, whose ids this module would get wrong."""
    with open(path, "rb") as f:
        model = fields(f.read())
    # fixed values: field numbers and defaults of the model format
    train, norm = (fields(b"".join(model.get(n, []))) for n in (2, 3))
    last = lambda part, number, default: part.get(number, [default])[-1]
    kind = {1: "unigram", 2: "bpe"}.get(last(train, 3, 1))
    needs = {
        "a model of kind unigram or BPE": kind is not None,
        "byte fallback": last(train, 35, 0) == 1,
        "no normalisation": not last(norm, 2, b""),
        "a mark before each text": last(norm, 3, 1) == 1 and last(train, 24, 0) == 0,
        "white space kept as it is": last(norm, 4, 1) == 0 and last(norm, 5, 1) == 1,
        "no pieces of users": all(last(fields(p), 3, 1) != 4 for p in model.get(1, [])),
    }
    missing = [what for what, there in needs.items() if not there]
    if missing:
        raise ValueError(f"{path}: encoding needs {', '.join(missing)}")
    return kind


class Pieces:
    """The piece table of a model file: pieces with ids and scores; ids of byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.kind = kind_of(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.names) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.known: dict[str, bytes] = {}
        self.raw = [p.encode() for p in self.names]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        # rank 0 is the best score; equal scores share a rank
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = {self.names[i]: place[model.get_score(i)] for i in plain}
        self.longest = max(map(len, self.ids), default=1)
        self.score = np.array([model.get_score(i) for i in range(n)], np.float32)
        #: What a character costs that is no piece, after the format: 10 below the least score.
        self.lost = np.float32(min((model.get_score(i) for i in plain), default=0.0)) - np.float32(10)
        marks = any(MARK in p.lstrip(MARK) for p in self.ids)
        if marks:
            raise ValueError("pieces that hold white space after other characters are not handled")
        joined = sorted({c for p in self.ids if len(p) > 1 for c in p} - {MARK})
        inner = "".join(map(re.escape, joined))
        self.word = re.compile(f"{MARK}+[{inner}]*|[{inner}]+|(?s:.)")
        by_length: dict[int, list[tuple[int, int]]] = {}
        for p in self.ids:
            if p:
                by_length.setdefault(len(p), []).append((int(hashes([p], len(p))[0]), self.ids[p]))
        self.rank_of = np.full(n + 1, NONE, np.int32)  # by id; the last is for no piece
        for p, i in self.ids.items():
            self.rank_of[i] = self.rank[p]
        #: By length: hashes in order, ids, and which values of a hash's top bits occur at all.
        self.tables = {}
        for length, rows in by_length.items():
            rows.sort()
            keys = np.array([h for h, _ in rows], np.uint64)
            seen = np.zeros(1 << TOP_BITS, bool)
            seen[keys >> np.uint64(64 - TOP_BITS)] = True
            self.tables[length] = (keys, np.array([i for _, i in rows], np.int32), seen)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.bytes.values())] = True
        self.digits = [str(i).encode() for i in range(n)]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return self.word.findall(MARK + text.replace(" ", MARK))

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes of words, edges): edges[i, length - 1] is the id of the piece that starts at character i of all words' characters, -1 for none."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size).repeat(size)
        edges = np.full((len(code), self.longest), -1, np.int32)
        live = np.arange(len(code))
        h = code * PRIME
        for length in range(1, self.longest + 1):
            if length > 1:
                live = live[live + length <= end[live]]
                h[live] = (h[live] + code[live + length - 1]) * PRIME
            if not len(live):
                break
            if length in self.tables:
                keys, ids, top = self.tables[length]
                likely = live[top[h[live] >> np.uint64(64 - TOP_BITS)]]  # few substrings are pieces
                seen = h[likely]
                k = np.minimum(np.searchsorted(keys, seen), len(keys) - 1)
                hit = keys[k] == seen
                edges[likely[hit], length - 1] = ids[k[hit]]
        return size, edges

    def fold(self, size: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, id) of the segments that merging leaves, in order; id -1 where a character is no piece."""
        start = np.arange(len(edges))
        end = start + 1
        word = np.repeat(np.arange(len(size)), size)
        alive = np.ones(len(edges), bool)  # of characters: whether a segment starts there
        stop = end.copy()  # by start of a segment
        at, to, own = start, end, word
        rank = np.full(len(at), NONE, np.int32)

        def ranks(i: np.ndarray) -> np.ndarray:
            """Of the segments at places i with their followers, all of the same word."""
            length = to[i + 1] - at[i]
            ok = length <= self.longest
            out = np.full(len(i), NONE, np.int32)
            out[ok] = self.rank_of[edges[at[i[ok]], length[ok] - 1]]
            return out

        pairs = np.flatnonzero(own[1:] == own[:-1])
        rank[pairs] = ranks(pairs)
        while len(at):
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            low = np.minimum.reduceat(rank, begin)
            span = np.diff(np.r_[begin, len(at)])
            go = low < NONE
            if not go.all():  # words without a merge are done
                keep = np.repeat(go, span)
                at, to, own, rank = at[keep], to[keep], own[keep], rank[keep]
                low, span = low[go], span[go]
                if not len(at):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, span))
            hits = hits[np.r_[True, own[hits[1:]] != own[hits[:-1]]]]  # the leftmost of each word
            alive[at[hits + 1]] = False
            to[hits] = to[hits + 1]
            stop[at[hits]] = to[hits]
            keep = np.ones(len(at), bool)
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            at, to, own, rank = at[keep], to[keep], own[keep], rank[keep]
            todo = place[hits]
            touched = np.zeros(len(at), bool)
            touched[todo] = True
            touched[todo[todo > 0] - 1] = True
            todo = np.flatnonzero(touched)
            rank[todo] = NONE
            todo = todo[todo + 1 < len(at)]
            todo = todo[own[todo] == own[todo + 1]]
            rank[todo] = ranks(todo)
        left = np.flatnonzero(alive)
        return word[left], left, edges[left, stop[left] - left - 1]

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of the pieces of each word, as packed 32-bit numbers."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        size, edges = self.lattice([words[i] for i in short])
        if len(short):
            word, start, ids = self.fold(size, edges)
            begin = np.searchsorted(word, np.arange(len(short) + 1))
            whole = np.minimum.reduceat(ids, begin[:-1]) >= 0
            flat, cut = ids.astype(np.int32).tobytes(), (4 * begin).tolist()
            bound = begin.tolist()
            first = (np.cumsum(size) - size).tolist()
            for k, (i, ok) in enumerate(zip(short, whole.tolist(), strict=True)):
                if ok:
                    out[i] = flat[cut[k] : cut[k + 1]]
                else:
                    bounds = [int(x) - first[k] for x in start[bound[k] : bound[k + 1]]] + [len(words[i])]
                    out[i] = packed(self.piece_ids(words[i], bounds))
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = packed(self.piece_ids(w, self.merge_long(w)))
        return out

    def best_path(self, words: list[str]) -> list[int]:
        """Ids of the path with the largest sum of scores through the lattice of a whole text.

        Sums are single-precision and run on from word to word, as the library's do: far into a text they are coarser, so
        a word's best path may depend on where it stands. Of equal paths the one with the longer last piece counts.
        """
        out: list[int] = []
        base = np.float32(0)
        for word in words:
            _, edges = self.lattice([word])
            n = len(word)
            best, came = [None] * (n + 1), [0] * (n + 1)
            best[0] = base
            for i in range(n):
                here = best[i]
                for length in np.flatnonzero(edges[i] >= 0).tolist():
                    to, sum_ = i + length + 1, here + self.score[edges[i, length]]
                    if best[to] is None or sum_ > best[to]:
                        best[to], came[to] = sum_, i
                if edges[i, 0] < 0 and (best[i + 1] is None or here + self.lost > best[i + 1]):
                    best[i + 1], came[i + 1] = here + self.lost, i
            bounds = [n]
            while bounds[-1]:
                bounds.append(came[bounds[-1]])
            out += self.piece_ids(word, bounds[::-1])
            base = best[n]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.kind == "unigram":
            return [np.array(self.best_path(self.words(x)), np.int32) for x in texts]
        split = [self.words(x) for x in texts]
        if len(self.known) > HELD:
            self.known.clear()
        new = [w for w in set(chain.from_iterable(split)) if w not in self.known]
        for i, j in chunks(new, BLOCK):
            self.known.update(zip(new[i:j], self.segment(new[i:j]), strict=True))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), np.int32) for s in split]

    def merge_long(self, word: str) -> list[int]:
        """Boundaries of a long word's segments, by a heap of candidate merges."""
        n = len(word)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        stop = list(range(1, n + 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and stop[j] - i <= self.longest and (r := self.rank.get(word[i : stop[j]])) is not None:
                heapq.heappush(heap, (r, i, stop[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or stop[after[i]] != e or stop[i] == e:
                continue
            j = after[i]
            stop[i], alive[j], after[i] = e, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in range(n) if alive[i]] + [n]

    def piece_ids(self, word: str, bounds: list[int]) -> list[int]:
        out: list[int] = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            i = self.ids.get(word[a:b])
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[x] for x in word[a:b].encode()]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace").replace(MARK, " ")[1:]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def hashes(words: list[str], length: int) -> np.ndarray:
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(words), length)
    h = code[:, 0] * PRIME
    for k in range(1, length):
        h = (h + code[:, k]) * PRIME
    return h


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each Python process."""
    return Pieces(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, n_bytes long) for every row: ids of the pieces, and how many of them are byte pieces.

    `path` is a SentencePiece model of kind BPE or unigram, with byte fallback and without normalisation (others are an
    error), read by each Python worker as an installed file.
    The ids are the library's, without begin or end. A null or empty text has no pieces; rows that repeat an id are
    encoded one by one; whole texts are encoded, however long; other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            for i, j in chunks(texts, 1_000_000):
                ids = p.encode(texts[i:j])
                n_bytes = [int(np.count_nonzero(p.is_byte[x])) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), ragged(ids), pa.array(n_bytes, pa.int64())], ["doc_id", "ids", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, ids array<int>, n_bytes long")


def ragged(rows: list[np.ndarray]) -> pa.ListArray:
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    values = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with piece ids: the exact text that `encode` was given, for texts without the mark itself (which comes back as a blank).

    Null ids give an empty text, null entries of a row are an error; rows that repeat an id are decoded one by one, however
    long; other columns play no role; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([p.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), run, "doc_id long, text string")


def digested(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, n_bytes, ids_sha256, text_sha256): of the ids, comma-joined, and of the text they decode to, for each row that `encode` gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for b in batches:
            column = b.column("ids")
            size = np.diff(column.offsets.to_numpy())
            flat, end = column.flatten().to_numpy().tolist(), np.cumsum(size).tolist()
            ids = [flat[e - n : e] for n, e in zip(size.tolist(), end, strict=True)]
            of_ids = [sha(b",".join(map(p.digits.__getitem__, x))) for x in ids]
            of_text = [sha(p.decode(x).encode()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size.astype(np.int64)), b.column("n_bytes"), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_pieces", "n_bytes", "ids_sha256", "text_sha256"])

    return map_arrow(encoded, run, "doc_id long, n_pieces long, n_bytes long, ids_sha256 string, text_sha256 string")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    return digested(encode(table(spark, sf_dir, "documents"), path), path)
