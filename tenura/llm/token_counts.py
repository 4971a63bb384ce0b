"""Token counts under a byte-level BPE vocabulary by rank-synchronous array merging.

Pre-tokens of a batch that have not been met lately are held as one ragged numpy array of symbol ids. In each round
every sequence finds its lowest-ranked adjacent pair and all sequences apply theirs at once; a sequence leaves when no
pair of it has a rank. What survives of each pre-token is its token count, which documents add up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, map_arrow, table, texts_of

NONE = np.int64(1 << 40)

#: Texts of these characters only are split by the standard engine, whose classes agree there with the Unicode ones.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(rf"[\t-\r -~¡¿§«»°·–—‘’“”„…{LATIN[6:]}]*")
#: The split of byte-level BPE for `PLAIN` texts; fixed by the vocabulary.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class RankMerger:
    """Counts the tokens of many pre-tokens at once. `spec` is the parsed tokenizer file."""

    def __init__(self, spec: dict, pattern: str, cache: int = 800_000):
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.unit = np.array([vocab[s] for _, s in sorted(byte_symbols().items())], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.general = regex.compile(pattern).findall
        self.plain = re.compile(PLAIN_SPLIT).findall if pattern == BYTE_LEVEL else None
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.cache: dict[str, int] = {}
        self.most = cache

    def find(self, text: str) -> list[str]:
        return self.plain(text) if self.plain and PLAIN.fullmatch(text) else self.general(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each (non-empty) byte sequence."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = self.unit[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), size)
        out = size.copy()
        rank = np.full(len(ids), NONE)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.r_[starts, len(ids)])
            live = low < NONE
            if not live.all():
                keep = np.repeat(live, spans)
                ids, seq, rank = ids[keep], seq[keep], rank[keep]
                low, spans = low[live], spans[live]
                if not len(ids):
                    break
            hit = rank == np.repeat(low, spans)
            at = np.flatnonzero(hit)
            # equal neighbours (aaa) overlap: of each run of hits take the first, third, ...
            run = np.r_[True, np.diff(at) > 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            out -= np.bincount(seq[at], minlength=len(out))
            fresh = np.zeros(len(ids), bool)
            fresh[at] = True
            fresh[at[at > 0] - 1] = True
            ids, seq, rank, fresh = ids[keep], seq[keep], rank[keep], fresh[keep]
            # a kept symbol before a merged one may itself follow a removed one
            fresh[:-1] |= fresh[1:] & (seq[1:] == seq[:-1])
            todo = np.flatnonzero(fresh)
            nxt = np.minimum(todo + 1, len(ids) - 1)
            same = (nxt > todo) & (seq[nxt] == seq[todo])
            rank[todo] = NONE
            rank[todo[same]] = self.rank(ids[todo[same]], ids[nxt[same]])
        return out

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in chunks(texts):
            split, extra = [], []
            for x in texts[a:b]:
                if self.split is not None and any(s in x for s in self.specials):
                    parts = self.split.split(x)
                    split.append(list(chain.from_iterable(map(self.find, parts))))
                    extra.append(len(parts) - 1)
                else:
                    split.append(self.find(x))
                    extra.append(0)
            if len(self.cache) > self.most:
                self.cache.clear()
            new = [t for t in set(chain.from_iterable(split)) if t not in self.cache]
            if new:
                self.cache.update(zip(new, self.lengths([t.encode() for t in new]).tolist(), strict=True))
            get = self.cache.__getitem__
            out += [sum(map(get, s)) + e for s, e in zip(split, extra, strict=True)]
        return out


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=2)
def merger(path: str, pattern: str) -> RankMerger:
    """One for each Python worker, so that what it has counted serves the next partition."""
    return RankMerger(load_spec(path), pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds up tokens per text: (doc_id, n_bytes, n_tokens, over_limit).

    The tokens are those of the library for the tokenizer file at `path` (byte-level BPE, no normaliser), without added
    begin or end tokens, padding or truncation; special strings inside a text count as one token each. `path` is read
    by each Python worker, as an installed file of every machine. A null text counts as empty (0 bytes, 0 tokens);
    repeated rows and ids are counted one by one; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(merger(path, pattern).counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN)
