"""Secret scans: three fixed patterns, and a character convolutional network over every candidate.

A candidate is each match of a fixed pattern and each run of 16 or more characters of keys (`RUN`) but those that lie
within such a match. The network (char_cnn.py) scores every candidate within its surroundings. Matches of the fixed
patterns are findings whatever their score; runs are findings of kind `model` if their calibrated score reaches the
threshold that keeps the wanted recall on labelled findings, so a key that a fixed pattern finds only a part of is
found whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .char_cnn import CharCnn, default_cnn, windows
from .common import map_arrow, table, texts_of

#: The patterns of the contract.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; `runs` are the text's matches of RUN.

    A run of hex digits or of an access id is matched whole, so its length may stand in the pattern, and a hex match
    lies within a match of RUN; an assigned value is judged after matching.
    """
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if ":" in text or "=" in text else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for a, b in runs if b - a >= 24 for m in HEX.finditer(text, a, b)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """All candidates (start, kind, end): the fixed patterns' matches, then runs that are not within one of them."""
    runs = [m.span() for m in RUN.finditer(text)]
    base = base_spans(text, runs)
    rest, reach, k = [], 0, 0
    for a, b in runs:  # one sweep: the furthest end of the matches that begin no later than the run
        while k < len(base) and base[k][0] <= a:
            reach, k = max(reach, base[k][2]), k + 1
        if reach < b:
            rest.append((a, 3, b))
    return base + rest


def scan_batch(texts: list[str], net: CharCnn, block: int = 4096) -> list[list[tuple[int, int, int, float]]]:
    """Per text, its findings (start, kind, end, score), by start, then kind."""
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    held: list[tuple[int, tuple[int, int, int]]] = []
    rows: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if not rows:
            return
        best = np.zeros(len(held))
        np.maximum.at(best, np.array(owner), net.score(np.stack(rows)))
        for (i, (a, kind, b)), s in zip(held, best.tolist(), strict=True):
            if kind < 3 or s >= net.threshold:
                found[i].append((a, kind, b, s))
        held.clear(), rows.clear(), owner.clear()

    for i, x in enumerate(texts):
        for span in candidates(x):
            seen = windows(x, span[0], span[2])
            owner += [len(held)] * len(seen)
            held.append((i, span))
            rows += seen
            if len(rows) >= block:
                flush()
    flush()
    return [sorted(f) for f in found]


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, net: CharCnn | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>) for every row: starts and ends in code points, end exclusive.

    Spans come by start, then by kind in the order of KINDS. A null text is scanned as an empty one (no spans); repeated
    rows and ids are scanned one by one; whole texts are read, however long; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    net = net or default_cnn()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": e, "score": s} for a, k, e, s in f] for f in scan_batch(texts_of(b), net)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, spans array<struct<kind string, start int, end int, score double>>")


def redact(docs: DataFrame, net: CharCnn | None = None) -> DataFrame:
    """`docs` with each finding (overlapping ones together) replaced by [SECRET] in `text`; `n_chars` follows.

    Every other column and every row stays; a null text stays null.
    """
    net = net or default_cnn()
    schema = docs.schema
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            lengths = b.column(size).to_pylist() if size is not None else []
            for i, f in enumerate(scan_batch([x or "" for x in texts], net)):
                if f:
                    parts, end = [], 0
                    for a, _, e, _ in f:
                        if a >= end:
                            parts += [texts[i][end:a], "[SECRET]"]
                        end = max(end, e)
                    texts[i] = "".join(parts) + texts[i][end:]
                    if lengths:
                        lengths[i] = len(texts[i])
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if size is not None:
                cols[size] = pa.array(lengths, b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return map_arrow(docs, run, schema)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    by_kind = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(spans, lambda s: s["kind"] != "model")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(F.size(by_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, one), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, one), ",").alias("spans"),
        F.size(by_kind("model")).cast("long").alias("n_model"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
