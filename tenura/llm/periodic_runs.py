"""Periodic runs of words: maximal stretches that repeat with a smallest period, found in linear time.

Words are compared as letters of an ordered alphabet, after the method of Ellert and Fischer. For an order of the
letters and its reverse, one pass from left to right keeps a stack of suffixes, each the nearest smaller one before the
next, with their longest common extensions. A new suffix meets the stack's top: suffixes that are larger are taken off,
and the new one is the next smaller suffix of each of them. So the longest Lyndon word at every position is known, and
how far the text after it repeats it. Two things spare comparisons: the extensions kept on the stack decide most
meetings, and within the stretch that an earlier match has covered, a meeting has the extension of its copy; letters are
compared only beyond the farthest position matched so far. Each run has such a Lyndon word as a root, in one of the
orders; its extension to the left is at most a period long, as only the leftmost root of a chain is followed.

No suffix array or tree is made and nothing is hashed. A word that occurs once in a text lies in no run, so the pass goes
over the stretches between such words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, map_arrow, table

#: A run is at least so many words long, and twice its period.
LEAST = 12
Run = tuple[int, int, int]


def repeats(x: list[int]) -> dict[int, tuple[int, int]]:
    """Of letters x[:-1] (x[-1] is smaller than all): position -> (next smaller suffix, their common extension), where that extension is not 0."""
    n = len(x) - 1
    found: dict[int, tuple[int, int]] = {}  # of suffixes taken off the stack
    under: dict[int, tuple[int, int]] = {}  # position -> (nearest smaller suffix before it, their common extension), if not 0
    stack, shared = [-1], [0]  # x[-1] is below every letter, so the stack never runs empty; shared: with the one below
    begin = reach = shift = 0  # x[begin:reach] was matched with the same stretch `shift` before it
    for i in range(n):
        c = 0  # what the suffixes at i and at the stack's top share, so far as known
        while True:
            top = stack[-1]
            a, b = x[top + c], x[i + c]
            if a == b:
                if top >= begin and i < reach:
                    other, left = i - shift, top - shift
                    at, e = found.get(left, (-1, 0))
                    if at != other:
                        at, e = under.get(other, (-1, -1))
                        e = e if at == left else -1
                    most = reach - i
                    c = most if e >= most else max(c, e)
                    done = e >= 0 and e != most
                else:
                    done = False
                if not done:
                    while x[top + c] == x[i + c]:
                        c += 1
                    if i + c > reach:
                        begin, reach, shift = i, i + c, i - top
                a, b = x[top + c], x[i + c]
            if a < b:
                break
            stack.pop()
            h = shared.pop()
            if c:
                found[top] = (i, c)
            while h > c:  # the next one agrees with the last one beyond their difference from i: larger as well
                top = stack.pop()
                h = shared.pop()
                if c:
                    found[top] = (i, c)
            if h < c:  # it differs from the last one before i does: smaller
                c = h
                break
        if c:
            under[i] = (stack[-1], c)
        stack.append(i)
        shared.append(c)
    return found


def letter_runs(letters: list[int], least: int = LEAST) -> set[Run]:
    """(start, length, period) of all runs of small non-negative integers."""
    out: set[Run] = set()
    top = max(letters, default=0)
    for x in (letters, [top - v for v in letters]):
        x = [*x, -1]
        found = repeats(x)
        for i, (j, right) in found.items():
            p = j - i
            before = found.get(i - p)
            if before and before[0] == i and before[1] >= p:
                continue  # not the leftmost root of its chain
            k = max(p - right, least - p - right, 0)  # what the extension to the left must be at least
            if k and (k > i or k >= p or x[i - 1] != x[j - 1] or x[i - k] != x[j - k] or x[i - k : i] != x[j - k : j]):
                continue
            while k < i and x[i - k - 1] == x[j - k - 1]:
                k += 1
            out.add((i - k, k + p + right, p))
    return out


def word_runs(words: list[bytes], least: int = LEAST) -> list[Run]:
    """(start, length, period) of the runs of `words` of max(least, 2 periods) words or more, by start, then period."""
    counted = Counter(words)
    if len(counted) == len(words):
        return []
    rank = {w: k for k, w in enumerate(sorted(w for w, n in counted.items() if n > 1))}
    ranks = [rank.get(w, -1) for w in words]
    out: list[Run] = []
    begin = 0
    while begin < len(ranks):
        try:
            end = ranks.index(-1, begin)
        except ValueError:
            end = len(ranks)
        if end - begin >= least:
            out += [(begin + s, n, p) for s, n, p in letter_runs(ranks[begin:end], least)]
        begin = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """`words` without those that any run holds after its first period."""
    kept, at = [], 0
    for begin, end in sorted((s + p, s + n) for s, n, p in runs):
        if begin > at:
            kept += words[at:begin]
        at = max(at, end)
    return kept + words[at:] if runs else words


def periodic_runs(docs: DataFrame, least: int = LEAST, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed): every run of words of each whole text, and the text without repeats, in the order of `docs`.

    `runs` is an array of (start, length, period), numbers of words from 0, by start, then period; `collapsed` has the
    words left, joined by one blank. `rewrite` may change the words of a text, by its id, before they are looked at.
    Null and empty texts have no runs and an empty `collapsed`. Each row stands for itself: a null id stays null, rows that
    repeat an id come back one by one, and an empty table gives an empty result. Only the two columns named are read, so
    others may have any name. A text is worked on as a whole, in memory that grows with its words; its time is linear,
    but for the last extension to the left of a root that repeats: at most a period each.
    """
    name = "id" if id_col == text_col else id_col

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, 1_000_000):
                runs, rest = [], []
                for i, t in zip(batch.column(0).slice(a, b - a).to_pylist(), texts[a:b], strict=True):
                    words = t.encode().split() if t else []
                    words = rewrite(i, words) if rewrite else words
                    found = word_runs(words, least)
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    rest.append(b" ".join(collapsed(words, found)).decode())
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(runs, kind), pa.array(rest, pa.string())], ["id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_arrow(rows, work, f"id {dict(rows.dtypes)['id']}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", name)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract: of a tenth of the ids, by crc32, the tail repeats a piece of the text; a null id has none."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `documents`: its runs counted, the longest of them, and digests of all runs and of what is left."""
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.s"), F.col("best.n"), -F.col("best.p")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
