"""Runs of words against a plain search of every period, and the query against its contract."""

import hashlib
import random
import zlib

import pytest

from tenura.llm.periodic_runs import LEAST, collapsed, letter_runs, op13_periodic_runs, periodic_runs, repeats, word_runs


def plain(w, least=LEAST):
    out, n = {}, len(w)
    for p in range(1, n // 2 + 1):  # a stretch with a smaller period, too, was found before
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p) and (i, j + p) not in out:
                out[i, j + p] = p
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    s, t = [0], [0, 1]
    while len(t) < n:
        s, t = t, t + s
    return t[:n]


def test_runs_equal_a_plain_search():
    rnd = random.Random(8)
    for _ in range(1500):
        n, a = rnd.randint(0, 70), rnd.randint(1, 4)
        x = [rnd.randrange(a) for _ in range(n)] if rnd.random() < 0.5 else ([rnd.randrange(a) for _ in range(rnd.randint(1, 9))] * 70)[:n]
        for _ in range(rnd.randint(0, 3)):
            if x:
                x[rnd.randrange(n)] = rnd.randrange(a + 1)
        for least in (1, 5, 12):
            assert letter_runs(x, least) == set(plain(x, least))
        assert word_runs([b"%d" % v for v in x]) == plain(x)
    for x in (fibonacci(300), [0] * 200, [bin(i).count("1") & 1 for i in range(300)]):
        assert letter_runs(x) == set(plain(x))


class Counted(list):
    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return super().__getitem__(i)


@pytest.mark.parametrize("kind", ["one letter", "fibonacci", "powers", "falling powers", "pieces", "mountain"])
def test_letters_read_grow_with_the_text(kind):
    def made(n):
        if kind == "fibonacci":
            return fibonacci(n)
        if kind in ("powers", "falling powers"):  # (aab)^k b for many k: every meeting shares much
            ks = range(1, int((n / 1.5) ** 0.5))
            return [v for k in (ks if kind == "powers" else reversed(ks)) for v in [0, 0, 1] * k + [1]]
        if kind == "pieces":
            rnd = random.Random(2)
            return [v for _ in range(n // 20) for v in [0] * rnd.randint(1, 40) + [1]]
        return [0] * n if kind == "one letter" else [*range(n // 2), *range(n // 2, 0, -1)]

    for n in (2000, 20000):
        x = made(n)
        Counted.reads = 0
        repeats(Counted([*x, -1]))
        assert Counted.reads < 20 * len(x)


TEXTS = ["", None, " \t\n", "one", "A a " * 9, "a b c " * 4 + "d", "x " * 11, "x " * 12, "é ü é ü " * 7, "so it goes " * 5 + "and " + "on and " * 8, " ".join(f"w{i}" for i in range(3000)), "long" * 30_000, " ".join(["p", "q"] * 4000 + ["z"] + ["q"] * 50)]


def test_query_equals_its_contract(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS * 2)]
    rows += [(100 + i, " ".join(rnd.choice(["u", "v", "w", f"k{rnd.randrange(400)}"]) for _ in range(rnd.randint(1, 300))), None, "s", 0) for i in range(150)]
    rows += [(None, "m n " * 20, "en", "s", 0), (7, "r " * 30, "en", "s", 0), (7, "r " * 30, "en", "s", 0)]
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 8
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = op13_periodic_runs(spark, str(tmp_path))
    assert dict(df.dtypes) == dict.fromkeys(("doc_id", "n_runs", "start", "length", "period", "exponent_milli"), "bigint") | dict.fromkeys(("runs_sha256", "collapsed_sha256"), "string")
    want = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain(w) if n < 2000 else word_runs(w)  # the plain search is quadratic
        dropped = {k for s, m, p in runs for k in range(s + p, s + m)}
        s, m, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        rest = hashlib.sha256(b" ".join(v for k, v in enumerate(w) if k not in dropped)).hexdigest()
        want.append((i, len(runs), s, m, p, 1000 * m // p if runs else None, digest, rest))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def test_long_runs_of_a_long_text():
    w = [b"p", b"q"] * 4000 + [b"z"] + [b"q"] * 50
    assert word_runs(w) == [(0, 8000, 2), (8001, 50, 1)] and collapsed(w, word_runs(w)) == [b"p", b"q", b"z", b"q"]


def test_operator_gives_texts_whatever_the_columns(spark):
    df = spark.createDataFrame([("k", "a b " * 8, 1, 2), (None, None, 3, 4)], "name string, body string, runs int, collapsed int")
    rows = {r["name"]: r for r in periodic_runs(df, id_col="name", text_col="body").collect()}
    assert [tuple(r) for r in rows["k"]["runs"]] == [(0, 16, 2)] and rows["k"]["collapsed"] == "a b"
    assert rows[None]["runs"] == [] and rows[None]["collapsed"] == ""
    assert periodic_runs(df.limit(0), id_col="name", text_col="body").collect() == []
