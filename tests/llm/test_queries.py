"""Each registered opN query on a small set of whole tables, against plain versions of its contract."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tenura.llm import queries as registry
from tenura.llm.gam import fit_gam

P = pytest.importorskip("public_tokenizers")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rnd = random.Random(12)
    prose = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ed", "é"]) for _ in range(n))
    texts = {}
    for i in range(160):
        t = prose(rnd.randint(3, 90)) + "."
        if i % 6 == 5:
            t = rnd.choice(["JUNK!! ", "### ", "la la "]) * 40
        if i % 7 == 3:
            t += rnd.choice([" you idiot", " worthless scum and trash"])
        if i % 11 == 0:
            t += f' Password = "{"".join(rnd.choice("abcXYZ019/+") for _ in range(rnd.randint(4, 30)))}" ' + rnd.choice(["AKIA" + "Q7" * 9, "0f" * 14, "x" * 30])
        texts[i] = t
    for k in range(8):
        texts[200 + k] = texts[1 + k] if k % 2 else texts[1 + k] + " tail"
    texts |= {300: None, 301: "", 302: " \n", 303: "one", 304: "ONE", 305: prose(3000)}
    rows = [(i, t, rnd.choice(["en", None]), rnd.choice(["a", "b"]), len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 5), int(i % 7 == 3)) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(3)
    x = rng.normal(size=(420, 12)).astype(np.float32)
    x[7] = x[0]
    x[300] = 0
    vectors = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(450, None, 0), (500, [float("nan")] * 12, 0), (550, [None] * 12, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, texts, x


@pytest.fixture(scope="module")
def result(spark, tables):
    found = {}

    def get(name):
        if name not in found:
            df = registry.queries()[name](spark, tables[0])
            found[name] = (dict(df.dtypes), df.collect())
        return found[name]

    return get


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (t or "").encode()))


def test_op1(tables, result):
    kinds, rows = result("op1_secrets")
    assert [kinds[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")] == ["bigint"] * 4 + ["string"] * 2
    rules = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")]
    seen = 0
    for r in rows:
        t = tables[1][r["doc_id"]] or ""
        spans = [(m.start(), 0, m.end()) for m in rules[0].finditer(t) if len(m.group(2)) >= 6]
        spans += [(m.start(), 1, m.end()) for m in rules[1].finditer(t) if len(m.group()) >= 20]
        spans += [(m.start(), 2, m.end()) for m in rules[2].finditer(t) if len(m.group()) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("model")] == [s for s in text.split(",") if s]
        seen += len(spans)
    assert seen > 10 and len(rows) == len(tables[1])


def test_op2(tables, result):
    kinds, rows = result("op2_near_dup")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables[0]}/documents.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["op2_near_dup"]).fetchall()
    assert sorted(tuple(r) for r in rows) == sorted(want) and sum(not r["kept"] for r in rows) >= 9
    assert kinds == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}


def test_op3_and_op7(tables, result):
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
    lib = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    for r in result("op3_sentence_pieces")[1]:
        t = tables[1][r["doc_id"]] or ""
        ids = lib.encode(t)
        assert r["n_pieces"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    bpe = tokenizers.Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    kinds, rows = result("op7_token_counts")
    for r in rows:
        t = tables[1][r["doc_id"]] or ""
        n = len(bpe.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert kinds["over_limit"] == "boolean" and any(r["over_limit"] for r in rows) and len(rows) == len(tables[1])


def test_op4_and_op8(tables, result):
    x = tables[2].astype(np.float64)
    usable = [i for i in range(len(x)) if x[i].any()]
    u = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    hit = total = 0
    by = {}
    for r in result("op4_nearest")[1]:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(by) == {i for i in usable if i % 50 == 0}
    for q, got in by.items():
        s = {i: float(u[i] @ u[q]) for i in usable if i != q}
        want = sorted(s, key=lambda i: (-round(s[i], 12), i))[:5]
        assert sorted(got) == [1, 2, 3, 4, 5] and all(abs(v - s[i]) < 1e-12 for i, v in got.values())
        hit, total = hit + len(set(want) & {i for i, _ in got.values()}), total + 5
    assert hit >= 0.9 * total
    e = np.floor(1024 * x).astype(np.int64)
    got = sorted(tuple(r) for r in result("op8_exact_top_k")[1])
    want = []
    for q in range(0, len(x), 100):
        s = e @ e[q]
        best = sorted((-int(v), i) for i, v in enumerate(s) if i != q)[:10]
        want += [(q, k, i, -v) for k, (v, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_op5_keeps_by_its_probability(tables, result):
    rows = result("op5_mixing")[1]
    for r in rows:
        draw = int(hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13
        assert r["kept"] == (draw < r["probability"]) and r["n_tokens"] == len(words(tables[1][r["doc_id"]]))
    assert len(rows) == len(tables[1])


def test_op6(tables, result):
    kinds, rows = result("op6_lm_scoring")
    texts = tables[1]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c, ends = Counter(), 0
    for i, t in texts.items():
        if not held[i]:
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    for r in rows:
        w = words(texts[r["doc_id"]])
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    assert kinds["held_out"] == "boolean" and kinds["score"] == "double" and len(rows) == len(texts)


@pytest.mark.parametrize(("name", "mod", "out", "truth"), [("op9_quality", 5, 0, lambda i: i % 6 != 5), ("op10_toxicity", 4, 2, lambda i: i % 7 == 3)])
def test_op9_and_op10(tables, result, name, mod, out, truth):
    kinds, rows = result(name)
    assert [kinds[c] for c in ("doc_id", "held_out", "score", "predicted")] == ["bigint", "boolean", "double", "int"] and len(rows) == len(tables[1])
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == out) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 160]
    assert sum(r["predicted"] == truth(r["doc_id"]) for r in held) >= 0.9 * len(held)


def test_additive_model_is_a_walk_through_its_tables():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    m = fit_gam(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    one = np.array([m.score(x[i : i + 1])[0] for i in range(50)])
    assert np.array_equal(one, m.score(x)[:50])
