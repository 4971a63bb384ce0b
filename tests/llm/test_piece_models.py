"""Piece models of each kind, written by hand, against the library; models that would be encoded wrongly are refused."""

import random
import struct

import pytest

from tenura.llm.sentence_pieces import Pieces, decode, encode, kind_of

sentencepiece = pytest.importorskip("sentencepiece")


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(path, pieces, kind=1, train=None, norm=None):
    """A model file of (piece, score) with <unk>, <s>, </s> and the bytes before them."""
    train, norm = {3: kind, 35: 1, 4: len(pieces) + 259} | (train or {}), {1: "identity", 3: 1, 4: 0, 5: 1} | (norm or {})
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(p, s, 1) for p, s in pieces]
    body = b"".join(field(1, field(1, p) + field(2, s) + field(3, k)) for p, s, k in rows)
    for number, part in ((2, train), (3, norm)):
        body += field(number, b"".join(field(n, v) for n, v in sorted(part.items())))
    path.write_bytes(body)
    return str(path)


def vocabulary(rnd, kind):
    letters = "abcdeé日▁"
    pieces = {c: -8.0 - rnd.random() for c in letters[:-3] + "▁é"}
    while len(pieces) < 160:
        p = rnd.choice(["", "▁"]) + "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 5)))
        pieces.setdefault(p, round(-2 - 9 * rnd.random(), 1) if kind == 1 else -float(len(pieces)))
    return list(pieces.items())


def text(rnd):
    return " ".join("".join(rnd.choice("abcdeabcdeé日x") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 25)))


@pytest.mark.parametrize("kind", [1, 2])
def test_ids_are_the_librarys(tmp_path, kind):
    rnd = random.Random(kind)
    path = model(tmp_path / "m.model", vocabulary(rnd, kind), kind)
    assert kind_of(path) == {1: "unigram", 2: "bpe"}[kind]
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path)
    texts = ["", " ", "  a", "a\tb\n", "日日x", "▁a"] + [text(rnd) for _ in range(1000)] + [" ".join(text(rnd) for _ in range(400)) + "日" * 50]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(t), t[:80]


def test_unigram_models_through_spark(spark, tmp_path):
    rnd = random.Random(5)
    path = model(tmp_path / "m.model", vocabulary(rnd, 1))
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {i: text(rnd) for i in range(60)} | {90: None, 91: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = encode(df, path)
    assert all(r["ids"] == lib.encode(texts[r["doc_id"]] or "") for r in found.collect())
    assert {r["doc_id"]: r["text"] for r in decode(found, path).collect()} == {i: t or "" for i, t in texts.items()}
    assert decode(found.limit(0), path).collect() == [] and decode(spark.createDataFrame([(1, None), (1, [])], "doc_id long, ids array<int>"), path).count() == 2


@pytest.mark.parametrize(("what", "more"), [("kind", {"kind": 4}), ("byte fallback", {"train": {35: 0}}), ("normalisation", {"norm": {2: b"rules"}}), ("mark", {"norm": {3: 0}}), ("white space", {"norm": {4: 1}}), ("mark", {"train": {24: 1}})])
def test_models_that_would_be_encoded_wrongly_are_refused(tmp_path, what, more):
    with pytest.raises(ValueError, match=what):
        Pieces(model(tmp_path / "m.model", [("a", -1.0)], **more))
