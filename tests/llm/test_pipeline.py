"""The pipeline on a small corpus, stage by stage, against plain versions of the stages."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def test_stages(spark, tmp_path):
    rnd = random.Random(1)
    prose = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice("abcdefghij") for _ in range(n)) + "."
    rows = []
    for i in range(150):
        t = "JUNK!! ### " * 30 if i % 6 == 5 else prose(50)
        rows.append((i, t, rnd.choice(["en", "fr"]), rnd.choice(["a", "b"]), len(t)))
    for i in range(20):  # copies, which must go
        rows.append((200 + i, rows[0][1] + (" tail" if i % 2 else ""), "en", "a", 0))
    rows.append((300, prose(40) + ' token = "0123456789abcdef0123" ' + prose(5), "fr", "b", 0))
    rows += [(301, None, None, None, None), (None, prose(30), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 != 5), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    good = pipeline.quality(spark, docs, d).cache()
    ids = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and {i for i in range(150) if i % 6 != 5} <= ids and not ids & {i for i in range(150) if i % 6 == 5}
    once = pipeline.near_dedup(spark, good, d).cache()
    left = {r["doc_id"] for r in once.collect()}
    assert once.columns == docs.columns and left & {0, *range(200, 220)} == {0} and {i for i in range(1, 150) if i % 6 != 5} <= left
    clean = pipeline.secrets(spark, once, d).cache()
    assert clean.columns == docs.columns and clean.count() == once.count() and clean.where("text like '%0123456789abcdef%'").isEmpty()
    mixed = pipeline.mixing(spark, clean, d).cache()
    assert mixed.columns == docs.columns and 0.5 < mixed.count() / clean.count() < 0.95
    lib = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    final = {r["doc_id"]: list(r["ids"]) for r in pipeline.run(spark, d).collect()}
    assert final == {i: lib.encode(t or "") for i, t in texts.items()}


def test_repeated_ids_leave_one_row(spark, tmp_path):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()) == [1, 2]
    assert pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_repeated_ids_with_other_texts_stay(spark):
    """Rows are judged by their own text: what repeats an id is neither lost nor taken for a copy."""
    a, b, c = ("a b c d e f g h i j k l m n", "totally different words here and no others at all", "x y z x y x z z y x y")
    rows = [(1, a, "p"), (1, b, "p"), (2, a.upper(), "q"), (2, c, "q"), (3, b + " ", "r"), (3, c, "r"), (1, a.upper(), "s"), (None, a, "t"), (None, a, "t"), (4, "", "u"), (4, "", "u"), (5, None, "v")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, x, True) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, marked_id string, marked boolean")
    out = pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    left = sorted(((r["doc_id"] or 0, r["text"] or "", r["marked_id"]) for r in out.collect()), key=str)
    one = [x for x in left if x[0] == 1 and x[1].lower() == a]
    assert len(one) == 1  # texts of one set and id are one document
    assert [x for x in left if x not in one] == sorted([(1, b, "p"), (2, c, "q"), (0, a, "t"), (0, a, "t"), (4, "", "u"), (4, "", "u"), (5, "", "v")], key=str)


def test_stages_on_an_empty_table_long_texts_and_other_columns(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60_000)) + " " + "x" * 50_000
    kind = "doc_id long, text string, lang string, source string, n_chars long, cell string, _kept string, probability double, comp long, node long, marked string, text_hash string"
    rows = [(i, t, "en", None, 1, "mine", "mine", 0.5, 7, 8, "mine", "mine") for i, t in [(1, long), (2, long), (3, "one two three. Four five six."), (4, None), (4, ""), (5, "one two three. Four five six.")]]
    docs = spark.createDataFrame(rows, kind)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0), (5, 1, 0), (1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        found = out.collect()
        assert {r["doc_id"] for r in found} >= ({1, 3, 4} if name != "mixing" else set()), name
        assert all((r["cell"], r["_kept"], r["probability"], r["comp"], r["node"], r["marked"], r["text_hash"]) == ("mine", "mine", 0.5, 7, 8, "mine", "mine") for r in found), name
        assert all(r["text"] == long for r in found if r["doc_id"] == 1), name
    assert {r["doc_id"]: r["n_pieces"] > 60_000 for r in pipeline.pieces(spark, docs, d).collect()}[1]
    assert pipeline.run(spark, d).count() == 0
