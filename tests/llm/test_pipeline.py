import glob

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import odd_rows, sets_of, table
from tidemark.llm.queries import model_path


def test_stages_against_brute_force(spark, tmp_path):
    rows = odd_rows() + [(70, "123 456", "en", "src0")]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    table(spark, rows).select(*columns).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert i == 4 or docs.columns == columns
        docs.write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        kept.append(docs.collect())
    first = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(str(r.doc_id) for r in kept[0]) == sorted(str(r[0]) for r in first)
    texts = {}
    for i, t, *_ in first:
        texts[t] = min((x for x in (i, texts.get(t)) if x is not None), default=None)
    assert sorted(str(r.doc_id) for r in kept[1]) == sorted(map(str, texts.values()))
    left = {r.doc_id: sets_of(r.text) for r in kept[2]}
    for i, a in left.items():
        for j, b in left.items():
            assert i == j or not a or 100 * len(a & b) < 80 * len(a | b)
    assert 0 < len(kept[3]) <= len(kept[2])
    m = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert {r.doc_id: r.ids for r in kept[4]} == {r.doc_id: m.encode(r.text) for r in kept[3]}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])


def test_language_stage_without_a_language(spark):
    texts = ["one two three", "été", "\U00010400", "123 456", " \n", "", None]
    docs = table(spark, [(i, t, None, "src0") for i, t in enumerate(texts)]).select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [0, 1, 2]


def test_one_of_each_group_by_repeated_and_null_ids(spark):
    w, v, u = ("a b c d e f g h i j k l m n o p q r s t".replace(" ", f"{x} ") for x in "xyz")
    rows = [(7, w), (7, w + " more"), (9, w + " again"), (None, v), (None, v + " more"), (None, u), (None, u + " more"), (7, u + " again"), (3, ""), (3, " "), (8, "alone here"), (8, "alone here"), (None, "by itself")]
    docs = table(spark, [(i, t, "en", "src0") for i, t in rows]).select("doc_id", "text", "lang", "source", "n_chars")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    groups = [{(7, w), (7, w + " more")}, {(None, v), (None, v + " more")}, {(7, u + " again")}, {(3, "")}, {(3, " ")}, {(8, "alone here")}, {(None, "by itself")}]
    assert len(got) == len(groups) and all(len(g & set(got)) == 1 for g in groups), got


def test_stages_with_clashing_columns(spark, tmp_path):
    """Columns named as what stages and operators use inside, or with a dot, pass through."""
    rows = odd_rows()
    more = {"__doc_id": F.lit(1), "__text_sha256": F.lit("x"), "__key": F.lit(2), "key0": F.lit(3), "key": F.lit("k"), "a.b": F.lit("dot"), "label": F.lit(4), "digest": F.lit("d"), "c0": F.lit(5), "lang_pred": F.lit("p"), "n_tokens": F.lit(6), "source_": F.lit("s")}
    plain = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs = plain.select("*", *(c.alias(n) for n, c in more.items()))
    docs.write.parquet(str(tmp_path / "in"))
    docs, plain = spark.read.parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "in")).select("doc_id", "text", "lang", "source", "n_chars")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        names = docs.columns
        docs, plain = stage(spark, docs, ""), stage(spark, plain, "")
        docs.write.parquet(str(tmp_path / f"d{i}"))
        plain.write.parquet(str(tmp_path / f"p{i}"))
        docs, plain = spark.read.parquet(str(tmp_path / f"d{i}")), spark.read.parquet(str(tmp_path / f"p{i}"))
        assert i == 4 or docs.columns == names
        assert sorted(map(str, docs.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_empty_table(spark, tmp_path):
    table(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_leaves_one_table(spark, tmp_path):
    table(spark, odd_rows()[:20]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = {p for p in glob.glob(f"{shared}/*/*")}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    left = [p for p in glob.glob(f"{shared}/*/*") if p not in before]
    assert len(left) == 1 and "pipeline-" in left[0]
