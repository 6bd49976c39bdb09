"""The pipeline against brute force, stage by stage and as a whole."""

import pytest

import corpus_pipeline
from sketchloom.llm.quality import RULES, STOP_WORDS
from tests.llm.conftest import corpus
from tests.llm.test_operators import ASCII_WORDS, assert_packed, contamination, drained, items, kept_of_similar, measures, rows


def accepted(text):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = measures(text)
    if n_words < 50 or 100 * n_repeat_words > 50 * n_words:
        return False
    lines = [x for x in (text or "").split("\n") if ASCII_WORDS.search(x)]
    stops = sum(w.lower() in STOP_WORDS for w in ASCII_WORDS.findall(text or ""))
    limits = {r.name: r for r in RULES}
    return (
        limits["mean_word_chars"].low <= word_chars / n_words <= limits["mean_word_chars"].high
        and n_symbols / n_words <= limits["symbols_per_word"].high
        and stops / n_words >= limits["stop_word_share"].low
        and n_dup_lines / len(lines) <= limits["duplicate_line_share"].high
    )


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en", f"src{i % 3}", len(t or ""), 1, "clash", None) for i, t in corpus()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, _x string, `n words` string"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    now = corpus()

    def check(name, expected):
        nonlocal docs, now
        out = stages[name](spark, docs, tables)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs, now = spark.read.parquet(str(tmp_path / name)), expected
        assert rows(docs.select("doc_id", "text", "kept", "_x")) == sorted(((i, t, 1, "clash") for i, t in expected), key=repr)

    check("quality_rules", [(i, t) for i, t in now if accepted(t)])
    left = drained(now)
    check("line_dedup", [(i, left[i]) for i, t in now if left[i] == t or ASCII_WORDS.search(left[i])])
    assert docs.filter("n_chars <> length(text)").count() == 0
    ids = kept_of_similar(now)
    check("near_dedup", sorted({(i, t) for i, t in now if i in ids}))
    dirty = {r[0] for r in contamination(now, items()) if r[-1]}
    check("decontamination", [(i, t) for i, t in now if i not in dirty])
    packed = stages["best_fit_packing"](spark, docs, tables).toPandas()
    assert set(packed.doc_id) == {i for i, _ in now}
    assert_packed(packed)
    whole = corpus_pipeline.run(spark, tables).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[key].values.tolist())) == sorted(map(tuple, packed[key].values.tolist()))
    assert_packed(whole)


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
