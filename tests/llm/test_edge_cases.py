"""Empty tables, nulls, ties, repeated rows and clashing names, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curbline.llm import bpe, decontaminate, embedding_dedup, language_id, line_dedup, ngram_join, secrets, substring_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly vex a jolly zebra near the river"
SPEECH = {"en": "the house stands near the water and the children walk to school", "fr": "la maison se trouve près de l'eau et les enfants vont à l'école"}


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


def profiles_of(spark, copies=1):
    return language_id.fit_profiles(spark.createDataFrame([(t, lang) for lang, t in SPEECH.items()] * copies, "text string, lang string"))


def toxic_index(spark):
    texts = [f"you vile rotten scoundrel number {k} go away" if k % 2 else f"a calm walk by the lake number {k} at noon" for k in range(60)]
    docs = docs_of(spark, texts, 1000)
    return toxicity.fit(docs, spark.createDataFrame([(1000 + k, 1, k % 2) for k in range(60)], LABELS))


APPLY = {
    "line_dedup": lambda spark, docs: line_dedup.dedup_lines(docs),
    "toxicity": lambda spark, docs: toxicity.score(docs, toxic_index(spark)),
    "decontaminate": lambda spark, docs: decontaminate.find(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")),
    "bpe": lambda spark, docs: bpe.decode(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text"), public_tokenizers.path("word_bpe_49k.json")),
    "ngram_join": lambda spark, docs: ngram_join.join_classes(docs),
    "substring_dedup": lambda spark, docs: substring_dedup.remove_repeats(docs),
    "secrets": lambda spark, docs: secrets.scan(docs),
    "language_id": lambda spark, docs: language_id.identify(docs, profiles_of(spark)),
}
ODD = [None, "", " \t\n", "a", ITEM, ITEM, "wörd " * 3, "x" * 50_000]


@pytest.mark.parametrize("name", sorted(APPLY))
def test_empty_table(spark, name):
    assert APPLY[name](spark, docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(set(APPLY) - {"decontaminate"}))
def test_one_row_out_for_every_row_in(spark, name):
    docs = docs_of(spark, ODD)
    got = APPLY[name](spark, docs.unionByName(docs)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == dict.fromkeys(range(len(ODD)), 2)


def test_benchmark_copies_among_odd_rows(spark):
    hits = APPLY["decontaminate"](spark, docs_of(spark, ODD)).select("doc_id").distinct().collect()
    assert sorted(r[0] for r in hits) == [4, 5]
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs_of(spark, ODD), benchmark).count() == 0
    twice = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs_of(spark, ODD), twice).collect()}
    assert got == {(4, 1), (4, 2), (5, 1), (5, 2)}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_extra_columns_with_clashing_names(spark, name):
    odd = ["id", "h", "g", "t", "key", "token", "pos", "part", "item_id", "__t", "__id"]
    plain = docs_of(spark, ODD)
    extra = plain.withColumns({c: F.lit("mine") for c in odd})
    a, b = APPLY[name](spark, plain), APPLY[name](spark, extra)
    shared = [c for c in a.columns if c not in odd and c not in ("lang", "source")]
    assert sorted(map(repr, a.select(*shared).collect())) == sorted(map(repr, b.select(*shared).collect()))


def test_toxicity_of_repeated_rows_and_ties(spark):
    vile, calm = "you vile rotten scoundrel number 7 go away", "a calm walk by the lake number 8 at noon"
    index = toxic_index(spark)
    assert "numbe~" not in index.terms and "number" not in index.terms  # a term of all examples tells nothing
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(spark, [vile, vile, calm, None, ""]), index).collect()}
    assert rows[0] == rows[1] > 0.7 > rows[2] and rows[3] == rows[4]


def test_language_of_repeats_ties_and_texts_without_letters(spark):
    texts = [SPEECH["en"], SPEECH["en"], SPEECH["fr"], None, "", "123 !", SPEECH["en"] * 3000]
    got = [r["lang_pred"] for r in language_id.identify(docs_of(spark, texts), profiles_of(spark)).orderBy("doc_id").collect()]
    assert got == ["en", "en", "fr", "und", "und", "und", "en"]
    one, same = profiles_of(spark), profiles_of(spark, copies=2)
    assert all((same[k] == 2 * one[k]).all() for k in one)
    tied = {"b": one["en"], "a": one["en"]}  # the first name in order
    assert language_id.identify(docs_of(spark, texts[:1]), tied).first()["lang_pred"] == "a"
    assert language_id.fit_profiles(docs_of(spark, []).select("text", "lang")) == {}


def test_profiles_do_not_depend_on_when_counts_are_merged(spark, monkeypatch):
    whole = profiles_of(spark, copies=5)
    monkeypatch.setattr(language_id, "HELD", 40)
    counts, plain = language_id.TrigramCounts(), {}
    for k in range(50):
        codes, n = language_id.trigrams(SPEECH["en"][k:])
        counts.add("en", codes, n)
        for c, m in zip(codes.tolist(), n.tolist()):
            plain[c] = plain.get(c, 0) + m
        if counts.held > 40:
            counts.merge()
    counts.merge()
    [(codes, n)] = counts.parts["en"]
    assert dict(zip(codes.tolist(), n.tolist())) == plain and counts.held == len(plain)
    assert set(whole) == set(SPEECH)


def test_warc_without_pages_and_with_null_columns(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "http://a", ""), (3, None, "x" * 200), (4, "http://b", "x" * 200)], "page_id long, url string, html string")
    got = {int(r["record_id"].rstrip(">").split(":")[-1].split("/")[-1].split("-")[-1]): r["record_type"] for r in warc.read_archives(warc.write_archives(odd.withColumn("digest", F.lit("mine")))).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_vectors_empty_repeated_and_tied(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(k, [1.0, 0.0], 1) for k in range(5)] + [(9, [1.0, 0.0], 2), (10, None, 1), (11, [0.0, 0.0], 1), (12, [1.0, None], 1), (13, [0.0, 1.0], None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema).withColumn("g", F.lit("mine"))).collect()}
    assert got == {k: (4, 0) for k in range(5)} | {k: (0, k) for k in (9, 10, 11, 12, 13)}


@pytest.mark.parametrize("texts", [[], ODD + ODD])
def test_stages_take_odd_documents(spark, texts, tmp_path):
    docs = docs_of(spark, texts)
    spark.createDataFrame([(1000, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() <= docs.count(), name
    assert steps["toxicity"](spark, docs, str(tmp_path)).count() == len(texts)  # nothing is known to be toxic
    assert steps["bpe"](spark, docs, str(tmp_path)).count() == len(texts)
    left = sorted(r["doc_id"] for r in steps["decontaminate"](spark, docs, str(tmp_path)).collect())
    assert left == [k for k, t in enumerate(texts) if t != ITEM]
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert set(got) <= set(range(len(texts))) and (4 not in got)
