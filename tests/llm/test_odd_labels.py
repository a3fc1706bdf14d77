"""Labels that don't fit, and ids that repeat with other labels."""

import json

import numpy as np
from tokenizers import Tokenizer

from brightloom.llm import bpe, common, langid, quality, queries, url_filter, warc


def test_labels_other_than_0_and_1_do_not_count(spark):
    common.prepare(spark)
    good = [(f"http://a{i % 7}.org/x{i}", i % 2) for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(good)] + [(None, None), (99, "http://a1.org/x1")], "page_id long, url string")
    kind = "url string, label int"
    rules = [("allow", "a1.org/")]
    want = url_filter.judge(pages, rules, spark.createDataFrame(good, kind)).collect()
    odd = [("http://b.org/1", None), ("http://b.org/2", 7), (None, -1)]
    assert sorted(map(repr, url_filter.judge(pages, rules, spark.createDataFrame(good + odd, kind)).collect())) == sorted(map(repr, want))
    _, rates = url_filter.train(spark.createDataFrame(good + odd, kind))
    assert 0 <= rates.min() and rates.max() <= 1
    for y, verdict in ((0, "allow"), (1, "block")):
        got = url_filter.judge(pages, [], spark.createDataFrame([(u, y) for u, _ in good] + odd, kind))
        assert {r["verdict"] for r in got.collect()} == {verdict}
    twice = spark.createDataFrame(good + good, kind)
    assert url_filter.judge(pages, rules, twice).count() == 62 and url_filter.judge(pages, rules, twice.limit(0)).count() == 62


def test_a_repeated_id_keeps_text_and_language_together(spark):
    common.prepare(spark)
    english, french = "the house and the river with the tall tree", "la maison et le fleuve avec le grand arbre"
    rows = [(i, english + f" {i}", "en", 1) for i in range(200)] + [(i, french + f" {i}", "fr", 1) for i in range(100, 300)] + [(i, french, None, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int").repartition(3)
    got = langid.predict(df.where("lang is not null"), langid.learn(df)).select("lang_pred").collect()
    assert {r["lang_pred"] for r in got} == {"en", "fr"}
    by = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, english), (2, french)], "doc_id long, text string"), langid.learn(df)).collect()}
    assert by == {1: "en", 2: "fr"}


def test_decoding_adds_up_each_bits_loss():
    rng = np.random.default_rng(4)
    code = langid.codewords(12)
    model = langid.Languages([f"l{i}" for i in range(12)], code, np.zeros((1, 1)), np.zeros(code.shape[1]), rng.random(code.shape[1]))
    margins = rng.normal(size=(5, code.shape[1])) * 3
    best, p, _ = model.decode(margins)
    for k in range(5):
        loss = [sum(model.trust[b] * np.logaddexp(0, -margins[k, b] * code[i, b]) for b in range(code.shape[1])) for i in range(12)]
        assert best[k] == int(np.argmin(loss)) and np.isclose(p[k], 1 / sum(np.exp(min(loss) - x) for x in loss))


def test_a_repeated_id_keeps_text_and_weak_label_together(spark):
    """Each id once with a good text and once with a bad one: the scorer still learns which is which."""
    common.prepare(spark)
    good = "The old house by the river has a garden, and the people of the town walk there in the evening with their children"
    bad = "BUY NOW!! $$$ ### 12345 99999 BUY NOW!! $$$ ### 12345 99999 BUY NOW!! $$$ ### 12345 99999"
    both = [(i, f"{t} {i}") for i in range(150) for t in (good, bad)]
    df = spark.createDataFrame(both + [(None, good), (7, None), (8, "")], "doc_id long, text string").repartition(3)
    apart = spark.createDataFrame([(2 * i + (t == bad), f"{t} {i}") for i in range(150) for t in (good, bad)], "doc_id long, text string")
    model = quality.train(df)
    assert model.linear == quality.train(apart).linear
    score = model.score([f"{good} 3", f"{bad} 3"])[0]
    assert score[0] > 0.9 > 0.1 > score[1]


def test_folders_without_a_scheme_lie_in_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert warc.qualified(spark, "/a/b") == "file:///a/b" and warc.qualified(spark, "file:/a b/c%20d") == "file:///a b/c%20d"
    old = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://names:8020")
    try:
        assert warc.qualified(spark, "/a/b") == "hdfs://names:8020/a/b"
        assert warc.qualified(spark, "s3a://bucket/a") == "s3://bucket/a" and warc.qualified(spark, "file:///a") == "file:///a"
    finally:
        conf.set("fs.defaultFS", old)


def test_words_are_remembered_up_to_a_size(monkeypatch):
    """Long distinct words: results stay those of the library, and what is remembered stays small."""
    path = queries.tokenizer_path()
    monkeypatch.setattr(bpe, "REMEMBERED_SIZE", 20_000)
    one, library = bpe.Bpe(bpe._model_text(path)), Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    for n in (3, 40, 300, 5000):
        for _ in range(60):
            word = "".join(rng.choice(list("abcdefgh0123é"), n))
            text = f"{word} the {word}"
            ids = library.encode(text, add_special_tokens=False).ids
            assert one.encode(text) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
            assert one.size <= 20_000 and one.size == sum(len(w) + len(a) + len(b) for w, (a, b) in one.known.items())


def test_vocabularies_with_longer_tokens_are_refused():
    spec = json.loads(bpe._model_text(queries.tokenizer_path()))
    assert bpe.refused(spec) == []
    spec["model"]["vocab"]["a" * 256] = 1
    assert bpe.refused(spec) == ["model.vocab"]
