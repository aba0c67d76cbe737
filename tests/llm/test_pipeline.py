"""The pipeline on a small table with nulls, repeated rows, ties, clashing columns and planted cases, and on empty tables."""

import random

import pytest

import corpus_pipeline as P

WORDS = [f"{a}{b}" for a in ("ri", "sto", "clou", "pa", "gre", "lan", "mo", "te") for b in ("ver", "ne", "per", "ling", "da", "kor", "m", "s")]
KIND = "doc_id long, text string, lang string, source string, n_chars long, _score double, _kept string, _row int, _c0 string, _id long, _text string, _fp long, _class int, _comp long, _hash long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(7)
    prose = lambda n: " ".join(rnd.choices(WORDS, k=n))
    texts = {i: prose(60) for i in range(80)}
    for i in range(80, 110):
        texts[i] = prose(30) + " grobnik " + prose(20)
    texts[200] = texts[3]  # an exact copy
    words = texts[4].split()
    words[30] = "changed"
    texts[201] = " ".join(words)  # a near copy: 50 of 61 shingles are shared
    texts[202] = "A line that two documents share.\n" + prose(40)
    texts[203] = prose(40) + "\na line that two documents share. "
    item = prose(20)
    texts[204] = prose(30) + " " + item.upper() + " " + prose(30)
    texts[205], texts[206] = None, ""
    texts[207] = prose(60_000)
    rows = [(k, v) for k, v in texts.items()] + [(5, texts[5]), (5, prose(50)), (None, prose(50)), (None, None)]
    full = [(k, v, "en", "web", len(v or ""), None, "k", 1, "c", 9, "t", 1, 1, 1, 1) for k, v in rows]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(full, KIND).write.parquet(f"{out}/documents.parquet")
    marks = [(i, 1, int(i >= 80)) for i in range(110)] + [(None, None, None), (80, 1, 1), (999, 0, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([("b1", item), ("b2", None), (None, "x")], "item_id string, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, item


def test_stages_take_effect_and_keep_the_columns(spark, folder):
    where, rows, item = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())
    names = docs.columns
    kept = P.reject_toxic(spark, docs, where)
    assert kept.columns == names
    toxic = {k for k, v in rows if v and "grobnik" in v}
    assert ids(kept) == sorted((k is None, k or 0, v or "") for k, v in rows if k not in toxic)
    docs = P.drop_repeated_lines(spark, kept, where)
    assert docs.columns == names and docs.count() == kept.count()
    text = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert text[202][0].startswith("A line") and "share" not in text[203][0] and text[203][1] == len(text[203][0])
    assert text[200] == ("", 0) and text[205] == ("", 0)  # the copy's only line stays with the first
    once = P.keep_one_of_near_copies(spark, kept, where)
    assert once.columns == names
    gone = set(ids(kept)) - set(ids(once))
    assert {(null, k) for null, k, _ in gone} == {(False, 200), (False, 201), (False, 206), (True, 0)}
    assert sum(not v for _, _, v in ids(once)) == 1 and len(ids(once)) == len(ids(kept)) - 5  # and one of two equal rows
    clean = P.reject_contaminated(spark, once, where)
    assert clean.columns == names and set(ids(once)) - set(ids(clean)) == {x for x in ids(once) if x[1] == 204}


def test_run_encodes_what_is_left(spark, folder):
    where, rows, _ = folder
    out = P.run(spark, where)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = [r.doc_id for r in out.collect()]
    assert 204 not in got and 85 not in got and 207 in got and got.count(None) == 1 and got.count(5) == 2


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
