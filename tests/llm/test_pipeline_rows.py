"""Stages of the pipeline decide on rows by their own text: odd ids, nulls, repeats, empty tables, columns of any name; and
the whole pipeline against a plain version."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from loamdex.llm import language, order_minhash, pii, toxicity
from loamdex.llm.tokens import vocabulary

A, B, C = ("".join(f"{x}{w} " for w in "the river runs under old stone bridges while people gather near the harvest market".split()) for x in ("", "q", "z"))
SCHEMA = "doc_id long, text string, lang string"


def _rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_one_row_of_a_class_stays(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in [(2, A), (1, A), (1, A), (1, B), (None, A), (None, C), (None, C), (3, None), (3, "")]], SCHEMA)
    out = pipeline.stage_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert [r for r in _rows(out) if r[1]] == sorted([(1, A), (1, B), (None, C)], key=str)


def test_rejected_rows_go_by_their_own_text(spark):
    docs = spark.createDataFrame([(i, A, "en") for i in range(8)] + [(50, "!!!", "en"), (50, B, "en"), (None, "???", "en"), (None, C, "en"), (60, None, "en"), (60, "", "en")], SCHEMA)
    out = _rows(pipeline.stage_language(spark, docs, ""))
    assert out == sorted([(i, A) for i in range(8)] + [(50, B), (None, C)], key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with clashing column names, null and shared ids, copies, a language of their own and toxic words; labels."""
    r = np.random.default_rng(4)
    words = {"en": [f"{x}ing" for x in "run walk sing read farm fish cook sail build paint trade plant".split()], "de": [f"{x}keit" for x in "hell schwach tapfer heiter klar rein zart eitel dunkel flink fest mild".split()]}
    made = lambda lang, n: " ".join(f"{w}{chr(97 + int(k))}" for w, k in zip(r.choice(words[lang], n), r.integers(0, 20, n)))
    docs, labels = [], []
    for i in range(240):
        lang, toxic = ("en", "de")[i % 2], i % 6 == 0
        text = made(lang, 70) + (" vilest grobnik wretch vilest grobnik" * 3 if toxic else "") + (f" mail a{i}@b{i}.org" if i % 10 == 3 else "")
        docs.append((i, text, lang))
        labels.append((i, 1, int(toxic)))
    docs += [(500, docs[1][1], "de"), (500, docs[2][1], "en"), (None, docs[3][1] + " more", "en"), (None, "?!", "en"), (7, docs[7][1], "de"), (700, None, "en"), (701, "", "en")]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, x, "s", len(t or ""), 0.5, "x", 1, b"k") for i, t, x in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, `lang_pred` string, `doc_id.c0` int, `key` binary").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_whole_pipeline_equals_plain_decisions(spark, folder):
    """Each stage's rows by a plain version in which decisions are taken one document at a time."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    field = language.train(docs)
    one = lambda model, t, f: f(spark.createDataFrame([(0, t)], "doc_id long, text string"), model).first()

    out = pipeline.materialize(pipeline.stage_language(spark, docs, folder))
    assert out.columns == names
    got = {r.doc_id: r for r in language.classify(docs, field).collect() if r.doc_id is not None and r.doc_id < 240}
    assert all(r.lang_pred == ("en", "de")[i % 2] for i, r in got.items())
    assert _rows(out) == sorted(((r.doc_id, r.text) for r in docs.collect() if r.text and r.text != "?!"), key=str)

    net = toxicity.train(out, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = pipeline.materialize(pipeline.stage_toxicity(spark, out, folder))
    assert _rows(clean) == sorted(((r.doc_id, r.text) for r in out.collect() if "grobnik" not in r.text), key=str)
    assert one(net, "vilest grobnik wretch vilest grobnik", toxicity.score).score > 0.7

    single = pipeline.materialize(pipeline.stage_near_duplicates(spark, clean, folder))
    kept = defaultdict(list)
    hashed = lambda t: np.array([zlib.crc32(w.encode()) for w in t.replace("@", " ").replace(".", " ").split()], np.uint64)
    for r in sorted(clean.collect(), key=lambda r: (r.doc_id is None, r.doc_id)):
        if not any(order_minhash.similarity(hashed(r.text), hashed(t)) >= 0.8 for t in kept):
            kept[r.text].append(r.doc_id)
    assert _rows(single) == sorted(((i[0], t) for t, i in kept.items()), key=str)

    hidden = pipeline.materialize(pipeline.stage_pii(spark, single, folder))
    assert hidden.columns == names and hidden.count() == single.count()
    assert all("@" not in r.text and r.n_chars == len(r.text) for r in hidden.collect())
    assert pii.find(single, None).where("size(base) > 0").count() == hidden.where("text like '%[EMAIL]%'").count() > 0

    tok = Tokenizer.from_file(vocabulary())
    pieces = defaultdict(list)
    for r in pipeline.stage_packing(spark, hidden, folder).collect():
        pieces[r.doc_id].append((r.start, r.length))
    want = defaultdict(int)
    for r in hidden.collect():
        want[r.doc_id] += len(tok.encode(r.text, add_special_tokens=False).ids) + 1
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == dict(want)


def test_run_over_an_empty_table(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
