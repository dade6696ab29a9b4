"""The pipeline's stages against what each is to do with its own input."""

import random

import corpus_pipeline

from tracefield.llm import decontaminate, near_dup

from .conftest import SCHEMA
from .test_operators import brute_groups, brute_secrets


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    text = lambda n=80: " ".join(word() for _ in range(n))
    items = [(k, text(40)) for k in range(3)]
    base = text(100)
    near = base.split()
    near[3] = "changed"
    texts = [base, " ".join(near), base, text() + " " + items[1][1] + " " + text(5), text() + " token = abcdef123456 " + text(5), "1234 !!", None, *(text() for _ in range(5))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(stage["language_id"](spark, docs, str(tmp_path))) == [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    groups = brute_groups(rows, round(100 * corpus_pipeline.SIMILARITY))
    assert ids(stage["near_dedup"](spark, docs, str(tmp_path))) == sorted(set(groups.values()))
    assert ids(stage["decontamination"](spark, docs, str(tmp_path))) == [i for i in range(len(texts)) if i != 3]
    clean = stage["secret_scan"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and not any(brute_secrets(r["text"] or "") for r in clean.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {0, 4, 7, 8, 9, 10, 11}
    nameless = spark.createDataFrame([(None, base, "en", "s", 1), (1, base, "en", "s", 1)], SCHEMA)
    assert near_dup.keep_one(nameless).count() == 2
    assert decontaminate.remove_contaminated(nameless, spark.createDataFrame(items, "item_id long, text string")).count() == 2


def test_gibberish_goes_and_all_languages_stay(spark, tmp_path):
    rng = random.Random(4)
    syllables = {"en": ["th", "ing", "er", "on", "and"], "de": ["sch", "ung", "ü", "ein", "ch"], "fr": ["eau", "é", "oi", "que", "le"], "es": ["ción", "ñ", "ar", "os", "el"]}
    clean = [(i, " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), k, "s", 1) for i, (k, s) in enumerate(list(syllables.items()) * 60)]
    junk = ["".join(rng.choice("qxzjkvwpfbgy0123456789+/=") for _ in range(rng.randint(80, 400))) for _ in range(30)]
    junk += ["a 4785380592391139 $$$ &&& %%% 0123 #### 77291 @@@@ (((( 5555 ]]]] ++++ 90817 ~~~~ 31415"]
    rows = clean + [(1000 + i, t, None, "s", 1) for i, t in enumerate(junk)]
    out = dict(corpus_pipeline.STAGES)["language_id"](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [r[0] for r in clean]


def test_the_language_found_goes_on_to_the_pieces(spark, tmp_path):
    """Documents without a label are given the language of their text, and the last stage's pieces have it."""
    rng = random.Random(6)
    words = {"en": "the and of house river with from over".split(), "de": "der und von haus fluss mit aus über".split(), "fr": "le et de maison rivière avec depuis sous".split()}
    langs = [k for k in words for _ in range(20)]
    label = lambda i, k: None if i % 20 == 3 else k
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(60)), label(i, k), "s", 1) for i, k in enumerate(langs)]
    stage = dict(corpus_pipeline.STAGES)
    docs = stage["language_id"](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert {r["doc_id"]: r["lang"] for r in docs.collect()} == dict(enumerate(langs))
    pieces = stage["best_fit_packing"](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"]: r["lang"] for r in pieces} == dict(enumerate(langs))
