"""The corpus pipeline against plain versions of its stages, and what the driver expects of the registration."""

from __future__ import annotations

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from burstselect.llm import pii, queries, toxicity  # noqa: E402
from burstselect.llm.bpe import tokenizer  # noqa: E402
from burstselect.llm.common import hash_split  # noqa: E402
from burstselect.session import pin  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, mark string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(500)]
    rows, labels = [], []

    def add(i, text):
        rows.append((i, text, "en", "s", len(text or ""), "x", "y"))

    for i in range(300):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["Vile", "ROTTEN"])
        if i % 9 == 0:
            text.insert(5, "mail me@host.example.org or +1 (555) 123-4567 now")
        add(i, " ".join(text))
        labels.append((i, 1, int(toxic)))
    base = [rng.choice(words) for _ in range(300)]
    for i in range(400, 420):  # near copies
        copy = list(base)
        copy[rng.randrange(300)] = "changed"
        add(i, " ".join(copy))
    for i in (1, 2, 3, 5):  # exact copies
        add(500 + i, rows[i][1])
    for i, t in ((600, None), (601, ""), (602, ""), (None, "nobody owns this text"), (None, "nobody owns this text"), (603, rows[6][1]), (603, rows[6][1])):
        add(i, t)
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_near_dedup", "pii", "packing"]

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), hash_split("doc_id", 5) != 0)
    clean = pin(stages["toxicity"](spark, docs, folder))
    assert clean.columns == docs.columns
    assert as_rows(clean) == sorted((tuple(r) for r in docs.collect() if model.score(r.text) < 0.5), key=str)
    assert not [r for r in clean.collect() if r.text and ("Vile" in r.text or "ROTTEN" in r.text)]

    one = pin(stages["exact_dedup"](spark, clean, folder))
    best = {}
    for r in clean.collect():
        key = r.text or ""
        if key not in best or (r.doc_id if r.doc_id is not None else -1) > (best[key] if best[key] is not None else -1):
            best[key] = r.doc_id
    assert one.columns == docs.columns
    assert sorted(((r.text or "", r.doc_id) for r in one.collect()), key=str) == sorted(best.items(), key=str)

    apart = pin(stages["simhash_near_dedup"](spark, one, folder))
    near = {i for i in range(401, 420)}
    assert apart.columns == docs.columns
    assert as_rows(apart) == sorted((tuple(r) for r in one.collect() if r.doc_id not in near), key=str)

    masked = pin(stages["pii"](spark, apart, folder))
    before = {(r.doc_id, r.lang): r.text for r in apart.collect()}
    assert masked.columns == docs.columns and masked.count() == apart.count()
    for r in masked.collect():
        text = before[(r.doc_id, r.lang)]
        assert r.text == (pii.mask(text, pii.base_spans(text)) if text else text) and r.n_chars == len(r.text or "")
    assert any("[EMAIL] or [PHONE] now" in (r.text or "") for r in masked.collect())

    packed = stages["packing"](spark, masked, folder).collect()
    t = tokenizer(queries.vocabulary("byte_bpe_50k.json"))
    for r in masked.collect():
        pieces = sorted((p for p in packed if p.doc_id == r.doc_id), key=lambda p: p.start)
        assert [i for p in pieces for i in memoryview(p.ids).cast("I")] == t.encode(r.text or "", add_special_tokens=False).ids + [1]

    whole = corpus_pipeline.run(spark, folder)
    pick = lambda rows: sorted((str(r.doc_id), r.start, r.length, bytes(r.ids)) for r in rows)
    assert pick(whole.collect()) == pick(packed)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_registration():
    names = entry.queries()
    numbered = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbered == list(range(1, 14)) and set(queries.QUERIES) < set(names) and names["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLES) <= set(queries.QUERIES) and corpus_pipeline.ORACLE_SQL is None
