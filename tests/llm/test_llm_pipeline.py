"""The pipeline's stages on a small table, and the guard around the subpackage."""

from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from matchloom.llm import queries
from matchloom.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(i, f"{base} {' '.join(f'own{i}x{j}' for j in range(150))}", "en", f"s{i % 3}", 0) for i in range(30)]
    rows += [(100, base, "en", "s0", 0), (101, base.upper(), "en", "s1", 0), (102, base, None, None, 0), (103, None, "en", "s1", 0), (104, "12 ?", "en", "s1", 0), (105, "mail a@b.org " + base[::-1], "en", "s2", 0), (100, base, "en", "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, ""), "test")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [Counter(r.doc_id for r in s) for s in seen]
    assert not {103, 104} & set(ids[0]) and len(seen[0]) == len(rows) - 2
    assert ids[1][100] == 1 and not {101, 102} & set(ids[1]) and set(ids[1]) == {*range(30), 100, 105}
    assert [r.text.split()[1] for r in seen[2] if r.doc_id == 105] == ["[EMAIL]"] and len(seen[2]) == len(seen[1])
    assert set(ids[3].values()) <= {1, 2} and len(seen[4]) == len(seen[3])
    assert ids[4] == ids[3] and all(len(r.ids) == r.n_tokens for r in seen[4])


def test_names():
    assert len(corpus_pipeline.STAGES) == 5 and [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), "test")
    assert docs.count() == 0


def test_workers_give_their_memory_back(monkeypatch):
    """A worker that has done a task of the first two stages lives on through the others, without that task's memory."""
    from matchloom.llm import langid, simhash

    told = []
    monkeypatch.setattr(simhash, "trim", lambda: told.append("fingerprints"))
    monkeypatch.setattr(langid, "trim", lambda: told.append("languages"))
    model = langid.Model(["en"], {}, np.zeros((1, 1), np.float32), {})
    texts = lambda *names: iter([pa.record_batch([pa.array([1]), pa.array(["some words"])], list(names))])
    assert len(list(langid._labels(model, 1.0, False)(texts("kept", "text")))) == 1
    assert len(list(langid._counts(iter([pa.record_batch([pa.array(["some words"]), pa.array(["en"])], ["text", "lang"])])))) == 1
    assert len(list(simhash._fingerprints(iter([pa.record_batch([pa.array([1]), pa.array([b"some words"])], ["doc_id", "text"])])))) == 1
    assert told == ["languages", "languages", "fingerprints"]
