"""The corpus pipeline on planted rows, against a plain run of the same decisions."""

from __future__ import annotations

import os
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import plain
import pytest
from test_operators import awkward, graded, prose

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from snapcount.llm import decontam, quality  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    texts, good = graded(90)
    passage = prose(4242, 35)
    texts += [texts[1], texts[1], prose(31, 40) + "\n" + passage, "mail ann@example.org now\n" + prose(32, 40)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(1000 + (i or 0), *r) for i, *r in awkward()]
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    docs["n_chars"] = docs.n_chars.astype("Int64")
    docs["batch"] = "own"
    docs.to_parquet(path / "documents.parquet")
    pd.DataFrame({"doc_id": range(90), "quality": good.astype(int), "toxic": 0}).to_parquet(path / "labels.parquet")
    pd.DataFrame({"item_id": [1, 2], "text": [passage, None]}).to_parquet(path / "benchmark.parquet")
    return str(path)


def test_stages_keep_what_a_plain_run_keeps(spark, folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    labels = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id").quality
    train = sorted((str(i), i) for i in labels.index if zlib.crc32(str(i).encode()) % 3 != 1)
    text = docs.set_index("doc_id").text
    chain = quality.fit([text[i] for _, i in train], np.array([float(labels[i]) for _, i in train]))
    rows = [(r.doc_id, r.text) for r in docs.itertuples()]
    rows = [r for r, s in zip(rows, quality.scores(chain, [t or "" for _, t in rows]), strict=True) if s >= 0.5]
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    groups = plain.alike([t for _, t in rows])
    rows = [r for i, r in enumerate(rows) if groups[i] == i]
    item = decontam.plain(pd.read_parquet(f"{folder}/benchmark.parquet").text[0])
    rows = [r for r in rows if item not in decontam.plain(r[1] or "")]
    expected = Counter(i for i, _ in rows)

    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in found) == expected
    by_id = {r.doc_id: r for r in found}
    assert by_id[93].text.startswith("mail [EMAIL] now") and by_id[93].n_chars == len(by_id[93].text)
    assert 92 not in by_id and not {90, 91} & set(by_id)
    for r in found:
        if r.doc_id != 93:
            assert r.doc_id >= 1000 or r.text == text[r.doc_id]
        assert r.n_tokens + r.padding == r.bound
    assert len({(r.bucket, r.batch, r.slot) for r in found}) == len(found)


def test_each_stage_returns_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_other_queries_do_not_need_the_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "corpus", None)
    names = set(entry.queries())
    assert "game_plays" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
