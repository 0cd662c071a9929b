"""The pipeline against a chain of plain versions."""

import hashlib

import duckdb
import sentencepiece

import corpus_pipeline
from clearwell.llm import toxicity
from clearwell.llm.common import table
from clearwell.llm.queries import tokenizer_file

from .test_queries import plain_components, plain_dedup, plain_hits


def test_pipeline(spark):
    data = "/root/testdata/sf0.01"
    docs = table(spark, data, "documents")
    model = toxicity.fit_from(docs, table(spark, data, "labels"))
    scorer = model.scorer()
    rows = sorted(duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall())
    kept = [(d, t) for d, t in rows if scorer.score(t) < 0.5]
    assert len(kept) < len(rows)
    groups = plain_components(kept)
    kept = [(d, t) for d, t in kept if groups[d][1] == d]
    cut = plain_dedup(kept)
    kept = [(d, cut[d][1]) for d, _ in kept if not cut[d][0] or cut[d][1].split()]
    hits = dict(plain_hits(kept, duckdb.sql(f"select item_id, text from '{data}/benchmark.parquet'").fetchall()))
    kept = [(d, t) for d, t in kept if not hits[d][4]]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = {d: library.encode(t or "", add_eos=True) for d, t in kept}
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, data).collect()}
    assert {d: r["ids"] for d, r in found.items()} == want
    assert all(r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() for r in found.values())


def awkward_docs(spark, data):
    """Rows of every kind under columns that the operators use themselves."""
    texts = [r["text"] for r in table(spark, data, "documents").orderBy("doc_id").collect()]
    texts = [*texts, None, "", " \n", "x" * 300_000, texts[0], texts[1] + " more"]
    rows = [(k if k % 50 else None, t, "mine", "s", 7, 0.25, True, -1, ["r"], "n") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, "another text under the id three", "mine", "s", 7, 0.25, True, -1, ["r"], "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean, n_words long, removed array<string>, items string")


def test_stages_keep_columns_and_values(spark, data):
    docs = awkward_docs(spark, data)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        got = out.collect()
        assert got and all((r["lang"], r["source"], r["score"], r["held_out"], r["n_words"], r["removed"], r["items"]) == ("mine", "s", 0.25, True, -1, ["r"], "n") for r in got), name
        if name != "substring_dedup":
            assert {*((r["doc_id"], r["text"]) for r in got)} <= {*((r["doc_id"], r["text"]) for r in docs.collect())} and all(r["n_chars"] == 7 for r in got)
            assert any(r["text"] is None for r in got) and any(r["text"] == "" for r in got) and any(r["text"] == "another text under the id three" for r in got), name
        assert stage(spark, docs.limit(0), data).count() == 0, name
    assert corpus_pipeline.encode(spark, docs, data).count() == docs.count() and corpus_pipeline.encode(spark, docs.limit(0), data).count() == 0
