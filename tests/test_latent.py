import numpy as np
import pytest

from folioscope.operators import latent
from folioscope.operators.hooks import embed
from folioscope.plans.indexing import index_documents
from folioscope.plans.knowledge_base import KnowledgeBase


def corpus(n=240):
    rng = np.random.default_rng(5)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("whale", "train", "energy", "bread", "music", "stone")]
    return [" ".join(rng.choice(topics[i % 6], 14).tolist() + rng.choice(["the", "of", "and", "a"], 6).tolist()) for i in range(n)]


def dense(texts, idf):
    out = np.zeros((len(texts), len(idf)))
    for i, t in enumerate(texts):
        for at, x in latent.counts_of(t, len(idf)).items():
            out[i, at] = x * idf[at]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size, size, 1)


def test_subspace_is_that_of_the_whole_matrix(spark):
    texts = corpus() + ["", None, "the the"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    model = latent.fit(docs, 6, width=512, passes=6)
    a = dense(texts, model.idf)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values, s[:6], rtol=1e-3)
    # the angles between both subspaces
    assert np.linalg.svd(v[:6] @ model.basis, compute_uv=False).min() > 0.999
    want = a @ model.basis
    size = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(model([t or "" for t in texts]), want / np.where(size > 1e-12, size, 1), atol=1e-9)
    rows = docs.select("text", latent.embedding(docs.text, model).alias("v")).collect()
    assert all(np.allclose(r.v, model([r.text or ""])[0], atol=1e-5) for r in rows)
    with pytest.raises(ValueError):
        latent.fit(docs.limit(0))


def test_serves_embed_and_the_knowledge_base(spark, tmp_path):
    texts = corpus(60)
    docs = spark.createDataFrame([(f"d{i}", f"# Part\n\n{t}") for i, t in enumerate(texts)], "doc_id string, content string")
    model = latent.fit(docs, 8, text_col="content", width=512)
    name = latent.register(model, "corpus-fitted")
    assert len(embed(docs, name).first().embedding) == 8
    index_documents(spark, docs, str(tmp_path / "kb"), name, least=0, shortest=5)
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), name)
    top = kb.search_documents(["whale1 whale2 whale3"], 5, mode="semantic").collect()
    assert {int(r.doc_id[1:]) % 6 for r in top} == {0}
