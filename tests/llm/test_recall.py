"""Near copies of embeddings at the shipped parameters: links found against all pairs."""

import numpy as np

from provenir.llm import embeddup


def test_recall_of_planted_near_copies(spark):
    r = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(r.standard_normal((300, 64)))
    rows = [base]
    for _ in range(4):
        side = r.standard_normal(base.shape)
        side = unit(side - (side * base).sum(1, keepdims=True) * base)
        c = r.uniform(0.9, 0.97, (300, 1))
        rows.append(c * base + np.sqrt(1 - c * c) * side)
    v = np.concatenate(rows).astype(np.float32)
    u = unit(v.astype(np.float64))
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddup.near_duplicates(df).collect()}
    found = np.array([got[i][0] for i in range(len(v))])
    assert links.sum() > 2000 and (found <= links.sum(1)).all() and found.sum() >= 0.99 * links.sum()
    assert sum(got[i][1] == i % 300 for i in range(len(v))) >= 0.99 * len(v)
