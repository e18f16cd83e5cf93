"""Cells of the embedding operator: many of them, many blocks, and which ones a vector need not look into."""

import numpy as np

from blockloom.llm import embeddings


def links_of(x, least):
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    return near


def test_cells_left_out_hold_no_partner():
    rng = np.random.default_rng(3)
    x = embeddings.unit_rows(np.repeat(rng.normal(size=(40, 12)), 25, axis=0) + rng.normal(size=(1000, 12)) * 0.35)
    centres = embeddings.spherical_kmeans(x, 30)
    cells, home = embeddings.cells_of(x, centres, 29, 0.9), (x @ centres.T).argmax(axis=1)
    assert (cells[:, 0] == home).all() and (cells < 0).any()
    for i, j in zip(*np.nonzero(links_of(x, 0.9))):
        assert home[j] in cells[i]


def test_recall_on_many_cells(spark):
    """30,000 vectors of 64 numbers, 3,000 planted pairs of cosine 0.9 to 0.95 and a cluster of 600 near copies."""
    rng = np.random.default_rng(6)
    x = embeddings.unit_rows(rng.normal(size=(26_400, 64)))
    other = rng.normal(size=(3000, 64))
    other -= (other * x[:3000]).sum(1, keepdims=True) * x[:3000]
    other /= np.sqrt((other * other).sum(1, keepdims=True))
    c = rng.uniform(0.901, 0.95, (3000, 1))
    near = embeddings.unit_rows(x[-1] + rng.normal(size=(600, 64)) * 0.02)
    whole = np.concatenate([x, c * x[:3000] + np.sqrt(1 - c * c) * other, near]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(whole)], "vec_id long, embedding array<float>")
    unit = embeddings.unit_rows(whole)
    want = sum(int(links_of_block(unit, at).sum()) for at in range(0, len(unit), 3000))
    got = embeddings.near_duplicates(frame, block=500).collect()
    found = sum(r.n_links for r in got)
    planted = sum(r.n_links for r in got if 26_400 <= r.vec_id < 29_400)
    assert want * 0.9 <= found <= want and planted >= 0.9 * 3000
    assert len({r.component_id for r in got if r.vec_id >= 29_400 or r.vec_id == 26_399}) == 1


def links_of_block(unit, at):
    near = unit[at : at + 3000] @ unit.T >= 0.9
    near[np.arange(len(near)), at + np.arange(len(near))] = False
    return near


def test_labels_join_along_chains():
    n = 500
    order = np.random.default_rng(1).permutation(n)
    left, right = order[:-1], order[1:]
    assert (embeddings.joined(np.arange(n), left, right) == 0).all()
    assert embeddings.joined(np.arange(4), np.array([3, 3]), np.array([3, 2])).tolist() == [0, 1, 2, 2]
