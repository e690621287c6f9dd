import numpy as np
import pytest

from pagelore.llm.embeddings import near_duplicates
from pagelore.llm.runs import join_labels


@pytest.mark.parametrize("block", [4096, 20])
def test_links(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 16))
    rows = []
    for i in range(400):
        c = centre[0 if i < 120 else rng.integers(40)]
        rows.append((i, (c + 0.03 * rng.standard_normal(16)).tolist(), int(rng.integers(2))))
    rows += [(500 + i, centre[1].tolist(), 0) for i in range(30)] + [(540, (3 * centre[1]).tolist(), 0), (541, centre[1].tolist(), None)]
    odd = [(600, None, 1), (601, [0.0] * 16, 1), (602, [], 1), (603, [None] * 16, 1), (604, [float("nan")] * 16, 1), (605, [float("inf")] * 16, 1), (606, centre[1].tolist()[:8], 0)]
    table = spark.createDataFrame(rows + odd + [rows[0]] + [(None, centre[1].tolist(), 0)], "vec_id long, embedding array<double>, label int")
    got = near_duplicates(table.withColumnRenamed("nothing", "n_links"), block=block).collect()
    assert len(got) == table.count()
    every = rows + [rows[0]]
    x = np.array([r[1] for r in every])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([-1 if r[2] is None else r[2] for r in every])
    link = (x @ x.T >= 0.98) & (label[:, None] == label) & (label[:, None] >= 0)
    np.fill_diagonal(link, False)
    ids, by = np.array([r[0] for r in every]), {}
    root = join_labels(np.arange(len(every)), *np.nonzero(link))
    for r in got:
        by[r.vec_id] = r
    for r, n, k in zip(every, link.sum(axis=1), root):
        assert by[r[0]].n_links == n
        assert by[r[0]].component_id == ids[root == k].min() and by[r[0]].kept == (r[0] == by[r[0]].component_id)
    for r in odd[:6]:
        assert (by[r[0]].n_links, by[r[0]].component_id, by[r[0]].kept) == (0, r[0], True)
    assert by[None].n_links == 0


def test_floats_and_empty(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [(r.n_links, r.component_id) for r in near_duplicates(table).orderBy("vec_id").collect()] == [(1, 1), (1, 1)]
    assert near_duplicates(table.limit(0)).count() == 0
