import numpy as np
import pytest

from tickloom.llm import neighbours


def plain(rows, cosine):
    unit = []
    for _, v in rows:
        good = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.abs(v).max() if good else None)
        if good:
            unit[-1] /= np.linalg.norm(unit[-1])
    n, head = len(rows), list(range(len(rows)))
    links = [[b for b in range(n) if b != a and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine] for a in range(n)]

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(n):
        for b in links[a]:
            x, y = find(a), find(b)
            head[max(x, y)] = min(x, y)
    out = []
    for a in range(n):
        ids = [rows[b][0] for b in range(n) if find(b) == find(a) and rows[b][0] is not None]
        least = min(ids, default=None)
        out.append((rows[a][0], len(links[a]), least, rows[a][0] == least))
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    center = rng.standard_normal((4, 16))
    for i in range(120):
        rows.append((500 + i, (center[i % 3] + 0.05 * rng.standard_normal(16)).tolist()))
    for i in range(20):
        rows.append((700 - i, (np.array(rows[i][1]) * 3 + 0.1 * rng.standard_normal(16)).tolist()))
    rows += [(900 + i, rows[310][1]) for i in range(30)] + [(905, rows[5][1]), (5, rows[5][1])]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [1.0, None]), (1003, [float("nan")] * 16), (1004, [float("inf"), 1.0]), (1005, [])]
    rows += [(1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, rows[7][1]), (None, [9.0, -1.0]), (1008, [1e200, 2e200]), (1009, [1e-200, -9e-200])]
    return rows


@pytest.mark.parametrize("sizes", [(256, 512, 8), (64, 20, 4)])
def test_equals_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(neighbours, "BLOCK", sizes[0])
    monkeypatch.setattr(neighbours, "PIECE", sizes[1])
    monkeypatch.setattr(neighbours, "LIST", sizes[2])
    rows = corpus()
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, node int, unit string")
    got = neighbours.near_duplicates(vectors).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == plain(rows, 0.9)


def test_empty_table(spark):
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "audit", lambda *a: (1, 2))
    with pytest.raises(RuntimeError, match="recall 0.500"):
        neighbours.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.1])], "vec_id long, embedding array<double>"), tries=1)


def linked_groups(size, groups=2, dim=64):
    """Groups at cosine 0.99 inside and about 0.93 to each other."""
    rng = np.random.default_rng(3)
    shared, *own = np.linalg.qr(rng.standard_normal((dim, groups + 1)))[0].T
    rows = []
    for g in range(groups):
        for i in range(size):
            noise = rng.standard_normal(dim)
            v = 0.97 * shared + (1 - 0.97**2) ** 0.5 * own[g] + 0.1005 * noise / np.linalg.norm(noise)
            rows.append((g * size + i, v.tolist()))
    return rows


@pytest.mark.parametrize("size, block", [(20, 256), (60, 16)])
def test_linked_dense_groups_are_one(spark, monkeypatch, size, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows = linked_groups(size)
    expect = plain(rows, 0.9)
    assert min(n for _, n, _, _ in expect) > size and sum(kept for *_, kept in expect) == 1
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == expect


@pytest.mark.parametrize("cell, cells", [(0.15, 2048), (0.3, 3), (0.0, 5)])
def test_bridges_join_groups_that_no_list_joins(spark, monkeypatch, cell, cells):
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "CELLS", cells)
    rows = linked_groups(12, 3) + [(100 + i, v) for i, v in enumerate(np.random.default_rng(4).standard_normal((9, 64)).tolist())] + [(200, [1.0, 0.0]), (201, [1.0, 0.1])]
    nodes = spark.createDataFrame([(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows], "node long, unit array<double>")
    groups = spark.createDataFrame([(i, i // 12 * 12 if i < 36 else i if i < 200 else 200) for i, _ in rows], "node long, root long")
    found = neighbours.bridges(nodes, groups, groups.selectExpr("node as src"), 0.9).collect()
    unit = {r.node: np.array(r.unit) for r in nodes.collect()}
    assert all(unit[r.src] @ unit[r.dst] >= 0.9 and max(r.src, r.dst) < 36 for r in found)
    assert len({frozenset((r.src // 12, r.dst // 12)) for r in found}) >= 2
