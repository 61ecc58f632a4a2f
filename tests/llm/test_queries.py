"""The pN_ queries: SQL where there is any, brute force where there is none."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from nearfold.llm import queries as Q
from nearfold.llm.tokens import count, default_path

from ..oracle import connect, same
from .test_texts import brute_leaks

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = connect(FOLDER)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(name, spark, duck):
    same(Q.queries()[name], Q.oracle_sql()[name], spark, FOLDER, duck)


COLUMNS = {
    "p1_found": ["shard", "id_a", "id_b"], "p2_found": ["id_a", "id_b"], "p3_found": ["index_tag", "search_l", "week_no", "metric"], "p4_found": ["query_id", "id"],
    "p5_found": ["cluster_id", "id"], "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs_without_repeated_rows(name, spark):
    df = Q.queries()[name](spark, FOLDER)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    if name in COLUMNS:
        assert len(rows) == len(set(map(tuple, rows)))


def usable():
    t = pq.read_table(f"{FOLDER}/partition_rows.parquet").to_pandas().drop_duplicates("id")
    ok = [v is not None and len(v) == 64 and not np.isnan(np.array(v, float)).any() and np.any(np.array(v, float) != 0) for v in t.cur_row]
    t = t[ok].sort_values("id")
    return t.id.to_numpy(), np.stack(t.cur_row.to_list()).astype(float)


def test_neighbours(spark):
    ids, x = usable()
    want = set()
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        want |= {tuple(sorted((int(ids[i]), int(ids[j])))) for j in np.lexsort((ids, d))[:5]}
    got = {tuple(r) for r in Q.p2_found(spark, FOLDER).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)


def test_clusters(spark):
    from .test_vectors import brute_components

    ids, x = usable()
    held = set(r[0] for r in Q._held_rows(spark, FOLDER).select("id").collect())
    keep = np.isin(ids, list(held))
    assert {tuple(r) for r in Q.p5_found(spark, FOLDER).collect()} == brute_components(x[keep], ids[keep], 0.4)


def test_texts(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pandas()
    items = pq.read_table(f"{FOLDER}/eval_items.parquet").to_pandas()
    want = brute_leaks(zip(docs.doc_id, docs.text), zip(items.item_id, items.text), 12)
    assert {tuple(r) for r in Q.p6_found(spark, FOLDER).collect()} == want
    n = docs.text.map(lambda t: count(t, default_path()))
    assert {r.doc_id for r in Q.p8_found(spark, FOLDER).collect()} == set(docs.doc_id[n > 1024])
    t = pq.read_table(f"{FOLDER}/mix_targets.parquet").to_pandas()
    size = {s: int(n[docs.source == s].sum()) for s in t.source}
    total = sum(size.values())
    assert {r.source for r in Q.p7_found(spark, FOLDER).collect()} == {r.source for r in t.itertuples() if r.max_repeats * size[r.source] < r.target_share * total}
