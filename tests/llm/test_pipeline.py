import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from scholarlake.llm import decontaminate as D
from scholarlake.llm import quality as Q
from scholarlake.llm.bpe import bpe_coder, multi_path
from tests.llm.conftest import prose
from tests.llm.test_decontaminate import ITEMS
from tests.llm.test_jaccard_join import edited, shingles
from tests.llm.test_quality import bad, good

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string"


def texts():
    rows = [(i, good(i) + " " + prose(9000 + i, 60)) for i in range(80)]
    rows += [(100 + i, bad(i)) for i in range(40)]
    rows += [(200 + i, rows[i][1]) for i in range(10)]  # copies
    rows += [(300 + i, edited(rows[20 + i][1], i, 1)) for i in range(10)]  # near copies
    rows += [(400 + i, good(700 + i) + " " + ITEMS[i][1]) for i in range(10)]  # leaks
    return rows + [(500, ""), (501, None), (502, good(9) + " " + prose(77, 15_000))]


@pytest.fixture
def sf_dir(spark, tmp_path):
    rows = [(i, t, "en", "src0" if i % 2 else None, len(t or ""), "x") for i, t in texts()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 80), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_equals_a_plain_loop(spark, sf_dir):
    got = {r.doc_id: r for r in P.run(spark, sf_dir).collect()}
    docs = dict(texts())
    ranker = Q.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), Q.learned_from(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    keep = {i: t or "" for i, t in docs.items() if ranker.score(Q.features((t or "").encode())[None, :])[0] >= Q.DECISION}
    last = {}
    for i, t in keep.items():
        last[t] = max(i, last.get(t, i))
    keep = {i: t for i, t in keep.items() if last[t] == i}
    ids = sorted(keep)
    sets, root = {i: shingles(keep[i], 5) for i in ids}, {i: i for i in ids}
    for a in ids:  # least id of a component first
        for b in ids:
            if b < a and sets[a] and sets[b] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root.update({k: min(x, y) for k, v in root.items() if v in (x, y)})
    keep = {i: keep[i] for i in ids if root[i] == i}
    leaks = {r.doc_id for r in D.find_leaks(spark.createDataFrame(list(keep.items()), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert leaks == {400 + i for i in range(10)}
    want = {i: t for i, t in keep.items() if i not in leaks}
    flat, sizes = bpe_coder(*multi_path()).encode(pa.array(list(want.values())))
    assert {i: r.ids for i, r in got.items()} == {i: x.tolist() for i, x in zip(want, np.split(flat, np.cumsum(sizes)[:-1]), strict=True)}
    assert all(r.exact and r.n_tokens == len(r.ids) for r in got.values())


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
