import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholarlake.llm import token_file as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRUTH = Tokenizer.from_file(PATH)


def test_ids_are_the_librarys():
    texts = ["", "Hello, world. it's  fine\n\nok", "a <|endoftext|> b", "<|endoftext|>", "x" * 3000, "é日本 語!!! ??", "one two, three. four*** five", " lead", "trail "]
    assert ids_of(texts) == [TRUTH.encode(x, add_special_tokens=False).ids for x in texts]
    assert ids_of([]) == [] and ids_of([None], 0) == [[0]]


def ids_of(texts, end=None):
    flat, sizes = T.load_tokenizer(PATH).encode(pa.array(texts, pa.string()), end)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from(" \n.,'abcé")), max_size=60), max_size=8))
def test_any_texts(texts):
    assert ids_of(texts) == [TRUTH.encode(x, add_special_tokens=False).ids for x in texts]


def test_file_round_trip(spark, frame, tmp_path):
    rows = [(9, "nine"), (1, None), (5, "five five"), (5, "again five"), (None, "no id"), (7, "word " * 30_000)]
    out = str(tmp_path / "ids")
    T.write_token_ids(frame(rows), out, PATH)
    got = sorted(T.read_token_ids(spark, out).collect(), key=lambda r: r.start)
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = TRUTH.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), ids))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids) for r in got] == want
    crc = T.read_token_ids(spark, out).mapInArrow(T._crc, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    assert {(r.start, r.ids_crc32) for r in crc} == {(s, zlib.crc32(np.array(i, "<u4").tobytes())) for _, s, _, i in want}


def test_filters_reach_the_file(spark, frame, tmp_path):
    out = str(tmp_path / "ids")
    T.write_token_ids(frame([(i, f"text {i}") for i in range(50)]), out, PATH)
    rows = T.read_token_ids(spark, out).where(F.col("doc_id") == 7)
    assert "EqualTo(doc_id,7)" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 1


def test_empty_table(spark, frame, tmp_path):
    out = str(tmp_path / "ids")
    T.write_token_ids(frame([]), out, PATH)
    assert T.read_token_ids(spark, out).collect() == []


def test_file_holds_run_lengths_row_indexes_and_bloom_filters(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setitem(T.OPTIONS, "orc.stripe.size", "20000")
    monkeypatch.setitem(T.OPTIONS, "orc.stripe.row.count", "2000")
    out = str(tmp_path / "ids")
    T.write_token_ids(frame([(i, f"text {i * 7919 % 4001}") for i in range(6000)], extra=False), out, PATH)
    jvm = spark.sparkContext._jvm
    conf, stripes = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for file in sorted(tmp_path.glob("ids/*.orc")):
        path = jvm.org.apache.hadoop.fs.Path(str(file))
        reader = jvm.org.apache.orc.OrcFile.createReader(path, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        for i in range(reader.getStripes().size()):
            footer = rows.readStripeFooter(reader.getStripes().get(i))
            kinds = {(footer.getStreams(k).getColumn(), footer.getStreams(k).getKind().toString()) for k in range(footer.getStreamsCount())}
            assert {(1, "ROW_INDEX"), (1, "BLOOM_FILTER_UTF8"), (4, "ROW_INDEX")} <= kinds and (4, "BLOOM_FILTER_UTF8") not in kinds
            assert {footer.getColumns(k).getKind().toString() for k in (1, 4, 6)} == {"DIRECT_V2"}  # ids, sizes and tokens
            stripes += 1
        assert reader.getRowIndexStride() == 1000
    assert stripes > len(list(tmp_path.glob("ids/*.orc")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert T.read_token_ids(spark, out).rdd.getNumPartitions() > len(list(tmp_path.glob("ids/*.orc")))  # a file's stripes are read in parallel
        found = T.read_token_ids(spark, out).where("doc_id = 4321")
        assert found.count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
