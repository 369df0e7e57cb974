import glob
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from tessella.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_files_read_back_in_order(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choices("abc de\n", k=r.randint(0, 4000)))) for i in range(300)]
    r.shuffle(rows)
    rows += [(7, None), (7, None), (None, "x y"), (400, "long " * 30000)]
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, start int")
    path = token_files.write_tokens(df, PATH, 2, partitions=5)
    got = sorted(token_files.open_tokens(spark, path).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted((x[0] for x in rows), key=lambda v: -1 if v is None else v)
    library, text, at = Tokenizer.from_file(PATH), {}, 0
    for i, t in rows:
        text.setdefault(i, []).append(t or "")
    for x in got:
        assert x.start == at and x.n_tokens == len(x.ids)
        at += x.n_tokens
        assert x.ids in [library.encode(t, add_special_tokens=False).ids + [2] for t in text[x.doc_id]]
    assert [x.doc_id for x in token_files.read_slice(spark, path, 20, 22).orderBy("doc_id").collect()] == [20, 21, 22]
    meta = [pq.ParquetFile(f) for f in glob.glob(f"{path}/*.parquet")]
    for f in meta:
        column = f.metadata.row_group(0).column(f.metadata.num_columns - 1)
        assert any("DICTIONARY" in e for e in column.encodings) and column.has_offset_index
        assert "DELTA_BINARY_PACKED" in f.metadata.row_group(0).column(2).encodings


def test_no_documents_and_no_end_id(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.open_tokens(spark, token_files.write_tokens(df, PATH, 2)).count() == 0
    one = spark.createDataFrame([(1, "")], "doc_id long, text string")
    row = token_files.open_tokens(spark, token_files.write_tokens(one, PATH, None)).first()
    assert row.n_tokens == 0 and np.asarray(row.ids).size == 0 and row.start == 0
