"""The thin contract queries of the training-data operators."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, pii, quality, sharding, simhash, suffix_dedup, token_files, toxicity
from .common import bound_batches, read
from .labelled import held_out

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_spans(read(spark, sf_dir, "documents"))
    kept = suffix_dedup.kept_bytes(F.col("text"), F.col("n_bytes"), F.col("spans"))
    return out.select(
        "doc_id",
        "n_bytes",
        suffix_dedup.removed_bytes(F.col("spans")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(read(spark, sf_dir, "documents"), TOKENIZER, END_ID)
    bound_batches(spark)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["ids"]
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<i4", copy=False)
            sums = np.fromiter((zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:])), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], b["n_tokens"], pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = token_files.open_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = quality.fit(docs, read(spark, sf_dir, "labels"))
    out = quality.with_quality(docs.select("doc_id", "text"), trees, out="q")
    return out.select("doc_id", *[f"q.{c}" for c in quality.STATS], "q.base_failed", "q.kept", "q.quality")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.with_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii")
    counts = [pii.count(spans, k).alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(pii.named(spans, pii.BASE), 256).alias("base_sha256"), pii.named(spans).alias("spans"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(ids: pd.Series) -> pd.DataFrame:
        model, names = bpe.open_bpe(TOKENIZER), [str(i) for i in range(65536)]
        rows = []
        for x in ids:
            x = np.asarray(x)
            joined = ",".join(map(names.__getitem__, x.tolist()))
            rows.append((len(x), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(model.decode(x).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = bpe.with_token_ids(read(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return out.select("doc_id", digests("token_ids").alias("d")).select("doc_id", "d.*")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", asks), (-7, 1, "assistant", asks)], "conv_id long, turn long, role string, text string"))
    out = chat.conversations(rows)
    turns = F.transform(chat.parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(chat.under_mask(F.col("formatted"), F.col("loss_mask")), "")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id,
  count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(role) + 10 + length(regexp_replace(text, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'))) as bigint) as formatted_chars
from rows group by conv_id
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    out = toxicity.with_toxicity(docs, model, out="score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_token_files": op4_token_files,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe": op8_bpe,
    "op9_chat": op9_chat,
    "op10_toxicity": op10_toxicity,
}
ORACLES: dict[str, str] = {"op9_chat": OP9_SQL}
