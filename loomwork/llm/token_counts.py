"""Token counts through a digest cache: only texts whose digest the cache lacks are encoded.

The cache is a Parquet table ``(tokenizer, digest, n_tokens)``. A document's content digest is the
SHA-256 of its text with runs of ASCII white space made one space (done only for tokenizers whose
own normaliser does the same, so the count cannot change); the tokenizer's is that of its file.
Distinct missing digests are found by an aggregate that keeps one text each (copies meet map-side
first), encoded, appended, and joined back on the digest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.scratch import scratch_path, shuffles_freed, stored

SCHEMA = "tokenizer string, digest binary, n_tokens long"
MEMO_WORDS = 400_000
"""Words whose counts a Python worker keeps; beyond it the memory is emptied, counts stay exact."""

_SPACES = " \t\n\x0b\x0c\r"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


@lru_cache(4)
def drops_white_space(path: str) -> bool:
    """Whether the tokenizer's normaliser makes white space one space and its pre-tokenizer then drops it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    squeezes = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
    first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    removed = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in first["pattern"].get("Regex", "")
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c in _SPACES for c in t["content"]) for t in spec.get("added_tokens", []))
    return bool(squeezes and removed and plain)


class Counter:
    """Counts tokens of texts as the library does. Where white space always parts tokens, words are counted once and remembered."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.by_word, self.memo, self.memo_words = drops_white_space(path), {}, memo_words
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]

    def count(self, text: str) -> int:
        if not self.by_word:
            return self.encode([text])[0]
        words, memo = text.split(" "), self.memo
        try:
            return sum(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > self.memo_words:
                memo.clear()
            missing = list({w for w in words if w not in memo})
            for at in range(0, len(missing), 50_000):
                some = missing[at : at + 50_000]
                memo.update(zip(some, self.encode(some)))
            return sum(map(memo.__getitem__, words))


@lru_cache(2)
def _counter(path: str) -> Counter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter(path)


def count_tokens(documents: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document; appends the misses to the cache.

    A null text counts as empty (0 tokens). Repeated rows, equal texts and repeated ids each keep
    their row. Other columns are not read. The cache may be absent or empty; a digest in it twice
    counts once. Two runs at once may append the same digest: the counts agree, so results do not change.
    """
    spark = documents.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.regexp_replace(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")), r"\A \z", "") if drops_white_space(tokenizer_path) else text
    digest = F.unhex(F.sha2(content, 256))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            counts = pa.array([counter.count(t) for t in batch.column("content").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], names=["digest", "n_tokens"])

    empty = spark.createDataFrame([], SCHEMA)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    cached = (spark.read.schema(SCHEMA).parquet(cache_path) if there else empty).where(F.col("tokenizer") == version)
    texts = documents.select(digest.alias("digest"), content.alias("content"))
    if there:  # digests ask the cache first; written, so that a short list of misses is sent to the texts and no text it has is shuffled
        missing = stored(documents.select(digest.alias("digest")).distinct().join(cached.select("digest"), "digest", "left_anti"), "missing-digests")
        texts = texts.join(missing, "digest", "left_semi")
    misses = texts.groupBy("digest").agg(F.first("content").alias("content"))
    with shuffles_freed(spark):
        misses.mapInArrow(encode, "digest binary, n_tokens long").select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = spark.read.schema(SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark) -> str:
    return scratch_path(spark, "token-cache")
