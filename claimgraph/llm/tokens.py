"""Token counts through a digest cache.

Content is normalised (only in a way that cannot change a count), digested, and joined by (content digest,
tokenizer-version digest) to stored counts. Distinct misses are encoded once by the tokenizer's own library and appended to
the cache table, from which every document then gets its count.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_dir, without, written

#: Words in each of the two generations that a Python worker remembers, which bounds its memory.
WORD_MEMORY = 400_000
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
_ENCODERS: dict[str, WordCounter | PieceCounter] = {}


def tokenizer_version(path: str, library_version: str) -> str:
    """Digest of the tokenizer: its file and the library that runs it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library_version.encode()).hexdigest()


class WordCounter:
    """Counts of a `tokenizers` file. Where the file drops white space and never joins across it, a text has the tokens of
    its white-space-separated words, so each distinct word is encoded once; otherwise whole texts are encoded."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would only spin
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            self.by_word = _splits_at_spaces(json.load(f))
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.encode(texts)
        if len(self.young) > WORD_MEMORY:
            # Words met since the last turn stay known, so common ones are never encoded again; the others are forgotten.
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        split = [text.encode("utf-8", "surrogatepass").split() for text in texts]
        missing = []
        for word in {w for found in split for w in found if w not in young}:
            if word in old:
                young[word] = old[word]
            else:
                missing.append(word)
        if missing:
            young.update(zip(missing, self.encode([w.decode("utf-8", "surrogatepass") for w in missing]), strict=True))
        return [sum(map(young.__getitem__, found)) for found in split]


def _splits_at_spaces(spec: dict) -> bool:
    """True if the file's pre-tokenizer drops white space and no special token holds or eats any."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    drops = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and r"[^\s" in steps[0].get("pattern", {}).get("Regex", "")
    plain = all(n.get("type") in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for n in normal.get("normalizers", [normal] if normal else []))
    added = all(not any(x.isspace() for x in a["content"]) and not a["single_word"] for a in spec.get("added_tokens", []))
    return drops and plain and added


class PieceCounter:
    """Counts of a sentencepiece model, whole texts at a time."""

    by_word = False

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


def counter(path: str) -> WordCounter | PieceCounter:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceCounter(path) if path.endswith(".model") else WordCounter(path)
    return _ENCODERS[path]


def library_version(path: str) -> str:
    if path.endswith(".model"):
        import sentencepiece

        return f"sentencepiece {sentencepiece.__version__}"
    import tokenizers

    return f"tokenizers {tokenizers.__version__}"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            counts: list[int] = []
            texts = batch.column(1)
            for at in range(0, len(texts), 64):
                counts += count(texts.slice(at, 64).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def normalised(text, path: str):
    """Content as digested: null is empty; where white space only separates, its runs are one space and its ends go."""
    text = F.coalesce(text, F.lit(""))
    if path.endswith(".json") and counter(path).by_word:
        return F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    return text


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, text_col: str = "text", limit: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with n_bytes, n_tokens and over_limit (n_tokens > limit).

    cache: folder of the cache table, created where it is missing; by default a new one in the shared folder. Only
    distinct normalised contents that the cache lacks for this tokenizer version are encoded. Null texts are empty: 0
    bytes, 0 tokens. Copies and repeated rows share one entry and keep a row each. An empty table gives no rows. Input
    columns named like an output are replaced.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path, library_version(path))
    cache = cache or f"{scratch_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    text = F.col(f"`{text_col}`")
    base = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__n_bytes"), normalised(text, path).alias("__content"))
    base = base.withColumn("__digest", F.unhex(F.substring(F.sha2("__content", 256), 1, 32)))
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache) if _exists(spark, cache) else spark.createDataFrame([], CACHE_SCHEMA)
    hits = stored.where(F.col("tokenizer") == version).select(F.col("digest").alias("__digest"))
    # Copies are dropped before anything else, so that a group of copies of any size costs one row a task.
    distinct = base.select("__digest", "__content").dropDuplicates(["__digest"])
    misses = distinct.join(hits, "__digest", "left_anti").select(F.col("__digest").alias("digest"), F.col("__content").alias("content"))
    counted = misses.mapInArrow(_encode(path), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # A cache that two runs filled at once may hold an entry twice. Written, so that the join below reads it from an exchange
    # of its own and a large group of copies can be split.
    known = written(spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy(F.col("digest").alias("__digest")).agg(F.max("n_tokens").alias("n_tokens")), "known-counts")
    plain = without(base, "n_bytes", "n_tokens", "over_limit", "__content")
    joined = plain.join(known, "__digest", "left")
    return joined.select(*[F.col(f"`{c}`") for c in plain.columns if not c.startswith("__")], F.col("__n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
