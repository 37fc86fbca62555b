"""Benchmark decontamination by training suffix arrays.

Every Arrow batch of training documents is a shard. A shard's words are ranked against the test vocabulary, its
suffixes are sorted (only those that begin like some test suffix can ever match one, so the array is sparse), and every
test suffix is binary-searched in it. Matches are verbatim runs of at least a window (13 words, or a whole shorter item);
along a diagonal they join into the longest match, reported with its location. No shuffle: the shards are independent.

The test items are read in blocks of bounded size, each a few flat arrays that are broadcast. One pass over the documents
searches all of them, a batch of documents against a block at a time, and lets go of a block before it loads the next where
there are several. So neither the driver nor a task ever holds more than a block of test text, however large the test set is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: A-Z to a-z, then everything but digits, letters and non-ASCII bytes to a space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
OUTPUTS = ("n_words", "n_hit", "n_items", "items", "items_sha256", "matches", "contaminated")
MATCH = T.StructType([T.StructField("item", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])


def text_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


class TestBlock:
    """The suffixes of one block of test items: sorted windows of word ranks, and which items have each and where."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window, self.rank = window, {}
        self.items = sorted({item for item, _ in items})
        place = {item: k for k, item in enumerate(self.items)}
        rows, owners, starts = [], [], []
        for item, text in items:
            ids = np.array([self.rank.setdefault(w, len(self.rank) + 1) for w in text_words(text)], dtype=np.uint32)
            if not len(ids):
                continue
            padded = np.concatenate([ids, np.zeros(max(0, window - len(ids)), np.uint32)])
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, window))
            owners.append(np.full(len(rows[-1]), place[item], np.int32))
            starts.append(np.arange(len(rows[-1]), dtype=np.int32))
        matrix = np.concatenate(rows) if rows else np.zeros((0, window), np.uint32)
        low, of = np.unique(_keys(matrix.astype(">u4")), return_inverse=True)
        self.low = low.astype(f"S{window * 4}")
        plain = np.frombuffer(self.low.tobytes(), dtype=">u4").reshape(-1, window)
        self.lengths = (plain > 0).sum(axis=1)
        # A whole window matches itself alone; a shorter item all suffixes that begin with it.
        self.short = np.flatnonzero(self.lengths < window)
        high = plain[self.short].copy()
        high[high == 0] = 0xFFFFFFFF
        self.high = _keys(high)
        order = np.argsort(of, kind="stable")
        self.owner = np.concatenate(owners)[order] if rows else np.empty(0, np.int32)
        self.start = np.concatenate(starts)[order] if rows else np.empty(0, np.int32)
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(self.low)))]).astype(np.int64)
        self.least = int(self.lengths.min(initial=window))
        self.gram = min(self.least, 4)
        self.heads = np.unique(_gram_hash([plain[:, j].astype(np.uint64) for j in range(self.gram)])) if len(plain) else np.empty(0, np.uint64)


def _keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of big-endian ranks as byte strings, which compare as the suffixes do."""
    m = np.ascontiguousarray(matrix)
    return m.view(f"S{m.shape[1] * 4}").ravel() if len(m) else np.empty(0, f"S{m.shape[1] * 4}")


def _gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def search(block: TestBlock, begins: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, window, position) of every occurrence of a test window in a shard.

    begins: where each document starts in ranks; ranks: word ranks with a 0 after each document, 0 also for words
    outside the test vocabulary.
    """
    none = np.empty(0, np.int64)
    n, w = len(ranks), block.window
    if not n or not len(block.low):
        return none, none, none
    zero = np.flatnonzero(ranks == 0)
    nxt = np.full(n, n, dtype=np.int64)
    if len(zero):
        at = np.searchsorted(zero, np.arange(n))
        nxt = np.where(at < len(zero), zero[np.minimum(at, len(zero) - 1)], n)
    starts = np.flatnonzero(nxt - np.arange(n) >= block.least)
    if not len(starts):
        return none, none, none
    padded = np.concatenate([ranks, np.zeros(w, ranks.dtype)])
    heads = _gram_hash([padded[starts + j].astype(np.uint64) for j in range(block.gram)])
    near = np.minimum(np.searchsorted(block.heads, heads), len(block.heads) - 1)
    starts = starts[block.heads[near] == heads]
    if not len(starts):
        return none, none, none
    keys = _keys(padded[starts[:, None] + np.arange(w)].astype(">u4"))
    order = np.argsort(keys, kind="stable")
    suffixes, keys = starts[order], keys[order]
    first, last = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.low, "right")
    last[block.short] = np.searchsorted(keys, block.high, "right")
    count = np.maximum(last - first, 0)
    window = np.repeat(np.arange(len(count)), count)
    position = suffixes[np.repeat(first, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))]
    return np.searchsorted(begins, position, "right") - 1, window, position


def _scan(blocks: list, keep: list[str], percent: int):
    """(text and the columns to keep) to these and OUTPUTS, as a function of Arrow batches; the text is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            found: list[list[tuple]] = [[] for _ in range(len(texts))]
            lengths: list[int] = []
            for sent in blocks:
                lengths = _search_batch(sent.value, texts, found)
                if len(blocks) > 1:
                    del sent._value  # it is on the executor's disk; the next use reads it again
            out = [_digest(n, own, percent) for n, own in zip(lengths, found, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(ARROW_MATCH), pa.bool_())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], *[pa.array([o[j] for o in out], kinds[j]) for j in range(len(kinds))]], [*keep, *OUTPUTS])

    return run


def _search_batch(b: TestBlock, texts: pa.Array, found: list[list[tuple]]) -> list[int]:
    """The numbers of words of the texts; the matches with one block are added to found."""
    get = b.rank.get
    parts, begins, lengths, at = [], [], [], 0
    for text in texts:
        split = text_words(text.as_py())
        lengths.append(len(split))
        begins.append(at)
        ids = np.zeros(len(split) + 1, np.int32)
        if split:
            ids[:-1] = [get(x, 0) for x in split]
        parts.append(ids)
        at += len(ids)
    ranks, offsets = np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(begins, np.int64)
    doc, window, position = search(b, offsets, ranks)
    if len(doc):
        by = np.lexsort((window, position, doc))
        for group in np.split(by, np.flatnonzero(np.diff(doc[by])) + 1):
            d = int(doc[group[0]])
            found[d] += _matches(b, window[group], position[group] - offsets[d])
    return lengths


ARROW_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])


def _matches(b: TestBlock, windows: np.ndarray, positions: np.ndarray) -> list[tuple[str, int, int, int]]:
    """Longest verbatim matches of one document: occurrences that follow each other in the item and in the document join."""
    open_: dict[tuple[int, int], list[int]] = {}
    done = []
    for w, p in zip(windows.tolist(), positions.tolist(), strict=True):
        n = int(b.lengths[w])
        for k in range(b.offsets[w], b.offsets[w + 1]):
            owner, at = int(b.owner[k]), int(b.start[k])
            run = open_.get((owner, p - at))
            if run and run[1] + run[2] >= p + n - 1 and run[1] + run[2] < p + n:
                run[2] += 1
            else:
                open_[(owner, p - at)] = run = [at, p, n]
                done.append((owner, run))
    return [(b.items[owner], *run) for owner, run in done]


def _digest(n_words: int, matches: list[tuple[str, int, int, int]], percent: int) -> tuple:
    hit = 0
    end = -1
    for a, z in sorted((word, word + n) for _, _, word, n in matches):
        hit += max(0, z - max(a, end))
        end = max(end, z)
    items = sorted({m[0] for m in matches})
    sha = hashlib.sha256(",".join(items).encode()).hexdigest()
    rows = [dict(zip(("item", "item_word", "word", "n"), m, strict=True)) for m in matches]
    return n_words, hit, len(items), items, sha, rows, hit > 0 and 100 * hit >= percent * n_words


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    held, size = [], 0
    for item, text in benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`")).toLocalIterator():
        if held and size + len(text or "") > block_bytes:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text or "")
    yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, percent: int = 5, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items, items_sha256, matches (longest verbatim matches and where they are) and
    contaminated (n_hit > 0 and at least `percent` % of the words).

    keep: the input columns to return (all by default). Null and empty texts have no words and match nothing. Rows of
    the test table with the same item_id are one item; a null item_id counts as the item ''. Repeated document rows are
    each judged. Empty tables give no rows, or no hits. Input columns named like an output are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUTPUTS]
    text = "__cg_text"
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    kept = [f for f in df.schema.fields if f.name != text]
    outputs = [T.StructField(n, t) for n, t in zip(OUTPUTS, (T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.StringType(), T.ArrayType(MATCH), T.BooleanType()), strict=True)]
    blocks = [spark.sparkContext.broadcast(TestBlock(items, window)) for items in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    for block in blocks:
        if hasattr(block, "_value"):
            del block._value  # the driver needs it no more
    return df.mapInArrow(_scan(blocks, keep, percent), T.StructType(kept + outputs))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones, columns as they were."""
    found = find_contamination(docs, benchmark, **options)
    columns = without(docs, *OUTPUTS).columns
    clash = [c for c in docs.columns if c not in columns]
    if clash:  # keep the input's own columns of those names
        renamed = docs.select(*[F.col(f"`{c}`").alias(f"__in_{c}" if c in clash else c) for c in docs.columns])
        found = find_contamination(renamed, benchmark, **options)
        return found.where(~F.col("contaminated")).select(*[F.col(f"`__in_{c}`" if c in clash else f"`{c}`").alias(c) for c in docs.columns])
    return found.where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
