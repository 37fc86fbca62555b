"""Language-model scoring by a subword lattice.

The model is a unigram distribution over the pieces of an existing vocabulary. A word's probability is the sum over all its
segmentations, by forward recursion in log space; a text's is the product over its words and one end. Piece weights start
from the uses of each piece in the training words as the vocabulary's library cuts them, and are refitted by
expectation-maximisation over all segmentations; both read the table of distinct training words. The recursion runs once per distinct word of the corpus, not once per occurrence.

Scores reach the documents in two ways that cover all words between them: the HOT most frequent words (a fixed number) are
broadcast and summed while a document is read; its other distinct words join the word table on the word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

HOT = 50_000
EM_ROUNDS = 2
#: Bytes of text that are split at once: many where words are counted, so that few partial counts are handed on.
COUNTED_BYTES, READ_BYTES = 24 << 20, 4 << 20
SPACE_MARK = "▁"
LOG10 = math.log(10)


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]


class Lattice:
    """Natural-log piece weights and the recursions over a word's segmentations.

    An automaton over the pieces gives all that end at a place. What the recursion holds of a prefix is kept for the next word, so
    sorted words cost what they do not share with the one before. Words longer than WINDOW are read in windows, so beside a number
    per character only one window's pieces are held.
    """

    WINDOW = 4096

    def __init__(self, weights: dict[str, float]):
        total = sum(weights.values())
        self.logs = {p: math.log(w / total) for p, w in weights.items()}

    def __getstate__(self):
        return {"logs": self.logs}

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, p in enumerate(self.logs):
            found.add_word(p, (len(p), self.logs[p], k))
        found.make_automaton()
        return found

    @cached_property
    def bytes(self) -> list[float]:
        return [self.logs[f"<0x{b:02X}>"] for b in range(256)]

    @cached_property
    def spelt(self) -> dict[str, tuple[int, float, int]]:
        """Characters that are no piece, which bytes spell, with numbers beyond the pieces'; filled as they are met."""
        return {}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.logs))

    @cached_property
    def held(self) -> list:
        """The last word, the log probability of each of its prefixes, and the (length, number, share) of the pieces that end each."""
        return ["", [0.0], []]

    def ends(self, s: str, low: int, high: int) -> list[list[tuple]]:
        """For each character in [low, high) the (length, log weight, number) of the pieces that end with it; numbers go by logs."""
        into: list[list] = [[] for _ in range(high - low)]
        for e, found in self.automaton.iter(s, max(0, low - self.longest + 1), high):
            if e >= low:
                into[e - low].append(found)
        logs, spelt = self.logs, self.spelt
        for k in range(low, high):
            c = s[k]
            if c not in logs:
                if c not in spelt:
                    spelt[c] = (1, sum([self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]), len(logs) + len(spelt))
                into[k - low].append(spelt[c])
        return into

    @staticmethod
    def forward(a: list[float], into: list[list[tuple]], paths: list | None) -> None:
        """Add to a, which holds the log probabilities of the prefixes before into's characters (the last longest at least), those up to
        each of them; to paths the length, the number and the part in it of each piece that ends there."""
        j = len(a)
        for ends in into:
            if len(ends) == 1:
                n, w, k = ends[0]
                a.append(a[j - n] + w)
                if paths is not None:
                    paths.append([(n, k, 1.0)])
            else:
                terms = [a[j - n] + w for n, w, _ in ends]
                top = max(terms)
                parts = [exp(t - top) for t in terms]
                total = sum(parts)
                a.append(top + log(total))
                if paths is not None:
                    paths.append([(end[0], end[2], x / total) for end, x in zip(ends, parts)])  # noqa: B905
            j += 1

    def read(self, s: str, with_paths: bool) -> list:
        """held, brought from the last word to this one."""
        held = self.held
        before, a, paths = held
        k, most = 0, min(len(before), len(s), len(paths) if with_paths else len(s))
        while k < most and before[k] == s[k]:
            k += 1
        del a[k + 1 :], paths[k:]
        self.forward(a, self.ends(s, k, len(s)), paths if with_paths else None)
        held[0] = s
        return held

    @staticmethod
    def back(paths: list, gain: list[float], low: int, uses: list[float]) -> None:
        """From the last of the characters after low backwards: gain[j] is how much of the whole passes j, handed on by shares."""
        for j in range(low + len(paths), low, -1):
            here = gain[j]
            if here:
                for size, number, share in paths[j - low - 1]:
                    p = here * share
                    gain[j - size] += p
                    uses[number] += p

    def expect_all(self, s: str, count: float, uses: list[float]) -> None:
        """Add count times the expected uses of each piece in s to uses, by number; it grows as characters are spelt."""
        n = len(s)
        gain = [0.0] * n + [count]
        if n <= self.WINDOW:
            paths = self.read(s, True)[2]
            if len(uses) < len(self.logs) + len(self.spelt):
                uses.extend([0.0] * (len(self.logs) + len(self.spelt) - len(uses)))
            self.back(paths, gain, 0, uses)
            return
        a = [0.0]
        for low in range(0, n, self.WINDOW):
            self.forward(a, self.ends(s, low, min(n, low + self.WINDOW)), None)
        uses.extend([0.0] * (len(self.logs) + len(self.spelt) - len(uses)))
        for low in range((n - 1) // self.WINDOW * self.WINDOW, -1, -self.WINDOW):
            paths: list = []
            self.forward(a[: low + 1], self.ends(s, low, min(n, low + self.WINDOW)), paths)
            self.back(paths, gain, low, uses)

    def by_piece(self, uses: list[float]) -> dict[str, float]:
        """Uses by number as uses by piece, spelt characters as their bytes."""
        found = {p: u for p, u in zip(self.logs, uses, strict=False) if u}
        for c, (_, _, number) in self.spelt.items():
            if number < len(uses) and uses[number]:
                for b in c.encode("utf-8", "surrogatepass"):
                    found[f"<0x{b:02X}>"] = found.get(f"<0x{b:02X}>", 0.0) + uses[number]
        return found

    def expect(self, s: str, count: float, uses: dict) -> None:
        """expect_all() by piece."""
        found: list[float] = []
        self.expect_all(s, count, found)
        for p, u in self.by_piece(found).items():
            uses[p] = uses.get(p, 0.0) + u

    def score(self, s: str) -> float:
        if len(s) <= self.WINDOW:
            return self.read(s, False)[1][-1]
        a = [0.0]
        for low in range(0, len(s), self.WINDOW):
            a = a[-self.longest :]
            self.forward(a, self.ends(s, low, min(len(s), low + self.WINDOW)), None)
        return a[-1]


def _marked(word: bytes) -> str:
    return SPACE_MARK + word.decode("utf-8", "surrogatepass")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(the row of each word, the words) of a batch of texts, A-Z in lower case; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.not_equal(pc.binary_length(words), 0)
    return rows.filter(there).to_numpy(zero_copy_only=False).astype(np.int64), words.filter(there).cast(pa.binary())


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have no more bytes together, a longer text alone: the arrays made of a run are bounded."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths.astype(np.int64)) // most_bytes
    starts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist()]
    for a, z in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        if z > a:
            yield batch.slice(a, z - a)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, held_out) to partial (word, training count, count)."""
    for batch in (part for whole in batches for part in slices(whole, 0, COUNTED_BYTES)):
        rows, words = split_words(batch.column(0))
        held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[rows]
        for part, trains in ((~held, True), (held, False)):
            counts = pc.value_counts(words.filter(pa.array(part)))
            n = counts.field("counts")
            yield pa.RecordBatch.from_arrays([counts.field("values"), n if trains else pa.array(np.zeros(len(n), np.int64)), n], ["word", "c", "total"])


def _expect(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = sent.value
        uses: list[float] = []
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lattice.expect_all(_marked(word), c, uses)
        found = lattice.by_piece(uses)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], ["piece", "uses"])

    return run


def _segment(path: str):
    """(word, c) to uses of pieces, each word cut as the vocabulary's own library cuts it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model, uses = sentencepiece.SentencePieceProcessor(model_file=path), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                cut = model.encode([w.decode("utf-8", "surrogatepass") for w in part.column(0).to_pylist()], num_threads=1)
                for ids, c in zip(cut, part.column(1).to_pylist(), strict=True):
                    for i in ids:
                        uses[i] += c
        yield pa.RecordBatch.from_arrays([pa.array([model.id_to_piece(i) for i in uses], pa.string()), pa.array([float(c) for c in uses.values()], pa.float64())], ["piece", "uses"])

    return run


def _score_words(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = sent.value
        for batch in batches:
            scores = [lattice.score(_marked(w)) / LOG10 for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "lp"])

    return run


def _read_documents(sent):
    """(key, id, text) to a row of sums over hot words for each document, and a row for each other distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, sums, ends = sent.value
        for batch in (part for whole in batches for part in slices(whole, 2, READ_BYTES)):
            n_rows, keys = batch.num_rows, batch.column(0).to_numpy()
            rows, words = split_words(batch.column(2))
            coded = words.dictionary_encode()
            values, width = coded.dictionary, max(1, len(coded.dictionary))
            pairs, tf = np.unique(rows * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            doc, code = pairs // width, pairs % width
            place = pc.fill_null(pc.index_in(values, value_set=hot), -1).to_numpy(zero_copy_only=False)
            at = place[code] if len(code) else np.empty(0, np.int64)
            seen = at >= 0
            # A word never holds a space, so the document's own row joins nothing and its keys spread.
            columns = [batch.column(0), pa.array([b" %d" % k for k in keys.tolist()], pa.binary()), pa.array(np.zeros(n_rows, np.int64)), batch.column(1), pa.array(np.bincount(rows, minlength=n_rows) + 1)]
            for kind, values_of, end in zip((np.int64, np.float64, np.float64), sums, ends, strict=True):
                columns.append(pa.array((end + np.bincount(doc[seen], weights=tf[seen] * values_of[at[seen]], minlength=n_rows)).astype(kind)))
            yield pa.RecordBatch.from_arrays(columns, NAMES)
            rest = ~seen
            n = int(rest.sum())
            if n:
                others = [pa.array(keys[doc[rest]]), values.take(pa.array(code[rest])), pa.array(tf[rest].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*others, *[pa.nulls(n, c.type) for c in columns[3:]]], NAMES)

    return run


NAMES = ["key", "word", "tf", "id", "n", "known", "base", "lp0"]


def fit(word_table: DataFrame, n_train: int, path: str, rounds: int = EM_ROUNDS) -> tuple[Lattice, float]:
    """The lattice fitted to words (word, c) with c > 0, and the log10 probability of an end."""
    pieces = vocabulary(path)
    training = word_table.where("c > 0").select("word", "c")

    def smoothed(found: DataFrame) -> dict[str, float]:
        uses = {r.piece: r.uses for r in found.groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}  # at most the vocabulary
        return {p: uses.get(p, 0.0) + (0.5 if p.startswith("<0x") or len(p) == 1 else 0.01) for p in pieces}

    weights = smoothed(training.mapInArrow(_segment(path), "piece string, uses double"))
    for _ in range(rounds):
        sent = word_table.sparkSession.sparkContext.broadcast(Lattice(weights))
        weights = smoothed(training.mapInArrow(_expect(sent), "piece string, uses double"))
    total = sum(weights.values()) if n_train else 0.0
    end = (n_train + 0.5) / (total + n_train + 0.5) if total else 0.5
    lattice = Lattice(weights)
    share = math.log1p(-end)
    lattice.logs = {p: w + share for p, w in lattice.logs.items()}
    return lattice, math.log10(end)


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, hot: int = HOT) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Training documents are those whose crc32(id as text) mod folds is not held_fold; a null id counts as ''. A null or
    blank text is one end. Without any training document N and V are 0: base scores are 0 and the lattice is
    uniform but for smoothing. Repeated rows are each counted and each scored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % folds == held_fold
    counted = source.select("text", held.alias("held_out")).mapInArrow(_count_words, "word binary, c long, total long")
    counts = counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))
    words = written(counts.sortWithinPartitions("word"), "words")  # neighbours share their beginnings, see Lattice
    n_train = source.where(~held).count()
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = n_words + n_train, distinct + (n_train > 0)
    lattice, end_lp = fit(words, n_train, path)
    scored = written(words.mapInArrow(_score_words(spark.sparkContext.broadcast(lattice)), "word binary, c long, total long, lp double"), "word-scores")
    floor = -math.log10(n + (v + 1))
    top = scored.orderBy(F.desc("total"), "word").limit(hot)
    frequent = top.select("word", "c", "lp").toArrow()
    counts = frequent["c"].to_numpy()
    sums = (counts > 0).astype(np.float64), np.log10(counts + 1.0) + floor, frequent["lp"].to_numpy()
    sent = spark.sparkContext.broadcast((frequent["word"].combine_chunks().cast(pa.binary()), sums, (int(n_train > 0), math.log10(n_train + 1) + floor, end_lp)))
    kind = dict(source.dtypes)["id"]
    rows = source.select(F.monotonically_increasing_id().alias("key"), "id", "text").mapInArrow(_read_documents(sent), f"key long, word binary, tf long, id {kind}, n long, known long, base double, lp0 double")
    joined = rows.join(scored.select("word", "c", "lp"), "word", "left")
    parts = joined.groupBy("key").agg(
        F.max("id").alias("id"),
        F.max("n").alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(F.col("c") > 0, F.col("tf")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + 1) + floor))).alias("base_score"),
        F.sum(F.coalesce("lp0", F.col("tf") * F.col("lp"))).alias("score"),
    )
    return parts.select(F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
