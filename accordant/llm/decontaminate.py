"""Benchmark decontamination with an FM-index for each training shard.

A shard is an Arrow batch of documents. All its words are numbered by a vocabulary of its own, and the FM-index is built
over these numbers (suffix array by prefix doubling, BWT, wavelet matrix with counted bits, sampled suffix positions). All
windows of the benchmark whose words the shard has are searched backwards together, a word at a time, and the rows of
the intervals found are walked to sampled positions. Spans of one document are then merged.

The benchmark reaches executors as one array of word numbers and its vocabulary; windows are views of that array and are
searched in blocks, so memory grows with the benchmark's words alone, not with its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import map_arrow

WINDOW = 10
#: Every so many text positions one is kept for locating.
SAMPLED = 16
#: Characters of benchmark texts that are sent to executors at once; a larger benchmark is searched in several passes.
PASS_CHARS = 32_000_000
#: Words that one index covers; a batch with more gets several. Windows searched, and rows located, at once.
SHARD_WORDS, BLOCK = 250_000, 100_000

#: Bytes: letters lower-cased, digits and all beyond ASCII kept, others blank.
FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one row of bits for each binary digit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.digits = max(1, int(top).bit_length())
        self.counts, self.zeros = [], []
        for digit in reversed(range(self.digits)):
            bits = symbols >> digit & 1
            self.counts.append(np.concatenate(([0], np.cumsum(bits, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(bits) - int(self.counts[-1][-1]))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each pair: how often the symbol stands before the position. Includes those of lesser start, taken off at the end."""
        low = np.zeros_like(at)
        for level, digit in enumerate(reversed(range(self.digits))):
            ones_at, ones_low = self.counts[level][at], self.counts[level][low]
            one = (symbol >> digit & 1).astype(bool)
            at = np.where(one, self.zeros[level] + ones_at, at - ones_at)
            low = np.where(one, self.zeros[level] + ones_low, low - ones_low)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level in range(self.digits):
            counts = self.counts[level]
            one = counts[at + 1] - counts[at]
            out = out * 2 + one
            at = np.where(one == 1, self.zeros[level] + counts[at], at - counts[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of suffixes in order; text ends with a symbol less than all others.

    Suffixes are ordered by twice as many symbols each round; those that are alone by then aren't looked at again.
    """
    order = np.argsort(text, kind="stable")
    first = np.concatenate(([True], text[order][1:] != text[order][:-1]))
    rank = np.empty(len(text), np.int64)  # the place of the first suffix that can't be told from it
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(text)), 0))
    step = 1
    while True:
        last = np.concatenate((first[1:], [True]))
        open_ = np.flatnonzero(~(first & last))
        if not len(open_):
            return order
        at = order[open_]
        after = at + step
        second = np.where(after < len(text), rank[np.minimum(after, len(text) - 1)] + 1, 0)
        group = rank[at]
        by = np.lexsort((second, group))
        order[open_], group, second = at[by], group[by], second[by]
        first[open_] = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        rank[order[open_]] = np.maximum.accumulate(np.where(first[open_], open_, 0))
        step *= 2


class FMIndex:
    """Over a sequence of symbols from 1 to top; 0 is added as its end."""

    def __init__(self, symbols: np.ndarray, top: int):
        text = np.append(symbols.astype(np.int64), 0)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt, top)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.is_sampled = order % SAMPLED == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(self.is_sampled)))
        self.samples = order[self.is_sampled]
        self.size = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of rows [low, high) for phrases of one length, one in each row; searched from the last symbol on."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for symbol in phrases.T[::-1]:
            s = symbol[live]
            low[live] = self.before[s] + self.wavelet.rank(s, low[live])
            high[live] = self.before[s] + self.wavelet.rank(s, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back through the text to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        which = np.arange(len(rows))
        while len(which):
            found = self.is_sampled[rows]
            out[which[found]] = self.samples[self.sample_rank[rows[found]]] + steps
            rows, which = rows[~found], which[~found]
            symbol = self.wavelet.access(rows)
            rows = self.before[symbol] + self.wavelet.rank(symbol, rows)
            steps += 1
        return out


class Phrases:
    """Benchmark items laid end to end as numbers of their words, and the windows in them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        number: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        parts = []
        for _, text in items:
            words = words_of(text)
            parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        sizes = np.array([len(p) for p in parts], np.int64)
        self.vocabulary = list(number)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        starts = np.cumsum(sizes) - sizes
        self.starts: dict[int, np.ndarray] = {}  # by length of window
        self.owners: dict[int, np.ndarray] = {}
        for n in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
            own = np.flatnonzero((sizes >= n) if n == window else (sizes == n))
            many = sizes[own] - n + 1
            self.owners[n] = np.repeat(own, many).astype(np.int32)
            self.starts[n] = np.repeat(starts[own] - np.cumsum(many) + many, many) + np.arange(many.sum())

    def found(self, number: dict[bytes, int], index: FMIndex) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each length the windows that the index has, one of equal ones: (length, owners of each found, which, position).

        number: the shard's vocabulary, from 2 on. which: the window, from 0 on, of each position; owners: pairs (window, item).
        """
        known = np.fromiter((number.get(w, 0) for w in self.vocabulary), np.int64, len(self.vocabulary))
        words = known[self.words] if len(self.words) else np.zeros(0, np.int64)
        missing = np.concatenate(([0], np.cumsum(words == 0)))
        for n, starts in self.starts.items():
            live = np.flatnonzero(missing[starts + n] == missing[starts])
            for at in range(0, len(live), BLOCK):
                mine = live[at : at + BLOCK]
                low, high = index.search(words[starts[mine][:, None] + np.arange(n)])
                hit = np.flatnonzero(low < high)
                if not len(hit):
                    continue
                low, which = np.unique(low[hit], return_inverse=True)  # windows with one interval are equal
                ends = np.zeros(len(low), np.int64)
                ends[which] = high[hit]
                owners = np.unique(np.stack((which, self.owners[n][mine[hit]])), axis=1)
                count = ends - low
                each = np.repeat(np.arange(len(low)), count)
                rows = np.repeat(low, count) + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                yield n, owners, each, np.concatenate([index.locate(rows[k : k + BLOCK]) for k in range(0, len(rows), BLOCK)])


def shards(texts: Iterable[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of texts in lists of at most SHARD_WORDS words together, or of one text that has more alone."""
    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = words_of(text)
        if held and size + len(words) > SHARD_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words) + 1
    if held:
        yield held


def search_shard(texts: list[list[bytes]], phrases: Phrases) -> Iterator[tuple[list[tuple[int, int]], set[int]]]:
    """For each text, given by its words: merged spans of words that windows cover, and numbers of the items they are from."""
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)), 2)}
    parts, starts, at = [], [], 0
    for words in texts:
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        parts.append(np.ones(1, np.int64))  # between two texts
        starts.append(at)
        at += len(words) + 1
    starts = np.array(starts, np.int64)
    index = FMIndex(np.concatenate(parts), len(number) + 1)
    edge = np.zeros(at + 1, np.int64)
    items: list[set[int]] = [set() for _ in texts]
    for n, (window, item), which, position in phrases.found(number, index):
        np.add.at(edge, position, 1)
        np.add.at(edge, position + n, -1)
        doc = np.searchsorted(starts, position, side="right") - 1
        first = np.searchsorted(window, np.arange(window[-1] + 2))
        for d, w in zip(*np.unique(np.stack((doc, which)), axis=1).tolist()):
            items[d].update(item[first[w] : first[w + 1]].tolist())
    covered = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).view(np.int8), [0]))))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for start, end in zip(covered[::2].tolist(), covered[1::2].tolist()):
        d = int(np.searchsorted(starts, start, side="right")) - 1
        spans[d].append((start - int(starts[d]), end - int(starts[d])))
    yield from zip(spans, items)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _pass(docs: DataFrame, items: list[tuple[str, bytes]], window: int, carry: bool, cut: bool) -> DataFrame:
    """Adds what these items hit to n_words, spans and items; the text goes on if `carry`, without its spans if `cut`."""
    held = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))  # of at most PASS_CHARS characters

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = held.value
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[(s["start"], s["end"]) for s in x or []] for x in batch.column(3).to_pylist()]
            found = [set(x or []) for x in batch.column(4).to_pylist()]
            sizes: list[int] = []
            for texts in shards(text.as_py() for text in batch.column(1)):
                for d, (more, items) in enumerate(search_shard(texts, phrases), len(sizes)):
                    spans[d] += more
                    found[d].update(phrases.items[i] for i in items)
                sizes += map(len, texts)
            merged = [merge_spans(x) for x in spans]
            spans = [[{"start": a, "end": b} for a, b in x] for x in merged]
            text = batch.column(1) if carry else pa.nulls(len(sizes), pa.binary())
            if cut and any(merged):
                text = pa.array([cut_spans(x.as_py(), m) if m else x.as_py() for x, m in zip(text, merged)], pa.binary())
            columns = [batch.column(0), text, pa.array(sizes, pa.int64()), pa.array(spans, kinds), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "n_words", "spans", "items"])

    fields = docs.schema["row"].dataType.simpleString()
    return map_arrow(docs, search, f"row {fields}, text binary, n_words long, spans array<struct<start: int, end: int>>, items array<string>")


def searched(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int, carry: bool, cut: bool = False) -> DataFrame:
    """(row, text, n_words, spans, items): row holds the columns `keep` of docs, spans are merged, items are sorted ids.

    Spans count words, end exclusive. With `carry` the text is there as UTF-8, with `cut` without its spans, else null. Null or empty texts have no
    words. An item without words is in no document, ids that repeat count once, and a null item_id is not searched for.
    With an empty benchmark nothing is hit. The benchmark reaches executors in passes of at most PASS_CHARS characters,
    each of which adds to the row.
    """
    known = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // PASS_CHARS))
    numbered = known.withColumn("pass", F.pmod(F.xxhash64("item", "text"), F.lit(passes)))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("binary").alias("text"))
    out = out.selectExpr("row", "text", "cast(null as long) n_words", "cast(null as array<struct<start: int, end: int>>) spans", "cast(null as array<string>) items")
    for k in range(passes):
        items = [(r["item"], bytes(r["text"])) for r in numbered.where(F.col("pass") == k).collect()]
        out = _pass(out, items, window, carry or k < passes - 1, cut and k == passes - 1)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items) for each row, repeated rows and null ids included."""
    return searched(docs, benchmark, ["doc_id"], window, False).select("row.doc_id", "n_words", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def cut_spans(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of `spans` and what stands between them."""
    letters = np.frombuffer(body.translate(FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], letters.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for first, last in spans:
        out.append(body[at : starts[first]])
        at = int(ends[last - 1])
    return b"".join([*out, body[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with its columns; of contaminated texts the hit words are gone, and what stood between them.

    Texts without a hit, nulls included, are as before. All other columns go through unread.
    """
    others = [c for c in docs.columns if c != "text"]
    out = searched(docs, benchmark, others, window, True, True)
    return out.select(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row for each row of `documents`: its words, those that windows of `benchmark` hit, and a digest of the items hit."""
    return digest(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
