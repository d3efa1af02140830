"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

All pieces of one length are alike to the packer, so what it needs of the corpus is one counter for each length up to
the capacity. For each bin it takes the longest piece left and, by subset sums kept as bits of an integer, the
combination of available lengths that fills the rest best; the combination is used as often as the counters allow and
then removed. The result is a plan of at most a few thousand rows, whatever the corpus; pieces find their place in it
by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.llm.shared import Scratch, map_arrow

CAPACITY, END_ID = 2048, 0
TOKENIZER = "byte_bpe_50k.json"
#: Distinct blank-separated strings whose ids a worker remembers, and the longest remembered.
REMEMBERED, LONGEST = 400_000, 48
#: Pieces of one length that are ranked in one task, on average.
RANKED = 50_000

_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to those of the tokenizer file.

    The tokenizer cuts every text before each single blank that stands between two other characters, and merges never
    cross a cut. So a text is split at blanks and the ids of each part, remembered from earlier texts, are joined.
    Texts with other white space next to a blank, or with a special token's name, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._ranks(path)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _ranks(self, path: str):
        """The same vocabulary with the same merges, read from the tokenizer file for a faster library."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: b for b, c in byte_names().items()}
        names = {"".join(m) if isinstance(m, list) else m.replace(" ", ""): i for i, m in enumerate(model["merges"])}
        single = {t: i for t, i in model["vocab"].items() if len(t) == 1 and t in byte}
        order = sorted(single, key=lambda t: single[t]) + sorted(names, key=names.get)
        ranks = {bytes(byte[c] for c in t): k for k, t in enumerate(order)}
        if len(ranks) != len(order):
            raise ValueError(f"{path}: merges give one token twice")
        self.ids = np.array([model["vocab"][t] for t in order], "<u4")
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        return self.ids[self.fast.encode_ordinary(text)].tobytes() if text else b""

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        parts = text.split(" ")
        found = list(map(self.later.get, parts))
        found[0] = self.first.get(parts[0])
        for i in (i for i, x in enumerate(found) if x is None):
            part = parts[i]
            if not part or part[0].isspace() or part[-1].isspace():
                return self.whole(text)
            known = self.later if i else self.first
            if (ids := known.get(part)) is None:
                ids = self.plain(f" {part}" if i else part)
                if len(part) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = ids
            found[i] = ids
        return b"".join(found)


def byte_names() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, carry_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): ids of each document and an end id, cut where longer than capacity.

    The first piece is the shorter one. A null text is empty and gives one piece with the end id alone.
    """
    where = path

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(where or tokenizer_path())
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            bodies: list[bytes] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                at, piece, size = 0, 0, (total - 1) % capacity + 1
                while at < total:
                    body = ids[4 * at : 4 * (at + size)]
                    out.append((doc, piece, at, size, zlib.crc32(body)))
                    if carry_ids:
                        bodies.append(body)
                    at, piece, size = at + size, piece + 1, capacity
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if out:
                yield pa.RecordBatch.from_arrays(columns + [pa.array(bodies, pa.binary())] * carry_ids, names + ["ids"] * carry_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * carry_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, cut, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, with how often each, that fill `room` best and exceed it nowhere; longer lengths are taken first."""
    full, mask = 1 << room, (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left and not reach & full:
            take = min(chunk, left)
            steps.append((reach, length, take))
            reach |= reach << take * length & mask
            left, chunk = left - take, chunk * 2
        if reach & full:
            break
    sum_, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> sum_ & 1:
            used[length] = used.get(length, 0) + take
            sum_ -= take * length
    return used


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, per bin, first bin, offset in the bin), in order of first rank for each length."""
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append((length, used[length], n * times, n, bins, offset))
            offset += n * length
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    return rows


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must be a stored table: it is read three times."""
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = np.array(plan_bins(counts, capacity), np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shares = max(1, -(-max(counts.values(), default=0) // RANKED))
    salted = cut.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)).cast("int"))
    sizes = salted.groupBy("length", "share").count()
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("length").alias("of"), F.col("share").alias("at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(bases, (F.col("of") == F.col("length")) & (F.col("at") == F.col("share"))).withColumn("rank", F.col("rank") + F.col("base")).drop("share", "of", "at", "base")
    held = spark.sparkContext.broadcast(plan)  # one row for each length of each combination
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        order = plan[:, 0] * (1 << 44) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = plan[np.searchsorted(order, length * (1 << 44) + rank, side="right") - 1]
            turn, place = np.divmod(rank - row[:, 1], np.maximum(row[:, 3], 1))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 4] + turn), pa.array(row[:, 5] + place * length)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*names).schema)
    return map_arrow(ranked, place, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, carry_ids: bool = False) -> DataFrame:
    """Pieces of all rows of `docs` with their place in sequences of at most `capacity` tokens, gapless from 0.

    Repeated rows and ids are packed as often as they come; a null doc_id stays null. An empty table packs to nothing.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return placed(scratch.keep(pieces(docs, path, capacity, carry_ids), "pieces"), capacity)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """`pack` for `documents`, a row for each piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
