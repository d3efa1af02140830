"""SimHash near-duplicates through an inverted index over fingerprint bytes, filtered by counting and then verified.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight bytes, so they share at
least four (position, byte) pairs. The index is not keyed by one pair, which would make postings of a 256th of all
fingerprints, but by triples of pairs: of the 56 triples of positions, 20 suffice to meet every set of four positions.
Posting lists of a triple are walked in numpy; for each pair met the shared bytes are tallied, pairs with fewer than
the guaranteed minimum are left out, and the rest is verified by counting differing bits.

Texts that share four fifths of their shingles differ in too many of 64 bits for any such guarantee. For these the
fingerprint has 256 bits and the index 320 of the 4,960 triples of its 32 bytes; a pair shares eight bytes or more of
them as a rule, so it meets in some posting. What is met there is verified by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.llm.kneser_ney import WordHashes, gram_hash
from accordant.llm.shared import Scratch, connected_components, map_arrow, sent_if_small

SHINGLE, SEED, MAX_BITS, BYTES = 4, 42, 4, 8
#: Fingerprints of a posting that one task compares with each other; longer postings are dealt out as pairs of blocks.
BLOCK = 4096
#: Keys of postings with two rows or more, and documents to drop, that are sent to all tasks at most; beyond that the other side is shuffled.
SENT_KEYS, SENT_IDS = 1_000_000, 500_000
#: Rows that a task gathers before it compares, beyond the posting it is in; keys that a task posts.
CHUNK, POSTED = 100_000, 1_000_000


@dataclass(frozen=True)
class Index:
    """numbers: 64-bit numbers of a fingerprint; triples: of byte positions; pairs share `least` bytes and differ in `most` bits, those in `sure` surely belong together."""

    numbers: int
    triples: tuple[tuple[int, int, int], ...]
    least: int
    most: int
    sure: int


def covering_triples() -> list[tuple[int, ...]]:
    """Triples of byte positions such that any four positions hold one: positions in three rings, a triple lies in one ring or has two in a ring and one in the next."""
    ring = [p % 3 for p in range(BYTES)]

    def belongs(t: tuple[int, ...]) -> bool:
        count = [sum(ring[p] == r for p in t) for r in range(3)]
        return 3 in count or any(count[r] == 2 and count[(r + 1) % 3] == 1 for r in range(3))

    return [t for t in combinations(range(BYTES), 3) if belongs(t)]


def spread_triples(numbers: int, count: int) -> list[tuple[int, ...]]:
    """`count` of all triples of byte positions, which each position is in about as often."""
    rng, out = np.random.default_rng(SEED), {}
    while len(out) < count:
        order = rng.permutation(8 * numbers)
        out |= {tuple(sorted(order[k : k + 3].tolist())): None for k in range(0, 8 * numbers - 2, 3)}
    return list(out)[:count]


EXACT = Index(1, tuple(covering_triples()), BYTES - MAX_BITS, MAX_BITS, MAX_BITS)
#: For shingles of five words: 320 triples of 32 bytes; 58 bits are what 0.8 similar texts differ in and over three deviations, 36 bits a little less than their mean.
WORDS, SIMILARITY = 5, 0.8
SIMILAR = Index(4, tuple(spread_triples(4, 320)), 3, 58, 36)


def fingerprint(text: bytes) -> int:
    """SimHash of one UTF-8 text by 4-word shingles, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        cuts = map(slice, starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())
        count = len(words) - SHINGLE + 1
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, count)
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_in > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the distinct shingles of WORDS words, in order; of all words together where there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    return np.unique(gram_hash([one[k : len(one) - n + 1 + k] for k in range(n)]))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash in four 64-bit numbers of a set of shingles; zero for none."""
    set_in = np.zeros(256, np.int64)
    for at in range(0, len(found), 1 << 14):
        x = found[at : at + (1 << 14), None] + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        set_in += np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 32), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_in > len(found), bitorder="little").view("<i8")


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = np.array([wide_fingerprint(shingles(x.as_py(), hashes)) for x in batch.column(3)], np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(np.ascontiguousarray(c)) for c in found.T)], ["doc_id", "t1", "t2", *(f"fp{k}" for k in range(4))])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(x or b"") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_arrow(texts, _fingerprints, "doc_id long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """For XORs of fingerprints: how many byte positions agree."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return BYTES - np.bitwise_count(((x & low) + low | x) & ~low)


def _unite(root: np.ndarray, a: int, b: int) -> bool:
    while root[a] != a:
        root[a] = root[root[a]]
        a = root[a]
    while root[b] != b:
        root[b] = root[root[b]]
        b = root[b]
    root[max(a, b)] = min(a, b)
    return a != b


def spanning_links(key: np.ndarray, fps: np.ndarray, index: Index = EXACT) -> list[tuple[int, int]]:
    """Rows (i, j) that join what links within index.sure bits join, inside each run of equal keys; fewer than there are rows.

    Compares each row with the one d places on, for d = 1, 2, ... while runs are that long. Links inside what is
    joined already aren't returned, so a group of many near copies gives a tree, not its pairs. Pairs beyond `sure` and
    within `most` bits come too, of each row one with each tree.
    """
    root = np.arange(len(key))
    doubtful: list[np.ndarray] = []
    at, out, d = root.copy(), [], 1
    while len(at):
        at = at[at + d < len(key)]
        at = at[key[at + d] == key[at]]
        x = fps[at] ^ fps[at + d]
        bits = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        met = np.flatnonzero((bits <= index.most) & (shared_bytes(x).sum(axis=1, dtype=np.int64) >= index.least))
        if index.most > index.sure and len(more := met[bits[met] > index.sure]):
            doubtful.append(np.stack((at[more], at[more] + d)))
        linked = at[met[bits[met] <= index.sure]]
        linked = linked[root[linked] != root[linked + d]]
        if len(linked):
            out += [(i, i + d) for i in linked.tolist() if _unite(root, i, i + d)]
            while not np.array_equal(flat := root[root], root):
                root = flat
        d += 1
    if doubtful:
        i, j = np.concatenate(doubtful, axis=1)
        i, j = (x[root[i] != root[j]] for x in (i, j))
        for a, b in ((i, root[j]), (j, root[i])):
            _, first = np.unique(np.stack((a, b)), axis=1, return_index=True)
            out += zip(i[first].tolist(), j[first].tolist())
        out = list(dict.fromkeys(out))
    return out


def _links(index: Index):
    """From rows (k, rep, fp0, ...) in order of k to links (u, v) between reps."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []

        def compared(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
            key, rep, *fps = (np.concatenate(c) for c in zip(*rows))
            found = np.array(spanning_links(key, np.stack(fps, axis=1).view(np.uint64), index), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rep[found[:, 0]]), pa.array(rep[found[:, 1]])], ["u", "v"])

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
            if sum(len(r[0]) for r in kept) + cut >= CHUNK and (cut or kept[-1][0][-1] != rows[0][0]):
                yield compared([*kept, [r[:cut] for r in rows]])
                kept, rows = [], [r[cut:] for r in rows]
            kept.append(rows)
        if kept:
            yield compared(kept)

    return links


def near_links(nodes: DataFrame, scratch: Scratch, index: Index = EXACT) -> DataFrame:
    """Links (u, v) between reps of `nodes` (rep, fp0, ...), whose fps are distinct, that connect what the index meets."""
    fps = [f"fp{k}" for k in range(index.numbers)]
    # the triples are a constant array, so the expression is the same however many there are
    triple = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(p).alias(f"p{i}") for i, p in enumerate(t)]) for n, t in enumerate(index.triples)]))
    byte = lambda p: f"(shiftrightunsigned(get(fps, {p} div 8), 8 * ({p} % 8)) & 255)"
    key = "cast(n as long) << 24 | " + " | ".join(f"{byte(f'p{i}')} << {16 - 8 * i}" for i in range(3))
    # so many tasks that the keys that one counts before the shuffle take bounded memory
    spread = nodes.repartition(max(1, -(-nodes.count() * len(index.triples) // POSTED)))
    posted = spread.select(triple.alias("t"), "rep", *fps).select("t.*", "rep", *fps, F.array(*fps).alias("fps")).select(F.expr(key).alias("k"), "rep", *fps)
    # most keys have one row, which meets nothing
    counts = posted.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    counts = scratch.keep(counts, "counts")
    posted = posted.join(sent_if_small(counts, SENT_KEYS), "k")
    if not counts.where("blocks > 1").isEmpty():
        # A posting of n blocks becomes pairs of blocks, each with a key of its own: any two rows meet in one of them.
        posted = posted.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64(*fps), "blocks").cast("int")))
        other = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
        posted = posted.withColumn("other", F.explode(other))
        apart = F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other"))
        posted = posted.withColumn("k", F.when(F.col("blocks") > 1, apart).otherwise(F.col("k")))
    return map_arrow(posted.select("k", "rep", *fps).repartition("k").sortWithinPartitions("k", *fps), _links(index), "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`: component_id is the least doc_id reachable through links.

    Documents with one fingerprint are one node of the graph, whatever their number; links join nodes. Null and empty
    texts have fingerprint 0 and are linked like any other. A null doc_id is never a component's id: rows with it get
    the least id of their fingerprint's component, or null if there is none. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs), "marked")
    nodes = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    links = scratch.keep(near_links(nodes.where("rep is not null").withColumnRenamed("fp", "fp0"), scratch), "links")
    found = connected_components(links, "simhash-components")
    named = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = scratch.keep(named, "named")
    scratch.drop_all_but("named", "marked")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def text_key(text: Column) -> list[Column]:
    """Two numbers that together stand for a text; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")]


def similar(links: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of links (u, v) between keys of `texts` (t1, text) those whose shingles have at least this Jaccard similarity."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(x.as_py(), hashes).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["t1", "shingles"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(c.as_py(), np.uint64) for c in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    each = map_arrow(texts.select("t1", F.col("text").cast("binary").alias("text")), sets, "t1 long, shingles binary")
    side = lambda x: each.select(F.col("t1").alias(x), F.col("shingles").alias(f"s{x}"))
    return map_arrow(links.join(side("u"), "u").join(side("v"), "v").select("u", "v", "su", "sv"), alike, "u long, v long")


def similar_groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, t1, t2, component) of the rows of `docs`: texts with one component are joined by similar ones.

    Texts with one wide fingerprint are one node, which stands for the least of their keys.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), F.col("text").cast("binary").alias("text"))
    fps = [f"fp{k}" for k in range(SIMILAR.numbers)]
    marked = scratch.keep(map_arrow(texts, _wide, "doc_id long, t1 long, t2 long, " + ", ".join(f"{c} long" for c in fps)), "marked")
    nodes = scratch.keep(marked.groupBy(*fps).agg(F.min("t1").alias("rep")), "nodes")
    met = scratch.keep(near_links(nodes, scratch, SIMILAR).distinct(), "met")
    ends = scratch.keep(met.select(F.explode(F.array("u", "v")).alias("t1")).distinct(), "ends")
    needed = texts.select("t1", "text").join(sent_if_small(ends, SENT_KEYS), "t1").groupBy("t1").agg(F.first("text").alias("text"))
    links = scratch.keep(similar(met, scratch.keep(needed, "needed")), "links")
    found = connected_components(links, "similar-components")
    named = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*fps, F.coalesce("component", "rep").alias("component"))
    named = scratch.keep(named, "named")
    return marked.join(named, fps).select("doc_id", "t1", "t2", "component")


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the row with the least doc_id, with the columns of `docs`.

    Rows that share an id are judged each by their own text; of one id the text with the least hash comes first. Of rows
    that repeat id and text one stays, the first in order of a hash of its columns. Rows without an id stay. Texts
    without words are alike. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "simhash-first")
    key = ["doc_id", "t1", "t2"]
    groups = similar_groups(docs.where("doc_id is not null").select("doc_id", "text"), scratch)
    each = scratch.keep(groups.groupBy("component", *key).agg(F.count("*").alias("n")), "groups")
    heads = each.groupBy("component").agg(F.min(F.struct(*key)).alias("head"))
    marked = each.join(heads, "component").select(*key, "n", (F.struct(*key) == F.col("head")).alias("first"))
    gone = scratch.keep(marked.where("not first or n > 1"), "gone")
    scratch.drop_all_but("gone")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")))
    out = held.join(sent_if_small(gone.select(*key), SENT_IDS), key, "left_anti").select("row")
    repeated = gone.where("first").select(*key)
    if not repeated.isEmpty():
        order = Window.partitionBy(*key).orderBy(F.xxhash64(F.to_json("row")))
        one = held.join(sent_if_small(repeated, SENT_IDS), key, "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
        out = out.unionByName(one.select("row"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """near_duplicates of `documents`, a row for each of its rows; the fingerprint in hex."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
