"""Best-fit packing planned over a histogram of lengths.

Only the histogram (one row for each length up to the capacity) reaches the driver. Best-fit decreasing runs over its
counts and yields slots as runs of equal bins; pieces then take slots by their rank within their length.

Null texts are empty documents: one piece that holds only the end id. Rows that share an id are packed each by itself.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .token_counts import DIGIT, LETTER, SPACE, UNUSUAL, tokenizer

# The word split pattern, spelled out for the code points up to U+017F.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: Ranks that meet their slots in one group.
CHUNK = 1000
#: A worker remembers the ids of so many words.
REMEMBERED = 500_000


_KNOWN: dict[str, dict[str, bytes]] = {}


def last_pieces(tok: Tokenizer) -> np.ndarray:
    """For each id whether its piece ends a word."""
    if id(tok) not in _LAST:
        vocabulary = tok.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        _LAST[id(tok)] = out
    return _LAST[id(tok)]


_LAST: dict[int, np.ndarray] = {}


def encoded(words: list[str], tok: Tokenizer) -> dict[str, bytes]:
    """The ids of each word, as little-endian 32-bit numbers. Words are encoded as one text: white space keeps them apart."""
    plain = [w for w in words if not SPECIAL.fullmatch(w)]
    out = {w: np.array(tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words if SPECIAL.fullmatch(w)}
    if not plain:
        return out
    e = tok.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0]
    ids = np.array(e.ids, "<u4")
    at, ids = np.concatenate([[0], np.flatnonzero(last_pieces(tok)[ids]) + 1]), ids.tobytes()
    if len(at) != len(plain) + 1:  # a word that the library takes apart
        return out | {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(plain, tok.encode_batch_fast(plain, add_special_tokens=False), strict=True)}
    at = (4 * at).tolist()
    return out | {w: ids[a:b] for w, a, b in zip(plain, at, at[1:], strict=False)}


def piece_table(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = tokenizer(path), _KNOWN.setdefault(path, {})
        end = end_id.to_bytes(4, "little")

        def words(text: str) -> list[str] | None:
            """The words of a text; None if the library has to encode it whole."""
            if UNUSUAL.search(text):
                return None
            if "<|" not in text:
                return SPLIT.findall(text.lower())
            return [w for part in SPECIAL.split(text) for w in ([part] if SPECIAL.fullmatch(part) else SPLIT.findall(part.lower()))]

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                split = [words(x or "") for x in part.column(1).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                known.update(encoded([w for w in set().union(*(x for x in split if x)) if w not in known], tok))
                out = defaultdict(list)
                for k, (doc, x) in enumerate(zip(part.column(0).to_pylist(), split, strict=True)):
                    if x is None:
                        x = [i.to_bytes(4, "little") for i in tok.encode(part.column(1)[k].as_py(), add_special_tokens=False).ids]
                        ids = b"".join(x) + end
                    else:
                        ids = b"".join(map(known.__getitem__, x)) + end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        out["doc_id"].append(doc)
                        out["piece"].append(i)
                        out["start"].append(at // 4)
                        out["length"].append(len(own) // 4)
                        out["ids_crc32"].append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], part.schema.field(0).type), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, count, first sequence, offset) of each run of slots.

    Bins with the same free space are one run, so the work depends on the lengths that occur, not on their counts.
    """
    free: list[int] = []  # free spaces that open bins have, ascending
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space: runs (first sequence, count)
    slots, sequences = [], 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if not bins[space]:
                insort(free, space)
            bins[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, n = bins[space].pop()
                if not bins[space]:
                    free.pop(at)
            else:
                space, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            each = space // length
            for per_bin, count in ((each, min(n, left // each)), (left % each, 1)):
                if not count or not per_bin or not n:
                    continue
                for k in range(per_bin):
                    slots.append((length, rank, count, first, capacity - space + k * length))
                    rank += count
                left -= per_bin * count
                put(space - per_bin * length, first, count)
                first, n = first + count, n - count
                if not left:
                    break
            put(space, first, n)
    return slots


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of docs (doc_id, text) with their place: sequence_id, offset."""
    spark = docs.sparkSession
    pieces = common.checkpoint(piece_table(docs, path or public_tokenizers.path("word_bpe_49k.json"), capacity, end_id))
    n = common.partitions(spark)
    # A length that a third of all pieces share is ranked in n parts, whose sizes give each part its first rank.
    pieces = pieces.withColumn("part", common.salt(n, "doc_id", "piece"))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity)
    places = spark.createDataFrame(slots, "length bigint, rank0 bigint, count bigint, first bigint, offset bigint")
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(within) - 1).join(begin, ["length", "part"]).withColumn("rank", F.col("own") + F.col("before"))
    # Slots and pieces meet by length and thousands of ranks; a run of slots is there once for each thousand it reaches into.
    chunk = lambda rank: F.floor(rank / CHUNK).cast("long")
    places = places.withColumn("chunk", F.explode(F.sequence(chunk(F.col("rank0")), chunk(F.col("rank0") + F.col("count") - 1))))
    ranked = ranked.withColumn("chunk", chunk(F.col("rank")))
    taken = ranked.join(places, ["length", "chunk"]).filter((F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("count")))
    return taken.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("rank0")).alias("sequence_id"), "offset")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
