"""Token counts from distinct pre-tokens.

Byte-pair merges never cross a pre-token, so a document's token count is the sum over its pre-tokens of the pieces each
has. The corpus' distinct pre-tokens are encoded once; documents only bring pre-token frequencies.

Null texts count as empty. Rows that share an id are counted each by itself. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

# The byte-level split pattern, spelled out for the code points up to U+017F.
LETTER = r"A-Za-zªµºÀ-ÖØ-öø-ſ"
DIGIT = r"0-9²³¹¼-¾"
SPACE = r"\t-\r \u0085 "
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Text with other characters goes through the library's own splitter, whose Unicode tables decide.
UNUSUAL = re.compile("[^\x00-ſ‐-‧‰-⁞€]")
#: A task holds at most this many distinct pre-tokens before it hands them on.
HELD = 300_000


def tokenizer(path: str) -> Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


_TOKENIZERS: dict[str, Tokenizer] = {}


def pretokens(text: str, tok: Tokenizer) -> Iterable[str]:
    """The pre-tokens of text in order; special strings are pre-tokens of their own."""
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    parts = re.split(f"({'|'.join(map(re.escape, special))})", text) if special and any(s in text for s in special) else [text]
    for part in parts:
        if part in special:
            yield part
        elif UNUSUAL.search(part):
            for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(part):
                yield part[a:b]
        elif len(part) > 1_000_000:
            yield from (m.group() for m in SPLIT.finditer(part))
        else:
            yield from SPLIT.findall(part)


def frequencies(text: str, tok: Tokenizer, special: tuple[str, ...]) -> Counter:
    if len(text) <= 1_000_000 and not UNUSUAL.search(text) and not any(s in text for s in special):
        return Counter(SPLIT.findall(text))
    return Counter(pretokens(text, tok))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024, head: int = 200_000) -> DataFrame:
    """Per document: n_bytes, n_tokens, over_limit.

    head: at most so many of the most frequent pre-tokens are broadcast with their piece counts (a bound of about 15 MB); all
    others are joined by a shuffle.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(frequencies(text.as_py(), tok, special))
                if len(seen) > HELD:
                    yield pa.RecordBatch.from_pydict({"pretoken": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
                    seen = Counter()
        yield pa.RecordBatch.from_pydict({"pretoken": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            pieces = [len(e) for e in tok.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], ["pretoken", "n", "pieces"])

    distinct = rows.select("text").mapInArrow(vocabulary, "pretoken string, n bigint").groupBy("pretoken").agg(F.sum("n").alias("n"))
    pieces = common.checkpoint(distinct.mapInArrow(encode, "pretoken string, n bigint, pieces bigint"))
    # Whole classes of frequency, of which there are a few hundred, from the most frequent on.
    often = F.floor(F.log2("n") * 16)
    level, room = float("inf"), head
    for r in sorted(pieces.groupBy(often.alias("often")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        level = r.often
    top = pieces.filter(often >= level).select("pretoken", "pieces").toArrow()
    frequent = spark.sparkContext.broadcast(dict(zip(*(top.column(c).to_pylist() for c in (0, 1)), strict=True)))
    del top

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = tokenizer(path), frequent.value
        special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, own, tokens, times, counted, sizes = [], [], [], [], [], []
                for doc, text, row in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    total = 0
                    for token, n in frequencies(text, tok, special).items():
                        if (k := known.get(token)) is None:
                            ids.append(None)
                            own.append(row)
                            tokens.append(token)
                            times.append(n)
                            counted.append(0)
                            sizes.append(0)
                        else:
                            total += k * n
                    ids.append(doc)
                    own.append(row)
                    tokens.append(None)
                    times.append(0)
                    counted.append(total)
                    sizes.append(len(text.encode()))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, part.schema.field(0).type), "row": pa.array(own, pa.int64()), "pretoken": pa.array(tokens, pa.string()), "times": pa.array(times, pa.int64()), "counted": pa.array(counted, pa.int64()), "n_bytes": pa.array(sizes, pa.int64())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(per_document, f"doc_id {kind}, row bigint, pretoken string, times bigint, counted bigint, n_bytes bigint")
    # A document's own row has no partner; a key of its own keeps such rows from meeting in one task.
    found = found.withColumn("pretoken", F.coalesce("pretoken", F.concat(F.lit("\u0000\u0000"), F.col("row").cast("string"))))
    joined = found.join(pieces.select("pretoken", "pieces"), "pretoken", "left")
    n_tokens = F.sum(F.col("counted") + F.col("times") * F.coalesce("pieces", F.lit(0)))
    return joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), n_tokens.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit).drop("row")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir))
