"""Near-dedup by an inverted join over MinHash signatures.

A signature has `coordinates` minima; each (coordinate, value) is a token. Documents that agree on `matches` tokens share
one among their coordinates - matches + 1 rarest, so only those prefixes are posted and the longest lists of a document are
skipped: collisions with them are counted by probing the signature, once two documents have met in a list.

1. Heads. Each list offers its members its most central document (the one with most tokens that others have, too) and its
   smallest; every document tries the two it meets most often. Pairs of `matches` collisions that hold on the full sets are
   links, and link whole lists to few components.
2. Families. Lists that still hold several components connect documents to families. Within a family every document
   outside its largest component meets all others: collisions are counted, pairs above the threshold are confirmed on the
   full sets, and only links that connect further components leave the task. A family of any size is dealt in blocks
   against blocks, so no task grows with it, and each document travels once for each block it meets.

Documents with equal sets are one node from the start. Null and blank texts have empty sets and no links. Rows with a null
id are components of their own. Rows that share an id and a text count as one document, each of them reported; where rows
with different texts share an id, a link of any of them is a link of that id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .shingles import shingles

COORDINATES = 64
MATCHES = 32
#: Documents and shingles of a block, and documents that try one head in a task.
ROWS, ENTRIES, TRIES = 2048, 1 << 19, 256


def signature(sets: np.ndarray, coordinates: int) -> np.ndarray:
    """The minimum of each of `coordinates` hash functions, as 32-bit numbers."""
    seeds = np.random.default_rng(11).integers(0, 1 << 63, (2, coordinates), np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 4096):
        part = sets[at : at + 4096]
        np.minimum(least, (part[:, None] * seeds[0] + seeds[1]).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, coordinates: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) of docs (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, keys, found = [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py())
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    found.append(signature(s, coordinates) if len(s) else np.empty(0, np.int32))
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n_shingles bigint, set_key binary, signature array<int>")


def postings(nodes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(token, doc_id, shared) of each node's rarest tokens that others have too; shared: how many of its tokens others have."""
    posted = nodes.select("doc_id", F.posexplode("signature").alias("k", "value")).select("doc_id", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("value").cast("long")).alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    lists = posted.join(shared, "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    spare = F.size("tokens") - matches + 1  # tokens nobody shares are the rarest and have been dropped
    return lists.filter(spare > 0).select(F.explode(F.slice("tokens", F.lit(1), spare)["token"]).alias("token"), "doc_id", F.size("tokens").alias("shared"))


def offered(lists: DataFrame) -> DataFrame:
    """Pairs (a, b): each document with the two it is offered most often, of its lists' most central and smallest ones."""
    heads = lists.groupBy("token").agg(F.min(F.struct((-F.col("shared")).alias("minus"), "doc_id"))["doc_id"].alias("centre"), F.min("doc_id").alias("low"))
    pairs = lists.join(heads, "token").select(F.explode(F.array_distinct(F.array("centre", "low"))).alias("a"), F.col("doc_id").alias("b")).filter("a <> b")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "a"))), 1, 2)  # a document is offered two for each of its lists
    return counted.groupBy("b").agg(best.alias("best")).select(F.explode("best.a").alias("a"), "b")


def colliding(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """Those of pairs (a, b) whose signatures agree in `matches` coordinates."""
    side = lambda x: nodes.select(F.col("doc_id").alias(x), F.col("signature").alias(f"s{x}"))
    equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(equal >= matches).select("a", "b")


def verify(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets have 100 x intersection >= percent x union. Each a travels once for some b's."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = common.may_contain(docs.select("doc_id", "text"), common.id_filter(ends, F.col("id")), F.col("doc_id"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TRIES).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    text = lambda key: texts.select(F.col("doc_id").alias(key), "text")
    tried = dealt.join(text("b"), "b").select("a", "part", "b", "text")
    heads = dealt.select("a", "part").distinct().join(text("a"), "a").select("a", "part", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sets = None, []
        for batch in batches:
            keep = []
            for a, part, b, text in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                own = shingles(text.as_py())
                if b is None:  # a head comes before those that try it; rows with different texts can share its id
                    sets, head = [*sets, own] if head == (a, part) else [own], (a, part)
                    keep.append(False)
                    continue
                shared = [len(np.intersect1d(s, own, assume_unique=True)) for s in sets] if head == (a, part) else []
                keep.append(any(k and 100 * k >= percent * (len(s) + len(own) - k) for k, s in zip(shared, sets, strict=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    meet = tried.unionByName(heads).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return meet.mapInArrow(held, f"a {kind}, b {kind}")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set on the left shares with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    x, y = np.concatenate(left), np.concatenate(right)
    known = np.intersect1d(x, y)
    if not len(known):
        return out
    row, column = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))

    def coded(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        held = known[at] == values
        order = np.argsort(at[held], kind="stable")
        return at[held][order], owner[held][order]

    (x, row), (y, column) = coded(x, row), coded(y, column)
    holders = np.bincount(y, minlength=len(known))
    # What many on the right hold goes through a matrix product; there are few such members, as sets are of bounded size.
    common_ones = np.flatnonzero(holders > max(8, len(right) // 16))
    for at in range(0, len(common_ones), 2048):
        some = common_ones[at : at + 2048]
        place = np.full(len(known), -1)
        place[some] = np.arange(len(some))
        a, b = np.zeros((len(left), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
        for m, codes, owner in ((a, x, row), (b, y, column)):
            own = place[codes] >= 0
            m[owner[own], place[codes[own]]] = 1
        out += a @ b.T
    few = np.ones(len(known), bool)
    few[common_ones] = False
    first = np.cumsum(holders) - holders
    x, row = x[few[x]], row[few[x]]
    ends = np.cumsum(holders[x])
    for at in range(0, int(ends[-1]) if len(ends) else 0, 1 << 22):
        a, b = np.searchsorted(ends, [at, at + (1 << 22)], side="right")
        n = holders[x[a:b]]
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[x[a:b]], n)
        np.add.at(out, (np.repeat(row[a:b], n), column[each]), 1)
    return out


def links_between(left: dict, right: dict, percent: int, matches: int) -> list[tuple[int, int]]:
    """Pairs of places (left, right) that are links and connect different components, no more than are needed for that."""
    above: dict = {}

    def top(c):
        while c in above:
            c = above[c]
        return c

    found = []
    sizes, sizes_y = (np.array(list(map(len, s["sets"]))) for s in (left, right))
    names, codes = np.unique(np.concatenate([left["component"], right["component"]]), return_inverse=True)
    cx, cy = codes[: len(sizes)], codes[len(sizes) :]
    for at in range(0, len(sizes), 256):
        own = np.arange(at, min(at + 256, len(sizes)))
        equal = np.zeros((len(own), len(sizes_y)), np.uint8)
        for k in range(left["signature"].shape[1]):
            equal += left["signature"][own, k][:, None] == right["signature"][None, :, k]
        least, most = np.minimum(sizes[own][:, None], sizes_y[None, :]), np.maximum(sizes[own][:, None], sizes_y[None, :])
        maybe = (equal >= matches) & (cx[own][:, None] != cy[None, :]) & (100 * least >= percent * most)
        i, j = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
        if not len(i):
            continue
        shared = overlaps([left["sets"][own[k]] for k in i], [right["sets"][k] for k in j])
        union = sizes[own[i]][:, None] + sizes_y[j][None, :] - shared
        a, b = np.nonzero((100 * shared >= percent * union) & maybe[np.ix_(i, j)])
        a, b = own[i[a]], j[b]
        _, once = np.unique(cx[a] * len(names) + cy[b], return_index=True)
        for k in once.tolist():
            u, v = top(int(cx[a[k]])), top(int(cy[b[k]]))
            if u != v:
                above[u] = v
                found.append((int(a[k]), int(b[k])))
    return found


def across(docs: DataFrame, nodes: DataFrame, lists: DataFrame, percent: int, coordinates: int, matches: int) -> DataFrame:
    """Links (a, b) between the components of lists (token, doc_id, component), as many as connect what is connected."""
    heads = lists.groupBy("token").agg(F.min("doc_id").alias("low"))
    families = connected_components(lists.join(heads, "token").select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    member = lists.select("doc_id", "component").distinct().join(families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id")
    member = common.compact(member.join(nodes.select("doc_id", "n_shingles", "signature"), "doc_id"))
    by_component = member.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("entries"))
    sums = by_component.groupBy("family").agg(F.sum("n").alias("n"), F.sum("entries").alias("entries"), F.max(F.struct("n", "entries", "component")).alias("main"))
    blocks = lambda n, entries: F.ceil(F.greatest(n / ROWS, entries / ENTRIES)).cast("int")
    cuts = sums.select("family", F.col("main.component").alias("main"), blocks(F.col("n"), F.col("entries")).alias("rights"), blocks(F.col("n") - F.col("main.n"), F.col("entries") - F.col("main.entries")).alias("lefts"))
    texts = common.may_contain(docs.select("doc_id", "text"), common.id_filter(member, F.col("doc_id")), F.col("doc_id"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sets = pa.array([shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["doc_id", "sets"]).filter(pc.greater(pc.binary_length(sets), 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    # An inner join stays behind the filter; a semi join would be moved before it.
    sets = texts.join(member.select("doc_id").distinct(), "doc_id").select("doc_id", "text").mapInArrow(spread, f"doc_id {kind}, sets binary")
    rows = member.drop("n_shingles").join(cuts, "family").join(sets, "doc_id")
    dealt = rows.withColumns({"i": F.pmod(F.xxhash64("doc_id"), F.col("lefts")).cast("int"), "j": F.pmod(F.xxhash64("doc_id"), F.col("rights")).cast("int")})
    carried = ("doc_id", "component", "signature", "sets")
    left = dealt.filter("component <> main").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).select("family", "i", "j", F.lit(True).alias("left"), *carried)
    right = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).select("family", "i", "j", F.lit(False).alias("left"), *carried)

    def meet(table: pa.Table) -> pa.Table:
        ids, sides = table["doc_id"], []
        is_left = table["left"].to_numpy()
        for at in (np.flatnonzero(is_left), np.flatnonzero(~is_left)):
            own = table.take(pa.array(at))
            sides.append({"at": at, "component": np.array(own["component"].to_pylist()), "signature": np.array(own["signature"].combine_chunks().flatten()).reshape(len(at), coordinates), "sets": [np.frombuffer(s, np.uint64) for s in own["sets"].to_pylist()]})
        found = links_between(*sides, percent, matches) if all(len(s["at"]) for s in sides) else []
        ends = ([sides[k]["at"][pair[k]] for pair in found] for k in (0, 1))
        return pa.table({c: ids.take(pa.array(e, pa.int64())) for c, e in zip("ab", ends, strict=True)})

    return left.unionByName(right).groupBy("family", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}")


def components(docs: DataFrame, percent: int = 75, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, component_id, kept."""
    signed = common.checkpoint(signatures(docs, coordinates))
    groups = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"))
    nodes = signed.join(groups.withColumnRenamed("node", "doc_id"), ["set_key", "doc_id"]).dropDuplicates(["set_key", "doc_id"])
    posted = common.compact(postings(nodes, coordinates, matches))
    tried = common.compact(colliding(offered(posted), nodes, matches))
    merged = common.compact(connected_components(verify(docs, tried, percent)))

    labelled = posted.join(merged.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("token", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
    rest = common.compact(labelled.join(mixed, "token"))
    second = across(docs, nodes, rest, percent, coordinates, matches)
    label = lambda x: rest.select(F.col("doc_id").alias(x), F.col("component").alias(f"c{x}")).distinct()
    higher = connected_components(second.join(label("a"), "a").join(label("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = merged.unionByName(rest.select(F.col("doc_id").alias("node"), "component").distinct().join(merged, "node", "left_anti"))
    merged = merged.join(higher.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))

    names = groups.join(merged, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 AND doc_id IS NOT NULL"), F.col("set_key")).alias("set_key")).join(names, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_rows(docs: DataFrame, **options) -> DataFrame:
    """docs' rows that stay, with all their columns: one document of each component.

    Rows with a null id and rows without words stay. Of rows that share an id all stay if the id does, whatever their texts.
    """
    stays = components(docs, **options).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["__id"]), "left_semi")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.documents(spark, sf_dir))
