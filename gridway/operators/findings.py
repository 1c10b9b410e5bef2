"""Findings: obstacles on routes, their duplicates, and what changed between two runs.

Findings are rows with route_id, kategorie, titel, km, rank (3 kritisch to 1 hinweis) and ord, their canonical order. The
greedy passes compare each finding with the representatives so far, whose place moves as severer ones replace them. They run
over stretches: a route and category is cut where no two findings lie close enough to be compared, so that no group holds more
than what is crowded in one place.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridway.functions import geo, text
from gridway.operators.grouped import each_group, stretches

# How close two findings of the same place lie.
SAME_KM, SAME_M, SAME_WIDTH_M = 0.15, 25.0, 0.01
#: Neighbours of repeated places that a task remembers; others are found anew.
NEIGHBOURS = 5_000_000


def title_key() -> Column:
    return text.norm_name(F.col("titel"))


def crowded(findings: DataFrame, keys: list[str], pick) -> DataFrame:
    """pick() over the stretches of each key, whose findings lie within SAME_KM of a neighbour, in order of ord."""
    cut = stretches(findings, keys, F.col("km"), SAME_KM + 1e-9)
    return each_group(cut, [*keys, "__stretch"], ["ord"], pick, cut.schema, lambda rows: rows).drop("__stretch")


class Along:
    """Numbers by cells of SAME_KM along a route: only those in a cell and its neighbours can lie within it."""

    def __init__(self):
        self.cells: dict[int, set[int]] = {}

    def put(self, n: int, km: float) -> None:
        self.cells.setdefault(math.floor(km / SAME_KM), set()).add(n)

    def drop(self, n: int, km: float) -> None:
        self.cells[math.floor(km / SAME_KM)].discard(n)

    def near(self, km: float) -> list[int]:
        """Ascending."""
        at = math.floor(km / SAME_KM)
        return sorted(n for c in (at - 1, at, at + 1) for n in self.cells.get(c, ()))


def representatives(rows: pd.DataFrame, twins, replaces, alone=lambda f: False) -> pd.DataFrame:
    """The rows that stay when each, in order, meets the first kept one that it is a twin of, and takes its place or goes.

    twins(k, f), replaces(f, k) and alone(f) tell by the places of rows. Rows that are alone are nobody's twins: they stay and are met by none.
    """
    kept: list[int] = []
    along, km = Along(), rows.km.tolist()
    for f, at in enumerate(km):
        if at is None or not math.isfinite(at) or alone(f):
            kept.append(f)
            continue
        n = next((n for n in along.near(at) if abs(km[kept[n]] - at) <= SAME_KM and twins(kept[n], f)), None)
        if n is None:
            n = len(kept)
            kept.append(f)
        elif replaces(f, kept[n]):
            along.drop(n, km[kept[n]])
            kept[n] = f
        else:
            continue
        along.put(n, at)
    return rows.iloc[kept]


def dedupe_points(findings: DataFrame) -> DataFrame:
    """Drops findings of the same route, category and title within SAME_KM of a kept one, in order of ord.

    The severer one stays, on a tie the one with a geometry; two different geometries are no duplicates.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        geom, rank = rows.geom.tolist(), rows["rank"].tolist()
        twins = lambda k, f: not geom[k] or not geom[f] or geom[k] == geom[f]
        return representatives(rows, twins, lambda f, k: rank[f] > rank[k] or (rank[f] == rank[k] and geom[f] and not geom[k]))

    return crowded(findings.withColumn("__key", title_key()), ["route_id", "kategorie", "__key"], pick).drop("__key")


def dedupe_places(findings: DataFrame) -> DataFrame:
    """Drops points of the same route and category within SAME_KM and SAME_M of a kept one; the severer one stays."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        geom, rank = rows.geom.tolist(), rows["rank"].tolist()
        at = np.radians(rows[["lat", "lng"]].to_numpy(float))
        lat, lng, high, placed = at[:, 0].tolist(), at[:, 1].tolist(), np.cos(at[:, 0]).tolist(), np.isfinite(at).all(axis=1).tolist()

        def close(k: int, f: int) -> bool:
            h = math.sin((lat[f] - lat[k]) / 2) ** 2 + high[k] * high[f] * math.sin((lng[f] - lng[k]) / 2) ** 2
            return 2 * geo.EARTH_KM * math.asin(math.sqrt(h)) * 1000 <= SAME_M

        return representatives(rows, close, lambda f, k: rank[f] > rank[k], lambda f: bool(geom[f]) or not placed[f])

    return crowded(findings, ["route_id", "kategorie"], pick)


def dedupe_sources(findings: DataFrame) -> DataFrame:
    """Of findings of different sources within SAME_KM on a route and category, drops the less severe; a dropped one drops no other."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        source = rows.quelle.fillna("").str.strip().str.lower().str.replace(r"\s+", " ", regex=True).to_numpy()
        own = (rows.herkunft == "eigen").to_numpy()
        gone = np.zeros(len(rows), bool)
        met = np.flatnonzero(~own & rows.km.notna().to_numpy() & rows["rank"].notna().to_numpy())
        if not len(met):
            return rows
        # Rows alike in place, source and severity are a class; what is left of each is met from its first one on.
        likes = pd.DataFrame({"km": rows.km.to_numpy()[met], "rank": rows["rank"].to_numpy()[met], "source": pd.factorize(source[met])[0]}).groupby(["km", "rank", "source"])
        km, rank, code = (np.array(c) for c in zip(*likes.groups, strict=True))
        of = likes.ngroup().to_numpy()
        members = [list(m) for m in np.split(met[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of))[:-1])]
        low, high = np.searchsorted(km, km - SAME_KM - 1e-9), np.searchsorted(km, km + SAME_KM + 1e-9, "right")
        head, place = np.array([m[0] for m in members]), [0] * len(members)

        def onward(c: int, until: int) -> None:
            """Drops a class's rows before a row, and finds the first one left."""
            m, k = members[c], place[c]
            while k < len(m) and (gone[m[k]] or m[k] < until):
                gone[m[k]] = True
                k += 1
            place[c], head[c] = k, m[k] if k < len(m) else len(rows)

        for i, c in zip(met.tolist(), of.tolist(), strict=True):
            if gone[i]:
                continue
            span = slice(low[c], high[c])
            other = (code[span] != code[c]) & (np.abs(km[span] - km[c]) <= SAME_KM)
            first = head[span]
            worse = first[other & (rank[span] > rank[c])].min(initial=len(rows))
            for k in np.flatnonzero(other & (rank[span] < rank[c]) & (first < worse)):
                onward(int(low[c] + k), worse)
            if worse < len(rows):
                gone[i] = True
                if head[c] == i:
                    onward(c, 0)
        return rows[~gone]

    return crowded(findings, ["route_id", "kategorie"], pick)


def dedupe_points_by_gap(findings: DataFrame) -> DataFrame:
    """A relational variant of dedupe_points: stretches whose neighbours lie within SAME_KM keep their severest finding.

    It differs from the greedy pass where a chain of neighbours is longer than SAME_KM.
    """
    key = ["route_id", "kategorie", "title_key"]
    along = Window.partitionBy(*key).orderBy("km", "ord")
    rows = findings.withColumn("title_key", title_key())
    new = F.when(F.col("km") - F.lag("km").over(along) <= SAME_KM, 0).otherwise(1)
    stretch = F.sum("new").over(along)
    first = F.row_number().over(Window.partitionBy(*key, "stretch").orderBy(F.desc("rank"), "ord"))
    return rows.withColumn("new", new).withColumn("stretch", stretch).withColumn("n", first).filter("n = 1").select(*findings.columns)


def dedupe_obstacle(findings: DataFrame) -> DataFrame:
    """One finding per obstacle, its severest, the first on ties, at the place of its first; findings without obstacle stay."""
    per = Window.partitionBy("obstacle_id")
    rows = findings.filter("obstacle_id IS NOT NULL").withColumns({"n": F.row_number().over(per.orderBy(F.desc("rank"), "ord")), "place": F.min("ord").over(per)})
    best = rows.filter("n = 1").withColumn("ord", F.col("place")).select(*findings.columns)
    return best.unionByName(findings.filter("obstacle_id IS NULL"))


def drop_dominated_widths(findings: DataFrame) -> DataFrame:
    """Drops findings wider than the narrowest of their route, category, hundred metres and validity, if that is as severe."""
    key = Window.partitionBy("route_id", "kategorie", geo.half_up(F.col("km") * 10), "gueltig_von", "gueltig_bis", F.col("restbreite_m").isNotNull())
    rows = findings.withColumn("least", F.min("restbreite_m").over(key))
    narrow = F.col("restbreite_m") <= F.col("least") + SAME_WIDTH_M
    rows = rows.withColumn("worst", F.max(F.when(narrow, F.col("rank"))).over(key))
    dominated = F.coalesce(~narrow & (F.col("worst") >= F.col("rank")), F.lit(False))
    return rows.filter(~dominated).select(*findings.columns)


def route_sets(findings: DataFrame) -> DataFrame:
    """(obstacle_id, route_ids): all routes on which an obstacle was found, ascending."""
    return findings.filter("obstacle_id IS NOT NULL").groupBy("obstacle_id").agg(F.sort_array(F.collect_set("route_id")).alias("route_ids"))


def stable_key() -> Column:
    """The name of a finding that survives re-runs: obstacle and route, else a hash of what it says."""
    said = F.sha2(F.concat_ws("|", F.coalesce("kategorie", F.lit("")), title_key(), F.floor(F.col("km") + 0.5).cast("string")), 256)
    by_obstacle = F.concat_ws("|", F.col("obstacle_id").cast("string"), F.coalesce(F.col("route_id").cast("string"), F.lit("")))
    return F.when(F.col("obstacle_id").isNotNull(), by_obstacle).otherwise(said)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change, rank_before, rank_after): neu for findings that are new, geaendert for those whose severity changed.

    Of several findings with one key the severest counts. Removed findings give no event.
    """

    def severest(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(stable_key().alias("key")).agg(F.max("rank").alias(name))

    both = severest(before, "rank_before").join(severest(after, "rank_after"), "key", "full_outer")
    change = F.when(F.col("rank_before").isNull(), "neu").when(F.col("rank_after") != F.col("rank_before"), "geaendert")
    return both.withColumn("change", change).filter("change IS NOT NULL AND rank_after IS NOT NULL").select("key", "change", "rank_before", "rank_after")


def signature(findings: DataFrame) -> DataFrame:
    """(route_id, n, signature): a hash of all of a route's finding keys, equal whatever their order and partitioning.

    The keys' hashes are summed, so no route's keys have to meet in one row.
    """
    part = F.conv(F.substring(F.sha2(stable_key(), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = findings.groupBy("route_id").agg(F.count("*").alias("n"), F.sum(part).alias("total"))
    return sums.select("route_id", "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("total").cast("string")), 256).alias("signature"))


def stats(findings: DataFrame) -> DataFrame:
    """Per route: number of findings of each severity, and the kilometre of the first critical one."""
    of = lambda r: F.count_if(F.col("rank") == r)
    return findings.groupBy("route_id").agg(F.count("*").alias("n"), of(3).alias("kritisch"), of(2).alias("warnung"), of(1).alias("hinweis"), F.min(F.when(F.col("rank") == 3, F.col("km"))).alias("first_critical_km"))


def groups_within(findings: DataFrame, metres: float = 600.0) -> DataFrame:
    """findings with a group, named by the ord of its first member: same route, category and title, and within `metres` of a member.

    In order of ord, a finding joins the earliest group that has a member close by. Findings further apart than that in
    latitude alone never meet, which cuts crowded keys.
    """

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        # Places, by latitude, with the earliest group that has a member there.
        at = np.radians(rows[["lat", "lng"]].to_numpy(float))
        there = np.flatnonzero(~np.isnan(at).any(axis=1))
        place, of, times = np.unique(at[there], axis=0, return_inverse=True, return_counts=True)
        high, reach = np.cos(place[:, 0]), metres / 1000 / geo.EARTH_KM * 1.0001
        low, up = np.searchsorted(place[:, 0], place[:, 0] - reach), np.searchsorted(place[:, 0], place[:, 0] + reach, "right")
        none = np.iinfo(np.int64).max
        earliest, number = np.full(len(place), none), rows.ord.to_numpy(np.int64, copy=True)
        known, held = {}, 0
        for i, p in zip(there.tolist(), of.ravel().tolist(), strict=True):
            close = known.get(p)
            if close is None:
                span = slice(low[p], up[p])
                h = np.sin((place[span, 0] - place[p, 0]) / 2) ** 2 + high[span] * high[p] * np.sin((place[span, 1] - place[p, 1]) / 2) ** 2
                close = low[p] + np.flatnonzero(2 * geo.EARTH_KM * np.arcsin(np.sqrt(h)) * 1000 <= metres)
                if times[p] > 1 and held + len(close) <= NEIGHBOURS:
                    known[p], held = close, held + len(close)
            least = earliest[close].min()
            if least < none:
                number[i] = least
            earliest[p] = min(earliest[p], number[i])
        return rows.assign(group=number)

    keys = ["route_id", "kategorie", "title_key"]
    cut = stretches(findings.withColumn("title_key", title_key()), keys, F.col("lat"), metres / 1000 / geo.EARTH_KM * 57.3)
    schema = cut.withColumn("group", F.lit(0).cast("long")).schema
    return each_group(cut, [*keys, "__stretch"], ["ord"], group, schema, lambda rows: rows.assign(group=rows.ord)).drop("title_key", "__stretch")
