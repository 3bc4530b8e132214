"""Lines assembled from ways: straight through junctions, one of parallel tracks, and across short gaps.

What a single process would decide one after the other becomes rounds over a table of ends: each end proposes its best partner
by a total order, pairs that propose each other are joined, and the rest proposes again. With a total order on pairs that gives
what taking the best pair again and again gives. Only the ways of one resulting line are ever gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo, kernels, rings
from waymark.operators import spatial_join
from waymark.operators.graph import connected_components
from waymark.operators.spatial_join import cells, reach, segment_cells, segments
from waymark.session import save


def ends_of(ways: DataFrame, key: str) -> DataFrame:
    """Two rows a way: key, at (0 for the start, 1 for the end), x, y, and the unit direction (tx, ty) from that end into the way."""
    line = F.col("line")
    p = lambda k: F.element_at(line, k)
    e = ways.select(key, F.explode(F.array(F.struct(F.lit(0).alias("at"), p(1).alias("a"), p(2).alias("b")), F.struct(F.lit(1).alias("at"), p(-1).alias("a"), p(-2).alias("b")))).alias("e"))
    dx, dy = F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y")
    n = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return e.select(key, "e.at", F.col("e.a.x").alias("x"), F.col("e.a.y").alias("y"), F.coalesce(dx / n, F.lit(0.0)).alias("tx"), F.coalesce(dy / n, F.lit(0.0)).alias("ty"))


def usable(ways: DataFrame) -> DataFrame:
    """Lines without repeated points, of two points or more; the others, and null lines, are left out."""
    return ways.withColumn("line", rings.drop_repeats(F.col("line"))).filter(F.size("line") > 1)


def _straightest(open_ends: DataFrame, most: float) -> DataFrame:
    """node, end, mate, off: for each end the other end of its node that goes on straightest, at most ``most`` radians off.

    Ends are sorted by angle once a node: the straightest continuation is the neighbour of the opposite angle, so a node of
    any degree costs its own rows only.
    """
    turn = F.atan2("ty", "tx")
    stubs = open_ends.select("node", "end", F.explode(F.array(turn - 2 * math.pi, turn, turn + 2 * math.pi)).alias("a"), F.lit(True).alias("stub"))
    asks = open_ends.select("node", "end", F.when(turn > 0, turn - math.pi).otherwise(turn + math.pi).alias("a"), F.lit(False).alias("stub"))
    node = Window.partitionBy("node").orderBy("a", "stub", "end")
    seen = F.when(F.col("stub"), F.struct("a", "end"))
    back = F.last(seen, ignorenulls=True).over(node.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(seen, ignorenulls=True).over(node.rowsBetween(1, Window.unboundedFollowing))
    near = stubs.unionByName(asks).withColumn("p", back).withColumn("q", ahead).filter(~F.col("stub"))
    near = near.select("node", "end", "a", F.explode(F.array("p", "q")).alias("m")).filter(F.col("m").isNotNull() & (F.col("m.end.way") != F.col("end.way")))
    near = near.select("node", "end", F.col("m.end").alias("mate"), F.round(F.abs(F.col("m.a") - F.col("a")), 9).alias("off")).filter(F.col("off") <= most)
    return near.groupBy("node", "end").agg(F.min(F.struct("off", "mate")).alias("b")).select("node", "end", "b.mate", "b.off")


def _mutual(offers: DataFrame, group: str | None, order: list[Column]) -> DataFrame:
    """end, mate: offers that are returned; where a group has none, its first offer by the order, so that every round gets on."""
    back = offers.select(F.col("end").alias("mate"), F.col("mate").alias("end"), F.lit(True).alias("returned"))
    both = offers.join(back, ["end", "mate"], "left").withColumn("returned", F.coalesce("returned", F.lit(False)))
    pair = [F.least("end", "mate").alias("end"), F.greatest("end", "mate").alias("mate")]
    found = both.filter("returned").select(*pair).distinct()
    if group:
        w = Window.partitionBy(group)
        stuck = both.withColumn("any", F.bool_or("returned").over(w)).filter(~F.col("any"))
        first = stuck.withColumn("n", F.row_number().over(w.orderBy(*order, F.least("end", "mate"), F.greatest("end", "mate")))).filter("n = 1")
        found = found.unionByName(first.select(*pair))
    return found


def _without(ends: DataFrame, links: DataFrame) -> DataFrame:
    used = links.select(F.explode(F.array("end", "mate")).alias("end"))
    return ends.join(used, "end", "left_anti")


def _at_nodes(most: float):
    """A function on Arrow batches of nodes with all their stubs (end, tx, ty): end and mate of the pairs joined there."""

    def pairs(stubs: list[dict]) -> Iterator[tuple]:
        left = {(s["end"]["way"], s["end"]["at"]): math.atan2(s["ty"], s["tx"]) for s in stubs}
        if len(left) > 2:
            apart = ((p, q) for p, q in combinations(sorted(left), 2) if p[0] != q[0])
            off = lambda p, q: round(abs(abs(left[p] - left[q]) - math.pi), 9)
            for _, p, q in sorted(t for p, q in apart if (t := (off(p, q), p, q))[0] <= most):
                if p in left and q in left:
                    del left[p], left[q]
                    yield p, q
        if len(left) == 2:
            p, q = sorted(left)
            if p[0] != q[0]:
                yield p, q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stubs = batch.column("stubs")
            kind = stubs.type.value_type.field("end").type
            found = [pq for node in stubs.to_pylist() for pq in pairs(node)]
            sides = [pa.array([{"way": e[k][0], "at": e[k][1]} for e in found], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(sides, ["end", "mate"])

    return run


def junction_links(ways: DataFrame, key: str, turn: float = -0.5, digits: int = 7, crowd: int = 64) -> DataFrame:
    """end, mate (structs of way and at): which ends are joined.

    At a node of two ends they are joined whatever their angle. Elsewhere the straightest pair is joined first, if the cosine
    between its directions is at most ``turn``, then the straightest of the rest, and so on; of the rest, exactly two are joined too. Two ends of one way
    are never joined. Ties go to the smaller keys. Nodes of up to ``crowd`` ends are settled as one row each, in one pass; those
    of more in rounds, which gather no node.
    """
    at = lambda v: F.round(F.col(v) * 10**digits).cast("long")
    ends = save(ends_of(ways, key).select(F.struct(F.col(key).alias("way"), F.col("at")).alias("end"), F.struct(at("x").alias("x"), at("y").alias("y")).alias("node"), "tx", "ty"))
    crowded = save(ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("node"))
    many = not crowded.isEmpty()
    few = ends.join(crowded, "node", "left_anti") if many else ends
    nodes = few.groupBy("node").agg(F.collect_list(F.struct("end", "tx", "ty")).alias("stubs")).filter(F.size("stubs") > 1).select("stubs")
    kind = ends.schema["end"].dataType.simpleString()
    links = save(nodes.mapInArrow(_at_nodes(math.acos(-turn)), f"end {kind}, mate {kind}"))
    if not many:
        return links
    two = lambda e: (
        e.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("end").alias("end"), F.max("end").alias("mate")).filter((F.col("n") == 2) & (F.col("end.way") != F.col("mate.way"))).select("end", "mate")
    )
    rest = save(ends.join(crowded, "node", "left_semi"))
    while True:
        got = save(_mutual(_straightest(rest, math.acos(-turn)), "node", [F.col("off")]))
        if got.isEmpty():
            break
        links, rest = links.unionByName(got), save(_without(rest, got))
    return save(links.unionByName(two(rest)))


def _walked(gap: bool):
    """A function on Arrow batches of ways, sorted by line and key and with each line whole in one partition: (first, ways, line)."""

    def lines(rows: pa.Table) -> pa.RecordBatch:
        col = lambda c: rows.column(c).combine_chunks()
        row = {w: n for n, w in enumerate(col("way").to_pylist())}
        mate = [[-1 if w is None else row[w] for w in col(f"way{k}").to_pylist()] for k in (0, 1)]
        enter = [col(f"at{k}").to_pylist() for k in (0, 1)]
        shape = col("line")
        begin, end = (o.to_numpy().tolist() for o in (shape.offsets[:-1], shape.offsets[1:]))
        firsts = col("first")
        names = firsts.to_pylist()
        starts = [n for n in range(len(names)) if n == 0 or names[n] != names[n - 1]]
        points, sizes, ways = [], [], []
        for lo, hi in zip(starts, [*starts[1:], len(names)], strict=True):
            n, k = next(((n, k) for n in range(lo, hi) for k in (0, 1) if mate[k][n] < 0), (lo, 0))
            done, size = set(), 0
            while n not in done:
                skip = int(bool(done) and not gap)
                done.add(n)
                part = range(begin[n] + skip, end[n]) if k == 0 else range(end[n] - 1 - skip, begin[n] - 1, -1)
                points.append(np.arange(part.start, part.stop, part.step))
                size += len(part)
                if mate[1 - k][n] < 0:
                    break
                n, k = mate[1 - k][n], enter[1 - k][n]
            ways.append(len(done))
            sizes.append(size)
        taken = shape.values.take(pa.array(np.concatenate(points)))
        joined = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), taken)
        return pa.RecordBatch.from_arrays([firsts.take(pa.array(starts)), pa.array(ways, pa.int32()), joined], ["first", "ways", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            first = batch.column("first")
            last = first[len(batch) - 1]
            cut = len(batch) - 1
            while cut and first[cut - 1] == last:
                cut -= 1
            if cut or (held and held[-1].column("first")[0] != last):
                held.append(batch.slice(0, cut))
                yield lines(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield lines(pa.Table.from_batches(held))

    return run


def assembled(ways: DataFrame, key: str, links: DataFrame, gap: bool = False) -> DataFrame:
    """(first, ways, line): ways joined at linked ends into lines; first is the smallest key of a line's ways, which also begins a ring.

    With ``gap`` the linked ends keep both their points; else they are one point.
    """
    w = ways.select(F.col(key).alias("way"), "line")
    pairs = links.select(F.col("end.way").alias("a"), F.col("mate.way").alias("b"))
    comp = connected_components(w.select(F.col("way").alias("node")), pairs).select(F.col("node").alias("way"), F.col("component").alias("first"))
    sides = links.select("end", "mate").unionByName(links.select(F.col("mate").alias("end"), F.col("end").alias("mate")))
    mine = sides.groupBy(F.col("end.way").alias("way")).agg(*(F.max(F.when(F.col("end.at") == k, F.col("mate"))).alias(f"m{k}") for k in (0, 1)))
    kind = ways.schema[key].dataType.simpleString()
    rows = w.join(comp, "way").join(mine, "way", "left").select("first", "way", "line", *(F.col(f"m{k}.{v}").alias(f"{v}{k}") for k in (0, 1) for v in ("way", "at")))

    dealt = rows.repartition("first").sortWithinPartitions("first", "way")
    return dealt.mapInArrow(_walked(gap), f"first {kind}, ways int, line {kernels.LINE.simpleString()}")


def stitch_segments(ways: DataFrame, key: str = "way", turn: float = -0.5) -> DataFrame:
    """(first, ways, line): ways (key, line; keys unique) as maximal lines, going straight on at junctions; see ``junction_links``. No ways: no lines."""
    ways = save(usable(ways))
    return assembled(ways, key, junction_links(ways, key, turn))


# --- one of parallel tracks


def hugging(lines: DataFrame, key: str, near_m: float = 30.0, along: float = 0.966, samples: int = 80, degrees: float = 0.02) -> DataFrame:
    """(longer, shorter): lines that run beside a longer one along their whole length: every sampled point within ``near_m``, the
    same axis by end points. Of equal lengths the smaller key counts as longer. Points meet segments by cell."""
    line = F.col("line")
    a, b = F.element_at(line, 1), F.element_at(line, -1)
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    facts = save(lines.select(key, "line", F.round(rings.length_m(line), 6).alias("m"), F.coalesce(dx / n, F.lit(0.0)).alias("ux"), F.coalesce(dy / n, F.lit(0.0)).alias("uy")))
    step = F.greatest(F.lit(1), F.floor(F.size(line) / samples).cast("int"))
    points = facts.select(F.col(key).alias("shorter"), F.col("m").alias("m2"), F.col("ux").alias("ux2"), F.col("uy").alias("uy2"), F.posexplode(F.filter(line, lambda p, i: i % step == 0)).alias("k", "p"))
    points = points.select("*", F.col("p.x").alias("lon"), F.col("p.y").alias("lat")).drop("p")
    count = points.groupBy("shorter").agg(F.count(F.lit(1)).alias("points"))
    tiles = segment_cells(segments(facts, [key, "m", "ux", "uy"]), degrees, *reach(near_m, F.greatest(F.abs("ay"), F.abs("by"))))
    met = cells(points, "lon", "lat", degrees).join(tiles.withColumnRenamed(key, "longer"), ["cell_x", "cell_y"])
    longer = (F.col("m") > F.col("m2")) | ((F.col("m") == F.col("m2")) & (F.col("longer") < F.col("shorter")))
    met = met.filter(longer & (F.abs(F.col("ux") * F.col("ux2") + F.col("uy") * F.col("uy2")) >= along))
    met = met.filter(geo.point_segment_m("lon", "lat", "ax", "ay", "bx", "by") <= near_m)
    hits = met.groupBy("longer", "shorter").agg(F.count_distinct("k").alias("hits"))
    return hits.join(count, "shorter").filter("hits = points").select("longer", "shorter")


def drop_parallel(lines: DataFrame, key: str, near_m: float = 30.0, along: float = 0.966, samples: int = 80) -> DataFrame:
    """The lines that stay when, longest first, each line goes that runs beside a longer one that stays.

    A line is settled once all that it could go for are: rounds follow chains of lines beside each other, not the table.
    """
    lines = save(usable(lines))
    beside = save(hugging(lines, key, near_m, along, samples))
    open_ = save(lines.select(key))
    fate = None
    while not open_.isEmpty():
        known = fate if fate is not None else open_.limit(0).withColumn("kept", F.lit(True))
        over = beside.join(known.select(F.col(key).alias("longer"), "kept"), "longer", "left").groupBy(F.col("shorter").alias(key)).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("goes"), F.bool_and(F.col("kept").isNotNull()).alias("clear"))
        now = open_.join(over, key, "left").filter(F.coalesce("goes", F.lit(False)) | F.coalesce("clear", F.lit(True))).select(key, (~F.coalesce("goes", F.lit(False))).alias("kept"))
        now = save(now)
        fate, open_ = now if fate is None else fate.unionByName(now), save(open_.join(now, key, "left_anti"))
    return lines if fate is None else lines.join(fate.filter("kept").select(key), key, "left_semi")


# --- across gaps


def gap_offers(lines: DataFrame, key: str, least_m: float = 1.0, most_m: float = 1500.0, facing: float = 0.95, ahead: float = 0.9) -> DataFrame:
    """end, mate, m: pairs of ends of different lines, each way round, that face each other across a gap which opens straight ahead of both.

    East stays east at latitudes beyond a pole, where the cosine is negative.
    """
    e = ends_of(lines, key).select(F.struct(F.col(key).alias("way"), F.col("at")).alias("end"), "x", "y", "tx", "ty")
    o = e.select(F.col("end").alias("mate"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("tx").alias("tx2"), F.col("ty").alias("ty2"))
    p = spatial_join.within_distance(e, o, most_m, ("x", "y"), ("x2", "y2")).filter((F.col("end.way") != F.col("mate.way")) & (F.col("m") >= least_m))
    dx, dy = (F.col("x2") - F.col("x")) * F.abs(F.cos(F.radians((F.col("y") + F.col("y2")) / 2))), F.col("y2") - F.col("y")
    n = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    face = F.col("tx") * F.col("tx2") + F.col("ty") * F.col("ty2") <= -facing
    open_ = (-(dx / n * F.col("tx") + dy / n * F.col("ty")) >= ahead) & (dx / n * F.col("tx2") + dy / n * F.col("ty2") >= ahead)
    return p.filter(face & open_).select("end", "mate", F.round("m", 6).alias("m"))


def bridge_gaps(lines: DataFrame, key: str = "way", **how) -> DataFrame:
    """(first, ways, line): lines joined across gaps (``gap_offers``): the pair with the smallest gap first, then the next of the ends left, and so on.

    No line is joined to itself: of pairs that would close a ring, the one with the widest gap is left out. Ties go to the
    smaller keys.
    """
    lines = save(usable(lines))
    offers = save(gap_offers(lines, key, **how))
    pair = lambda: F.struct("m", F.least("end", "mate").alias("p"), F.greatest("end", "mate").alias("q"))
    links, nodes = None, lines.select(F.col(key).alias("node"))
    while True:
        best = offers.groupBy("end").agg(F.min(F.struct(pair().alias("o"), F.col("mate"))).alias("b")).select("end", "b.mate", F.col("b.o.m").alias("m"))
        got = save(_mutual(best, None, []).join(best.select("end", "mate", "m"), ["end", "mate"]))
        if got.isEmpty():
            break
        links = got if links is None else links.unionByName(got)
        # rings closed by this round: as many links as lines; the widest goes
        comp = save(connected_components(nodes, links.select(F.col("end.way").alias("a"), F.col("mate.way").alias("b"))))
        home = comp.select(F.col("node").alias("__way"), "component")
        size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("lines"))
        placed = links.withColumn("__way", F.col("end.way")).join(home, "__way").drop("__way")
        closed = placed.groupBy("component").agg(F.count(F.lit(1)).alias("links"), F.max(pair()).alias("widest")).join(size, "component").filter("links = lines")
        cut = closed.select(F.col("widest.p").alias("end"), F.col("widest.q").alias("mate"))
        links = save(links.join(cut, ["end", "mate"], "left_anti"))
        inner = offers.withColumn("w1", F.col("end.way")).withColumn("w2", F.col("mate.way"))
        inner = inner.join(home.withColumnRenamed("__way", "w1").withColumnRenamed("component", "c1"), "w1").join(home.withColumnRenamed("__way", "w2").withColumnRenamed("component", "c2"), "w2").filter("c1 <> c2")
        used = links.select(F.explode(F.array("end", "mate")).alias("end"))
        offers = inner.select("end", "mate", "m").join(used, "end", "left_anti").join(used.withColumnRenamed("end", "mate"), "mate", "left_anti")
        offers = save(offers.select("end", "mate", "m"))
    if links is None:
        return lines.select(F.col(key).alias("first"), F.lit(1).alias("ways"), "line")
    return assembled(lines, key, links.select("end", "mate"), gap=True)
