"""Lines through junctions, parallel tracks and gaps against versions that decide one after the other."""

import math
import random

from waymark.operators import strands

WAYS = "way long, line array<struct<x:double,y:double>>"


def frame(spark, lines):
    return spark.createDataFrame([(k, None if v is None else [{"x": float(x), "y": float(y)} for x, y in v]) for k, v in lines.items()], WAYS).repartition(3)


def rows(df):
    return sorted((r["first"], r["ways"], tuple((round(p["x"], 7), round(p["y"], 7)) for p in r["line"])) for r in df.collect())


def either(line):
    line = tuple((round(x, 7), round(y, 7)) for x, y in line)
    return min(line, line[::-1])


def unit(line, at):
    (ax, ay), (bx, by) = (line[0], line[1]) if at == 0 else (line[-1], line[-2])
    n = math.hypot(bx - ax, by - ay)
    return (bx - ax) / n, (by - ay) / n


def joined(lines, links, gap):
    """Lines from links between ends, walked from loose ends, then rings."""
    mate = {}
    for p, q in links:
        mate[p], mate[q] = q, p
    seen, out = set(), []
    for way, at in sorted([(w, k) for w in lines for k in (0, 1) if (w, k) not in mate]) + [(w, 0) for w in sorted(lines)]:
        if way in seen:
            continue
        line, ways = [], []
        while way not in seen:
            seen.add(way)
            ways.append(way)
            part = list(lines[way]) if at == 0 else list(lines[way])[::-1]
            line += part if gap or not line else part[1:]
            if (way, 1 - at) not in mate:
                break
            way, at = mate[way, 1 - at]
        out.append((min(ways), len(ways), either(line)))
    return sorted(out)


def plain_junctions(lines, turn=-0.5):
    nodes = {}
    for w, line in lines.items():
        for at, p in ((0, line[0]), (1, line[-1])):
            nodes.setdefault(tuple(round(v, 7) for v in p), []).append((w, at))
    links = []
    for stubs in nodes.values():
        left = list(stubs)
        if len(left) > 2:
            while True:
                pairs = sorted((round(abs((angle(lines, p) - angle(lines, q) + 2 * math.pi) % (2 * math.pi) - math.pi), 9), min(p, q), max(p, q)) for i, p in enumerate(left) for q in left[:i] if p[0] != q[0])
                if not pairs or pairs[0][0] > math.acos(-turn):
                    break
                links.append(pairs[0][1:])
                left = [s for s in left if s not in pairs[0][1:]]
        if len(left) == 2 and left[0][0] != left[1][0]:
            links.append(tuple(left))
    return links


def angle(lines, stub):
    x, y = unit(lines[stub[0]], stub[1])
    return math.atan2(y, x)


def test_streets_go_straight_on_at_junctions(spark):
    rng = random.Random(1)
    at = {(i, j): (139 + i * 0.01 + rng.uniform(-0.002, 0.002), 35 + j * 0.01 + rng.uniform(-0.002, 0.002)) for i in range(7) for j in range(7)}
    lines, n = {}, 0
    for i, j in at:
        for di, dj in ((1, 0), (0, 1), (1, 1)):
            if (i + di, j + dj) in at and rng.random() < 0.62:
                ends = [at[i, j], at[i + di, j + dj]]
                mid = tuple(sum(v) / 2 + rng.uniform(-0.001, 0.001) for v in zip(*ends, strict=True))
                line = [ends[0], mid, ends[1]]
                lines[n] = line if rng.random() < 0.5 else line[::-1]
                n += 1
    got = rows(strands.stitch_segments(frame(spark, lines)))
    assert [(a, b, either(c)) for a, b, c in got] == joined(lines, plain_junctions(lines), False)


def test_rings_loops_stars_and_odd_rows(spark):
    ring = {k: [(math.cos(t), math.sin(t)), (math.cos(t + 0.5), math.sin(t + 0.5)), (math.cos(t + 1), math.sin(t + 1))] for k, t in enumerate(i * 1.0 for i in range(6))}
    ring = {k: [ring[k][0], ring[k][1], ring[(k + 1) % 6][0]] for k in ring}
    star = {100 + k: [(5.0, 5.0), (5 + math.cos(k * math.pi / 20), 5 + math.sin(k * math.pi / 20))] for k in range(40)}
    loop = {300: [(9, 9), (9.5, 9), (9.5, 9.5), (9, 9)], 301: [(20, 20), (20, 20), (21, 20)]}
    lines = ring | star | {300: loop[300], 301: [(20.0, 20.0), (21.0, 20.0)]}
    odd = {k: v for k, v in lines.items()} | {301: loop[301], 400: [(1, 1)], 401: [], 402: None, 403: [(2, 2), (2, 2)]}
    got = rows(strands.stitch_segments(frame(spark, odd)))
    want = joined(lines, plain_junctions(lines), False)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and sum(b == 2 for _, b, _ in got) == 20
    assert len(next(c for a, _, c in got if a == 0)) == 13 and strands.stitch_segments(frame(spark, {})).count() == 0


def m(east, north):
    return 139.5 + east / (111320 * math.cos(math.radians(35.5))), 35.5 + north / 111320


def test_the_longest_of_parallel_tracks_stays(spark):
    rng = random.Random(2)
    lines = {}
    for k in range(60):
        x, y, n = rng.uniform(0, 3000), rng.choice([0, 12, 24, 36, 500]) + rng.uniform(-2, 2), rng.randint(2, 30)
        lines[k] = [m(x + i * 60, y + (rng.uniform(-3, 3) if k % 3 else i * (k % 7))) for i in range(n)][:: rng.choice([1, -1])]
    length = {k: round(sum(apart(p, q) for p, q in zip(v, v[1:], strict=False)), 6) for k, v in lines.items()}
    kept = []
    for k in sorted(lines, key=lambda i: (-length[i], i)):
        if not any(beside(lines[k], lines[j]) for j in kept):
            kept.append(k)
    got = sorted(r["way"] for r in strands.drop_parallel(frame(spark, lines), "way").collect())
    assert got == sorted(kept) and len(kept) < 40


def apart(p, q):
    a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def beside(short, long, near=30.0, along=0.966):
    d = lambda v: (v[-1][0] - v[0][0], v[-1][1] - v[0][1])
    (ax, ay), (bx, by) = d(short), d(long)
    if abs(ax * bx + ay * by) < along * math.hypot(ax, ay) * math.hypot(bx, by):
        return False
    for x, y in short:
        k, far = 111320 * math.cos(math.radians(y)), math.inf
        for (px, py), (qx, qy) in zip(long, long[1:], strict=False):
            ux, uy, vx, vy = (px - x) * k, (py - y) * 111320, (qx - px) * k, (qy - py) * 111320
            t = max(0, min(1, -(ux * vx + uy * vy) / (vx * vx + vy * vy)))
            far = min(far, math.hypot(ux + t * vx, uy + t * vy))
        if far > near:
            return False
    return True


def test_gaps_close_nearest_first(spark):
    rng = random.Random(5)
    lines, n = {}, 0
    for row in range(6):
        x = 0.0
        for _ in range(7):
            size = rng.uniform(500, 2500)
            line = [m(x, row * 3000 + rng.uniform(-20, 20)), m(x + size / 2, row * 3000), m(x + size, row * 3000 + rng.uniform(-20, 20))]
            lines[n] = line[:: rng.choice([1, -1])]
            n += 1
            x += size + rng.choice([0.2, 150, 700, 1400, 1800])
    links, candidates = [], []
    for a in lines:
        for b in lines:
            for i in (0, 1):
                for j in (0, 1):
                    if a < b and (g := gap(lines, (a, i), (b, j))) is not None:
                        candidates.append((round(g, 6), (a, i), (b, j)))
    group = {k: k for k in lines}
    for _, p, q in sorted(candidates):
        if group[p[0]] != group[q[0]] and not any(s in (p, q) for link in links for s in link):
            links.append((p, q))
            old, new = group[p[0]], group[q[0]]
            group = {k: new if v == old else v for k, v in group.items()}
    got = rows(strands.bridge_gaps(frame(spark, lines)))
    assert [(a, b, either(c)) for a, b, c in got] == joined(lines, links, True) and len(got) < len(lines)
    assert rows(strands.bridge_gaps(frame(spark, {1: [m(0, 0), m(10, 0)]})))[0][:2] == (1, 1)


def gap(lines, p, q):
    a, b = (lines[w][0] if k == 0 else lines[w][-1] for w, k in (p, q))
    far = apart(a, b)
    (ux, uy), (vx, vy) = unit(lines[p[0]], p[1]), unit(lines[q[0]], q[1])
    if not 1 <= far <= 1500 or ux * vx + uy * vy > -0.95:
        return None
    dx, dy = (b[0] - a[0]) * math.cos(math.radians((a[1] + b[1]) / 2)), b[1] - a[1]
    n = math.hypot(dx, dy)
    return far if -(dx * ux + dy * uy) / n >= 0.9 and (dx * vx + dy * vy) / n >= 0.9 else None
