"""SimHash near-duplicates: fingerprints, all links within a Hamming budget, connected components.

Links come from a self-join of a binary trie over the distinct fingerprints. Two fingerprints that differ in at most
``budget`` bits agree in one of ``budget + 1`` blocks of bits, and again in one of as many blocks of what is left. So the
trie is built over bit orders that bring a pair of such blocks to the front: below an agreed front the two sides of a link
are in one subtree, and subtrees are spread over the cluster. Within a subtree, node pairs are walked together, level by
level: each pair carries the bits by which its sides already differ, and is dropped when they exceed the budget, or when
all below it is known to be connected. What leaves a subtree are edges that connect what it links, never all pairs of a
group; components then come from star contractions of those edges. In small subtrees all rows are compared with each other.

Budgets as wide as similarities of 0.8 need (a sixth of all bits) leave no block that must agree. ``near_copies`` therefore
walks the same trie over random bit orders of 128-bit fingerprints and counts a link only when the texts' shingles agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import measured, stage, utf8
from waymark.llm.exact_dedup import keep_rows, number_rows
from waymark.operators.graph import contracted

BITS = 64
#: Node pairs that a walk holds at a time; the rest waits on a stack.
FRONT = 1 << 16
#: Subtrees of up to so many rows are compared row by row, so many pairs at a time; larger ones are walked.
LEAF, PAIRS = 256, 1 << 19

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def word_starts(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's words joined by spaces, A-Z as a-z, and where each begins and ends. ASCII white space separates words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: ASCII letters and white space only
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1)) if words else end
    return b" ".join(words), start, end


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, repeats included; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    joined, start, end = word_starts(text)
    if not len(start):
        return np.zeros(0, np.uint64)
    if len(start) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(start[: 1 - shingle].tolist() if shingle > 1 else start.tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number with its bits spread over all of it, by MurmurHash3's finalizer."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: A number for each byte, and an odd base; powers of it and of its inverse are kept for texts of up to a megabyte.
_OF_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n - 1 at least of the base, and of its inverse."""
    if _POWERS and n <= len(_POWERS[0]):
        return _POWERS
    bases = (_BASE, pow(_BASE, -1, 1 << 64))
    out = [np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n, 1 << 16) - 1, b, np.uint64))) for b in bases]
    if n <= 1 << 20:
        _POWERS[:] = out
    return out


def run_hashes(text: str, shingle: int) -> np.ndarray:
    """A 64-bit hash of the same runs of words as ``shingle_hashes``, all at once.

    A run is a polynomial in its bytes' numbers, a difference of running sums over the text, brought to its own start and mixed.
    """
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = (b == 32) | ((b > 8) & (b < 14))
    kept = ~space
    kept[1:] |= ~space[:-1]  # of the white space behind a word the first byte, as a space
    joined = np.where(space, np.uint8(32), b)[kept]
    end = np.flatnonzero(joined == 32)
    if len(joined) and joined[-1] != 32:
        end = np.append(end, len(joined))
    if not len(end):
        return np.zeros(0, np.uint64)
    start = np.append(0, end[:-1] + 1)
    start, end = (start[:1], end[-1:]) if len(start) <= shingle else (start[: len(start) - shingle + 1], end[shingle - 1 :])
    up, down = _powers(len(joined))
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_OF_BYTE[joined] * up[: len(joined)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * down[start])


def majority(h: np.ndarray) -> np.ndarray:
    """For rows of hashes, a row of the bits set in over half of them."""
    width = h.shape[1]
    at = np.arange(8 * width) * 256
    counts = np.bincount((np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8 * width) + at).ravel(), minlength=2048 * width).reshape(8 * width, 256)
    ones = counts.astype(np.float64) @ _BYTE_BITS  # by byte, little end first, and bit; whole numbers, exact
    return np.packbits((ones * 2 > len(h)).astype(np.uint8), axis=1, bitorder="little").ravel().view(np.uint64)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The bits set in over half the XXH64 hashes of a text's word shingles; 0 for a text without words."""
    h = shingle_hashes(text, shingle, seed)
    return int(majority(h[:, None])[0]) if len(h) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def bit_orders(budget: int) -> list[list[int]]:
    """Orders of the 64 bits: each brings one block, and one block of the rest, to the front."""
    cut = lambda bits: [list(x) for x in np.array_split(np.array(bits), budget + 1)]
    orders = []
    for block in cut(range(BITS)):
        rest = [b for b in range(BITS) if b not in block]
        for second in cut(rest):
            orders.append([int(b) for b in block + second + [b for b in rest if b not in second]])
    return orders


def front_bits(budget: int) -> int:
    block = BITS // (budget + 1)
    return block + (BITS - block) // (budget + 1)


def reorder(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Rows of words with bit order[0] as the topmost of the first word, and so on."""
    out = np.zeros_like(fp)
    for place, bit in enumerate(order):
        word, at = divmod(place, BITS)
        out[:, word] |= ((fp[:, bit // BITS] >> np.uint64(bit % BITS)) & np.uint64(1)) << np.uint64(BITS - 1 - at)
    return out


class Joined:
    """Disjoint sets over positions, as an array of parents, and the pairs that joined them: a row (a, b, owner) each, of which
    a position owns one at most."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[np.ndarray] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            n = self.up[r]
            if (n == r).all():
                self.up[x] = r
                return r
            r = n

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of each pair; of pairs that join the same sets the first one is an edge."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            child, first = np.unique(np.maximum(ra, rb), return_index=True)  # a root gets one parent, below itself
            self.up[child] = np.minimum(ra, rb)[first]
            self.edges.append(np.column_stack([a[first], b[first], child]))


def differing(tree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(tree[a] ^ tree[b]).sum(1)


def meet(tree: np.ndarray, roots: np.ndarray, budget: int, sets: Joined) -> None:
    """Link the rows of each range that differ in at most ``budget`` bits, the nearest first: every pair in a range is compared."""
    size = roots[:, 1] - roots[:, 0]
    part = np.cumsum(size * (size - 1) // 2) // PAIRS
    for chunk in np.split(roots, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(roots) else ():
        n = chunk[:, 1] - chunk[:, 0]
        a = np.repeat(chunk[:, 0] - np.cumsum(n) + n, n) + np.arange(n.sum())  # the rows
        left = np.repeat(chunk[:, 1], n) - a - 1  # and how many stand behind each in its range
        b = np.arange(left.sum()) + np.repeat(a + 1 - np.cumsum(left) + left, left)
        a = np.repeat(a, left)
        far = np.zeros(len(a), np.int64)
        for column in tree.T[::-1]:  # the last word differs most, as rows agree in their first bits
            far += np.bitwise_count(column[a] ^ column[b])
            near = np.flatnonzero(far <= budget)
            a, b, far = a[near], b[near], far[near]
        order = np.argsort(far, kind="stable")
        sets.link(a[order], b[order])


def walk(tree: np.ndarray, roots: list[tuple[int, int]] | np.ndarray, depth: int, budget: int, sets: Joined | None = None) -> Joined:
    """For sorted distinct rows of words, a trie of which nodes are ranges: the sets of linked rows, and edges that join them.

    ``roots`` are ranges whose rows agree in their first ``depth`` bits. Pairs of nodes at one level are walked together;
    ``d`` counts the bits in which the two sides differ so far. ``sets`` may hold what is known already.
    """
    sets = sets or Joined(len(tree))
    bits = tree.shape[1] * BITS
    roots = np.asarray(roots, np.int64).reshape(-1, 2)
    stack = [(np.column_stack([roots, roots, np.zeros(len(roots), np.int64)])[i : i + FRONT], depth) for i in range(0, len(roots), FRONT)]
    while stack:
        front, level = stack.pop()
        if len(front) > FRONT:
            stack += [(front[i : i + FRONT], level) for i in range(0, len(front), FRONT)]
            continue
        a0, a1, b0, b1, d = front.T
        one = (a1 - a0 == 1) & (b1 - b0 == 1)
        if one.any():
            x, y = a0[one], b0[one]
            far = differing(tree, x, y)
            near = np.flatnonzero(far <= budget)
            near = near[np.argsort(far[near], kind="stable")]  # the nearest become edges
            sets.link(x[near], y[near])
        # pairs of ranges whose difference so far leaves room for all that is left of the bits: each range is a chain
        room = np.flatnonzero(~one & (d + (bits - level) <= budget))
        if len(room):
            lo, hi = np.concatenate([a0[room], b0[room]]), np.concatenate([a1[room], b1[room]])
            size = hi - lo - 1
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            sets.link(at, at + 1)
            sets.link(a0[room], b0[room])
        go = ~one
        go[room] = False
        # a node paired with itself that holds one number has no pair
        go &= ~((a0 == b0) & (a1 - a0 == 1))
        if not go.any():
            continue
        a0, a1, b0, b1, d = front[go].T
        split = lambda lo, hi: _split(tree, lo, hi, level)
        am, bm = split(a0, a1), split(b0, b1)
        same = a0 == b0
        kids = [np.column_stack(x) for x in ((a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1))]
        other = np.column_stack((am, a1, b0, bm, d + 1))[~same]
        new = np.concatenate([*kids, other])
        new = new[(new[:, 0] < new[:, 1]) & (new[:, 2] < new[:, 3]) & (new[:, 4] <= budget)]
        if len(new):
            new = new[~_settled(sets, new)]
            stack.append((new, level + 1))
    return sets


def _split(tree: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """Where in each range the bit at this level turns from 0 to 1; a binary search in all ranges at once."""
    word, at = divmod(level, BITS)
    bit, column = np.uint64(1) << np.uint64(BITS - 1 - at), tree[:, word]
    lo, hi = lo.copy(), hi.copy()
    while (live := lo < hi).any():
        mid = (lo + hi) // 2
        up = live & ((column[np.minimum(mid, len(column) - 1)] & bit) == 0)
        down = live & ~up
        lo[up] = mid[up] + 1
        hi[down] = mid[down]
    return lo


def _settled(sets: Joined, pairs: np.ndarray) -> np.ndarray:
    """Pairs of ranges, up to 32 wide, all of whose members are in one set already."""
    width = np.maximum(pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2])
    done = np.zeros(len(pairs), bool)
    check = np.flatnonzero(width <= 32)
    if len(check):
        p = pairs[check]
        root = sets.roots(p[:, 0])
        ok = (p[:, 0] != p[:, 2]) | (p[:, 1] - p[:, 0] > 1)
        for k in range(int(width[check].max())):
            for lo, hi in ((0, 1), (2, 3)):
                at = np.minimum(p[:, lo] + k, p[:, hi] - 1)
                ok &= sets.roots(at) == root
        done[check] = ok
    return done


def _ranges(*sorted_by: np.ndarray) -> np.ndarray:
    """Runs of two or more rows with equal entries, as (start, end)."""
    new = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    cut = np.flatnonzero(np.concatenate(([True], new, [True])))
    runs = np.column_stack([cut[:-1], cut[1:]])
    return runs[runs[:, 1] - runs[:, 0] > 1]


def trie_edges(distinct: DataFrame, words: list[str], orders: list[list[int]], depth: int, budgets: list[int]) -> DataFrame:
    """Edges between distinct fingerprints, columns ``words`` with _a, _b and _o: they connect what differs in at most the last
    of ``budgets`` bits and agrees in the first ``depth`` bits of one of the orders.

    Smaller budgets are walked first, so that edges join the nearest. Each edge has an owner (_o), who has one in an order at
    most: edges are never more than fingerprints times orders.
    """
    n = len(words)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.column_stack([np.asarray(batch.column(k)).view(np.uint64) for k in range(n)])
            for k, order in enumerate(orders):
                turned = reorder(fp, order)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), *(pa.array(turned[:, w].view(np.int64)) for w in range(n))], ["k", *words])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's rows are sorted, so that each (k, front) is a run: a subtree, walked with all others."""
        parts = [[np.asarray(b.column(0)), *(np.asarray(b.column(1 + w)).view(np.uint64) for w in range(n))] for b in batches]
        if not parts:
            return
        k, *cols = (np.concatenate(x) for x in zip(*parts, strict=True))
        t = np.column_stack(cols)
        sort = np.lexsort((*t.T[::-1], k))
        k, t = k[sort], t[sort]
        roots = _ranges(k, t[:, 0] >> np.uint64(BITS - depth))
        sets, few = Joined(len(t)), roots[:, 1] - roots[:, 0] <= LEAF
        meet(t, roots[few], budgets[-1], sets)
        for budget in budgets if not few.all() else ():
            sets = walk(t, roots[~few], depth, budget, sets)
        if not sets.edges:
            return
        e = np.concatenate(sets.edges)
        for which in np.unique(k[e[:, 0]]):
            mine = e[k[e[:, 0]] == which]
            back = np.argsort(np.array(orders[which]))  # undoes the order: bit b stands at place back[b]
            undo = [BITS * (p // BITS) + BITS - 1 - p % BITS for p in range(n * BITS)]
            undo = [int(BITS * (back[b] // BITS) + BITS - 1 - back[b] % BITS) for b in undo]
            ends = [reorder(t[mine[:, c]], undo) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(v[:, w].view(np.int64)) for v in ends for w in range(n)], [f"{w}_{s}" for s in "abo" for w in words])

    schema = ", ".join(f"{w} long" for w in words)
    turned = distinct.select(*words).mapInArrow(spread, f"k int, {schema}")
    return turned.repartition("k", F.shiftrightunsigned(words[0], BITS - depth)).mapInArrow(join, ", ".join(f"{w}_{s} long" for s in "abo" for w in words))


def links(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """(a, b), fingerprints: edges that connect all that is linked within ``budget`` bits, a few a fingerprint."""
    edges = trie_edges(distinct, ["fp"], bit_orders(budget), front_bits(budget), [budget])
    return edges.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Batches of edges become the stars of their own components first. Then large and small stars in turn: each node's
    neighbours above it move to its smallest neighbour, until nothing moves. Rounds grow with the logarithm of the longest chain. Groups are aggregated and joined, never collected. If
    ``max_rounds`` don't settle the stars, an error is raised; no result is cut short.
    """
    e = stage(contracted(edges).select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), "star")
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = state(e)
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u <> v").distinct(), "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = stage(small.filter("u <> v").distinct(), "star")
        now = state(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, budget: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fp, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable over links).

    Null texts count as empty; all texts without words have fingerprint 0 and are linked as any others. Repeated rows give a
    row each. Null ids never name a component unless it has no other. Other columns are ignored; no rows give no rows.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = stage(components(links(distinct, budget)), "simhash-roots")
    place = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    ids = place.groupBy("root").agg(F.min("first").alias("component_id"))
    label = stage(place.join(ids, "root").select(F.col("fp").alias("l_fp"), "component_id"), "simhash-labels")
    out = fps.join(label, F.col("fp") == F.col("l_fp"))
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, budget: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near_duplicates(), with all its columns: one with the smallest id, null ids after all others.

    Rows are decided one by one, also those that share an id or have none.
    """
    rows = number_rows(docs, id_col, "simhash-rows")
    return keep_rows(rows, near_duplicates(rows, budget, shingle, "__key", text_col).filter("doc_id <> component_id"))


#: near_copies' bit orders and walk. A pair of similarity s differs in a share p = acos(2s / (1 + s)) / pi of its bits, and
#: meets in one of ``tables`` random fronts of ``front`` bits with probability 1 - (1 - (1 - p) ** front) ** tables. At
#: s = 0.8 that is 0.98 with (16, 56); (24, 200) gives as much where a front's subtrees, 2 ** -front of all fingerprints
#: each, are too large. Bits of one pair vary together, so measured recall is a little lower (README).
FRONT_BITS, TABLES, WIDE_BUDGETS = 16, 56, (14, 28)


def random_orders(words: int, tables: int, seed: int = 11) -> list[list[int]]:
    rng = np.random.default_rng(seed)
    return [rng.permutation(words * BITS).tolist() for _ in range(tables)]


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """128 bits of a set of shingle hashes: the majority of each hash and of a second one made from it; 0 for no shingle."""
    if not len(h):
        return np.zeros(2, np.uint64)
    g = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    g = (g ^ (g >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(np.column_stack([h, g ^ (g >> np.uint64(31))]))


def wide_fingerprints(docs: DataFrame, key: str, text_col: str, shingle: int) -> DataFrame:
    """(key, fp0, fp1) of the distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([wide_fingerprint(np.unique(run_hashes(t, shingle))) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp[:, 0]), pa.array(fp[:, 1])], ["key", "fp0", "fp1"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), utf8(text_col).alias("text")).mapInArrow(run, f"key {kind}, fp0 long, fp1 long")


def _similar(pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of (a, b, text_a, text_b), the pairs (a, b, same): whether the Jaccard similarity of their shingles is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.unique(run_hashes(x, shingle)), np.unique(run_hashes(y, shingle))
                both = len(np.intersect1d(p, q, assume_unique=True))
                same.append(both >= least * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], ["a", "b", "same"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, same boolean")


def similar_groups(candidates: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(node, root): groups that all candidates (a, b, far, owner) with similar texts (node, text) connect.

    In rounds: each owner's nearest open candidate is compared first, then the next 64, and so on. Similar ones join their
    nodes; candidates inside a joined group need no comparison, all others are compared in the end.
    """
    rest = stage(candidates, "near-open")
    good, root, quota = None, rest.select(F.col("a").alias("node"), F.col("a").alias("root")), 1
    while not rest.isEmpty():
        turn = rest.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("far", "a", "b"))).alias("all"))  # one in an order at most
        turn = turn.select(F.explode(F.slice("all", 1, quota)).alias("x")).select("x.a", "x.b")
        pairs = turn.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        seen = stage(_similar(pairs, shingle, least), "near-compared")
        same = seen.filter("same").select("a", "b")
        good = stage(same if good is None else good.union(same), "near-edges")
        root = stage(components(good), "near-groups")
        rest = rest.join(seen.select("a", "b"), ["a", "b"], "left_anti")
        for side in "ab":
            rest = rest.join(root.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
        rest = stage(rest.filter("ra IS NULL OR rb IS NULL OR ra <> rb").select("a", "b", "far", "owner"), "near-open")
        quota *= 64
    return root


def centre_pairs(nodes: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """Further candidates (a, b, far, owner): in each group that the edges (a, b) connect, the node nearest to the group's
    majority of bits with every other within ``budget`` bits of it.

    Copies of one text differ from each other by twice what they differ from the text, so that edges to the nearest may all
    lead to other copies; the majority of their bits leads to the text. Only sums of bits and smallest rows are gathered.
    """
    group = nodes.join(stage(components(edges), "near-wide"), "node").select("node", "fp0", "fp1", "root")
    bits = [(c, k, f"{c}_{k}") for c in ("fp0", "fp1") for k in range(BITS)]
    sums = group.groupBy("root").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.shiftrightunsigned(c, k).bitwiseAND(1)).alias(name) for c, k, name in bits)).filter("n > 2")
    centre = {c: reduce(Column.bitwiseOR, (F.when(F.col(name) * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")) for x, k, name in bits if x == c)) for c in ("fp0", "fp1")}
    centres = measured(stage(sums.select("root", centre["fp0"].alias("c0"), centre["fp1"].alias("c1")), "near-centres"))
    far = lambda a, b: F.bit_count(F.col("fp0").bitwiseXOR(F.col(a))) + F.bit_count(F.col("fp1").bitwiseXOR(F.col(b)))
    middle = group.join(centres, "root").groupBy("root").agg(F.min(F.struct(far("c0", "c1").alias("far"), "node", "fp0", "fp1")).alias("m"))
    middle = measured(stage(middle.select("root", F.col("m.node").alias("mid"), F.col("m.fp0").alias("m0"), F.col("m.fp1").alias("m1")), "near-middles"))
    pairs = group.join(middle, "root").withColumn("far", far("m0", "m1")).filter(f"node <> mid AND far <= {budget}")
    return pairs.select(F.least("node", "mid").alias("a"), F.greatest("node", "mid").alias("b"), "far", F.xxhash64("fp0", "fp1").alias("owner"))


def near_copies(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", front: int = FRONT_BITS, tables: int = TABLES, budgets: tuple[int, ...] = WIDE_BUDGETS) -> DataFrame:
    """The rows of docs with one of each group of near copies, all columns: one with the smallest id, null ids after all others.

    Two texts are near copies if the Jaccard similarity of their distinct ``shingle``-word runs is ``least`` or more; groups
    are what such pairs connect. Candidates are pairs of 128-bit fingerprints that agree in one of ``tables`` fronts and
    differ in at most the last of ``budgets`` bits, and of each group's middle with all others; each that matters is then
    compared by its texts' shingles, so nothing less similar is joined. What is missed is stated in the README. Texts of equal
    128-bit fingerprints are near copies; texts without words are one group. Null texts count as empty. Rows are decided one by one, also those that share an id or have none; an empty table gives no rows.
    """
    rows = number_rows(docs, id_col, "near-rows")
    fps = stage(wide_fingerprints(rows, "__key", text_col, shingle), "near-fingerprints")
    distinct = stage(fps.groupBy("fp0", "fp1").agg(F.min("key").alias("first")).withColumn("node", F.col("first.row")), "near-distinct")
    edges = trie_edges(distinct, ["fp0", "fp1"], random_orders(2, tables), front, list(budgets))
    far = F.bit_count(F.col("fp0_a").bitwiseXOR(F.col("fp0_b"))) + F.bit_count(F.col("fp1_a").bitwiseXOR(F.col("fp1_b")))
    edges = edges.select("*", far.alias("far"), F.xxhash64("fp0_o", "fp1_o").alias("owner"))
    for side in "ab":
        of = distinct.select(F.col("fp0").alias(f"fp0_{side}"), F.col("fp1").alias(f"fp1_{side}"), F.col("node").alias(side))
        edges = edges.join(of, [f"fp0_{side}", f"fp1_{side}"])
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "far", "owner"), "near-found")
    edges = edges.union(centre_pairs(distinct, edges, budgets[-1])).groupBy("a", "b").agg(F.min("far").alias("far"), F.min("owner").alias("owner"))
    edges = stage(edges, "near-candidates")
    nodes = measured(stage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-nodes"))
    texts = rows.select(F.col("__key.row").alias("node"), utf8(text_col).alias("text")).join(nodes, "node", "left_semi")
    roots = similar_groups(edges, stage(texts, "near-texts"), shingle, least)
    label = distinct.join(roots, "node", "left").select("fp0", "fp1", "first", F.coalesce("root", "node").alias("root"))
    keep = label.groupBy("root").agg(F.min("first").alias("keep"))
    label = stage(label.join(keep, "root").select("fp0", "fp1", "keep"), "near-labels")
    gone = fps.join(label, ["fp0", "fp1"]).filter("key <> keep").select(F.col("key").alias("doc_id"))
    return keep_rows(rows, gone)
