"""Chat formatting as a prefix tree: turns that conversations share at their start are emitted once, as tokens.

A node is a distinct start of a conversation: its identifier is the digest of its parent's identifier, its role and its
text. Trees (one for each distinct first turn) are laid out depth-first. Conversations sorted by their chains of identifiers
are the tree's leaves in depth-first order, so a node's place follows from the first conversation through it and its depth,
and no task ever holds a whole tree. A tree's tokens are emitted as one sequence in chunks of a fixed length. Each token has
its position as counted along its own conversation; each node has the intervals of the sequence that it may attend to: its
ancestors' and its own, neighbouring ones merged. Reading a conversation back takes its last node's intervals, cuts them out
of the chunks and orders the tokens by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import stage, utf8

#: The template. A turn is OPEN + role + MID + text + END; control strings inside roles and texts are escaped by a backslash.
OPEN, MID, END = "### ", ": ", " </turn>\n"
#: What is escaped: each backslash, each # that two more follow, each < that begins the end mark; in roles, each colon too.
CONTROL = r"\\|#(?=##)|<(?=/turn>)"
LOSS_ROLE = "assistant"
#: Tokens of a chunk of the packed sequence.
CHUNK = 2048


def escape(col: Column, role: bool = False) -> Column:
    return F.regexp_replace(col, f"({CONTROL}{'|:' if role else ''})", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for m in re.finditer(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", text, re.DOTALL):
        turns.append((unescape(m[1]), unescape(m[2])))
    return turns


def _tokenizer(json: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json)


@dataclass
class Forest:
    """packed: tree, chunk, tokens, positions, loss (arrays of one length, CHUNK at most): the trees' sequences in chunks.

    nodes: tree, node, parent, depth, offset and size (in the tree's sequence), position (of its first token along its
    conversation), attends (array of (start, end) in the sequence: ancestors and itself). conversations: conv_id and leaf, its
    last node. tokenizer: the tokenizer file's content.
    """

    packed: DataFrame
    nodes: DataFrame
    conversations: DataFrame
    tokenizer: str


def _chains(turns: DataFrame) -> DataFrame:
    """A row a conversation: conv_id, leaf (its last node), ids (its nodes in order), owns (its turns' digests in order)."""
    order = turns.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list(F.struct("k", "own"))).alias("all"))
    order = order.select("conv_id", F.col("all.own").alias("owns"))
    kind = order.schema["conv_id"].dataType.simpleString()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains = []
            for owns in batch.column(1).to_pylist():
                ids, parent = [], b""
                for own in owns:
                    parent = hashlib.sha256(parent + own).digest()[:16]
                    ids.append(parent)
                chains.append(ids)
            leaf = pa.array([ids[-1] for ids in chains], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), leaf, pa.array(chains, pa.list_(pa.binary())), batch.column(1)], ["conv_id", "leaf", "ids", "owns"])

    return order.mapInArrow(chain, f"conv_id {kind}, leaf binary, ids array<binary>, owns array<binary>")


def _tokenised(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """nodes (node, head, body, loss) as (node, tokens, loss_start, loss_end); the three parts of a turn are encoded apart."""
    shared = nodes.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(shared.value)
        encode = lambda texts: [np.array(e.ids, np.int32) for e in tok.encode_batch(texts, add_special_tokens=False)]
        (end,) = encode([END])
        for batch in batches:
            heads, bodies, loss = (batch.column(k).to_pylist() for k in (1, 2, 3))
            known = dict(zip(some := list(dict.fromkeys(heads)), encode(some), strict=True))
            out, starts, ends = [], [], []
            for head, body, bears in zip(heads, encode(bodies), loss, strict=True):
                h = known[head]
                out.append(np.concatenate([h, body, end]))
                starts.append(len(h) if bears else 0)
                ends.append(len(h) + len(body) if bears else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["node", "tokens", "loss_start", "loss_end"])

    return nodes.mapInArrow(run, "node binary, tokens array<int>, loss_start long, loss_end long")


def build(conversations: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Forest:
    """The conversations' prefix trees.

    Turns are ordered by (turn, role, text); null roles and texts count as empty, null turns come first, repeated rows are
    turns of their own. Rows without a conv_id are conversations of one turn each. Texts may be of any length. Other columns
    are ignored; an empty table gives no trees. The tokenizer file is read once on the driver and broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        json = f.read()
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), utf8(role_col).alias("role"), utf8(text_col).alias("text"))
    turns = turns.withColumn("lone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    own = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turns = turns.withColumn("own", F.unhex(F.substring(own, 1, 32)))
    tie = F.row_number().over(Window.partitionBy("conv_id", "lone").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    turns = stage(turns.withColumn("k", tie), "chat-turns")
    chains = stage(_chains(turns.select("conv_id", "lone", "k", "own")), "chat-chains")

    # Equal conversations end in the same node: one of each goes on. Sorted by their chains they are in depth-first order.
    leaves = chains.groupBy("leaf").agg(F.first("ids").alias("ids"), F.first("owns").alias("owns")).select("ids", "owns")
    leaves = leaves.repartitionByRange("ids").sortWithinPartitions("ids")
    leaves = stage(leaves.withColumn("rank", F.monotonically_increasing_id()), "chat-leaves")
    ways = leaves.select("rank", F.col("ids")[0].alias("tree"), F.posexplode(F.arrays_zip("ids", "owns")).alias("depth", "x"))
    ways = stage(ways.select("rank", "tree", "depth", F.col("x.ids").alias("node"), F.col("x.owns").alias("own")), "chat-ways")

    firsts = ways.groupBy("node").agg(F.min(F.struct("rank", "depth", "tree", "own")).alias("x")).select("node", "x.*")
    texts = turns.groupBy("own").agg(F.first(F.struct("role", "text")).alias("said"))
    said = firsts.select("node", "own").join(texts, "own")
    head = F.concat(F.lit(OPEN), escape(F.col("said.role"), True), F.lit(MID))
    said = said.select("node", head.alias("head"), escape(F.col("said.text")).alias("body"), (F.col("said.role") == LOSS_ROLE).alias("loss"))
    tokens = stage(_tokenised(said, json), "chat-tokens")
    sized = stage(firsts.drop("own").join(tokens.select("node", F.size("tokens").cast("long").alias("size")), "node"), "chat-sized")
    nodes = _lay_out(sized, ways)
    return Forest(_pack(nodes, tokens), nodes, chains.select("conv_id", "leaf"), json)


def _lay_out(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Adds parent, offset, position and attends to (node, rank, depth, tree, size).

    Offsets are running sums within range partitions, plus what came before them in the tree.
    """
    ordered = nodes.repartitionByRange("rank", "depth").withColumn("part", F.spark_partition_id())
    ordered = stage(ordered, "chat-ordered")
    within = Window.partitionBy("tree", "part").orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, -1)
    before = ordered.groupBy("tree", "part").agg(F.sum("size").alias("all"))
    before = before.withColumn("ahead", F.coalesce(F.sum("all").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ordered.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(before.drop("all"), ["tree", "part"])
    placed = stage(placed.select("tree", "node", "rank", "size", (F.col("inside") + F.col("ahead")).alias("offset")), "chat-placed")

    # Each distinct conversation knows its nodes in order; it gives the intervals of those of which it is the first. An
    # interval is kept once a branch, so that their number grows with the branches on the way, not with its turns.
    at = ways.select("node", F.col("rank").alias("way"), "depth").join(placed, "node")
    at = at.groupBy("way", "tree").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "offset", "size", (F.col("rank") == F.col("way")).alias("own")))).alias("all"))

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        names = ["tree", "node", "parent", "depth", "offset", "size", "position", "attends"]
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), spans)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for tree, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: list[dict] = []
                position, parent = 0, None
                for x in path:
                    end = x["offset"] + x["size"]
                    if seen and seen[-1]["end"] == x["offset"]:
                        seen[-1] = {"start": seen[-1]["start"], "end": end}
                    else:
                        seen.append({"start": x["offset"], "end": end})
                    if x["own"]:
                        for column, v in zip(out, (tree, x["node"], parent, x["depth"], x["offset"], x["size"], position, list(seen)), strict=True):
                            column.append(v)
                    position += x["size"]
                    parent = x["node"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    schema = "tree binary, node binary, parent binary, depth int, offset long, size long, position long, attends array<struct<start:bigint,end:bigint>>"
    return stage(at.select("tree", "all").mapInArrow(intervals, schema), "chat-nodes")


def _pack(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """The trees' sequences in chunks: nodes' tokens cut where a chunk ends, and put together by chunk."""
    at = nodes.select("tree", "node", "offset", "size", "position").join(tokens, "node")
    at = at.withColumn("chunk", F.explode(F.sequence(F.expr(f"offset div {CHUNK}"), F.expr(f"(offset + size - 1) div {CHUNK}"))))
    at = at.withColumn("from", F.greatest(F.lit(0), F.col("chunk") * CHUNK - F.col("offset"))).withColumn("to", F.least("size", (F.col("chunk") + 1) * CHUNK - F.col("offset")))
    piece = F.struct(
        (F.col("offset") + F.col("from")).alias("at"), F.slice("tokens", F.col("from").cast("int") + 1, (F.col("to") - F.col("from")).cast("int")).alias("tokens"), (F.col("position") + F.col("from")).alias("position"),
        (F.col("loss_start") - F.col("from")).alias("loss_start"), (F.col("loss_end") - F.col("from")).alias("loss_end"),
    )
    parts = at.groupBy("tree", "chunk").agg(F.array_sort(F.collect_list(piece)).alias("all"))
    each = lambda f: F.flatten(F.transform("all", lambda x: F.transform(x["tokens"], lambda t, i: f(x, i))))
    loss = each(lambda x, i: (i >= x["loss_start"]) & (i < x["loss_end"]))
    return stage(parts.select("tree", "chunk", F.flatten("all.tokens").alias("tokens"), each(lambda x, i: (x["position"] + i).cast("int")).alias("positions"), loss.alias("loss")), "chat-packed")


def read_back(forest: Forest) -> DataFrame:
    """One row a conversation, read from the packed sequences: conv_id, turns (array of (role, text)), loss_text, formatted_chars.

    Nothing is taken but the chunks, and the intervals of each conversation's last node. The parts of the intervals are
    ordered by the positions of their tokens; if those don't go on from 0 without a gap, an error is raised. Equal
    conversations are read once.
    """
    ends = forest.conversations.select(F.col("leaf").alias("node")).distinct().join(forest.nodes.select("tree", "node", "attends"), "node")
    spans = ends.select("tree", F.col("node").alias("leaf"), F.explode("attends").alias("x")).select("tree", "leaf", "x.*")
    spans = spans.withColumn("chunk", F.explode(F.sequence(F.expr(f"start div {CHUNK}"), F.expr(f"(end - 1) div {CHUNK}"))))
    first = F.greatest(F.col("start") - F.col("chunk") * CHUNK, F.lit(0)).cast("int")
    last = F.least(F.col("end") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("int")
    spans = spans.select("tree", "chunk", "leaf", first.alias("first"), (last - first).alias("n"))
    cut = [F.slice(c, F.col("first") + 1, F.col("n")).alias(c) for c in ("tokens", "loss")]
    ends = [F.get("positions", F.col("first")).alias("from"), F.get("positions", F.col("first") + F.col("n") - 1).alias("to")]
    parts = spans.join(forest.packed, ["tree", "chunk"]).select("leaf", F.struct(*ends, *cut).alias("part"))
    whole = parts.groupBy("leaf").agg(F.array_sort(F.collect_list("part")).alias("all"))
    whole = whole.select("leaf", *(F.col(f"all.{c}").alias(c) for c in ("from", "to")), F.transform("all", lambda x: F.size(x["tokens"])).alias("sizes"), *(F.flatten(f"all.{c}").alias(c) for c in ("tokens", "loss")))
    shared = whole.sparkSession.sparkContext.broadcast(forest.tokenizer)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(shared.value)
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns, loss, size = [], [], []
            for k in range(batch.num_rows):
                start, last, sizes, ids, mask = (np.asarray(batch.column(c)[k].values.to_numpy(zero_copy_only=False)) for c in range(1, 6))
                due = np.cumsum(sizes) - sizes
                if not (np.array_equal(start, due) and np.array_equal(last, due + sizes - 1)):
                    raise ValueError("the positions of a conversation's tokens don't follow each other")
                text = tok.decode(ids.tolist(), skip_special_tokens=False)
                turns.append([{"role": r, "text": t} for r, t in read_turns(text)])
                loss.append(unescape(tok.decode(ids[mask.astype(bool)].tolist(), skip_special_tokens=False)))
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), pa.array(loss, pa.string()), pa.array(size, pa.int64())], ["leaf", "turns", "loss_text", "formatted_chars"])

    said = whole.mapInArrow(read, "leaf binary, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")
    return forest.conversations.join(said, "leaf").drop("leaf")


def digest(read: DataFrame) -> DataFrame:
    """read_back's rows as counts and digests."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")
