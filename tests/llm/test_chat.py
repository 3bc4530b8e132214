"""Chat trees: what is packed once, positions and intervals of tokens, and reading conversations back from them."""

import dataclasses
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import CONVS
from waymark.llm import chat_tree, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"
MORE = [
    (20, 0, "a\0b", "c"), (21, 0, "a", "b\0c"),  # roles and texts that run together
    (None, 1, "assistant", "alone"), (22, 0, "user", "<|endoftext|> é\U0001f600  x"), (22, 1, "assistant", "w " * 9000), (23, 0, "user", "<|endoftext|> é\U0001f600  x"), (23, 1, "assistant", "w " * 9000), (23, 2, "user", "go on"),
]


@pytest.fixture(scope="module")
def forest(spark):
    df = spark.createDataFrame(CONVS + MORE, SCHEMA).withColumn("node", F.lit("clash")).withColumn("size", F.lit(1))
    return chat_tree.build(df, PATH)


def test_round_trip(spark, forest):
    got = [(r["conv_id"], [(t["role"], t["text"]) for t in r["turns"]], r["loss_text"]) for r in chat_tree.read_back(forest).collect()]
    want = defaultdict(list)
    for n, (c, t, r, x) in enumerate(CONVS + MORE):
        want[c if c is not None else f"row {n}"].append(((t is not None, t or 0), r or "", x or ""))
    plain = lambda c, turns: (c if isinstance(c, int) else None, [(r, x) for _, r, x in sorted(turns)], "".join(x for _, r, x in sorted(turns) if r == "assistant"))
    assert sorted(got, key=repr) == sorted((plain(c, t) for c, t in want.items()), key=repr)
    none = chat_tree.build(spark.createDataFrame([], SCHEMA), PATH)
    assert chat_tree.read_back(none).count() == 0 and none.packed.count() == 0


def test_layout(forest):
    tree = {r["node"]: r for r in forest.nodes.collect()}
    packed = {(r["tree"], r["chunk"]): r for r in forest.packed.collect()}
    starts = {tuple(sorted((t or -1, r or "", x or "") for c2, t, r, x in CONVS if c2 == c)) for c in {r[0] for r in CONVS}}
    assert len(starts) < len(tree) and sum(len(r["tokens"]) for r in packed.values()) == sum(r["size"] for r in tree.values())
    assert all(len(r["tokens"]) == len(r["positions"]) == len(r["loss"]) <= chat_tree.CHUNK for r in packed.values())
    for r in tree.values():  # positions and intervals follow the ancestors
        up = [r]
        while up[0]["parent"]:
            up.insert(0, tree[up[0]["parent"]])
        seen = {k for a in up for k in range(a["offset"], a["offset"] + a["size"])}
        assert r["position"] == sum(a["size"] for a in up[:-1]) and r["depth"] == len(up) - 1
        assert seen == {k for s in r["attends"] for k in range(s["start"], s["end"])} and all(a["end"] < b["start"] for a, b in zip(r["attends"], r["attends"][1:]))
        at = [packed[r["tree"], k // chat_tree.CHUNK]["positions"][k % chat_tree.CHUNK] for k in range(r["offset"], r["offset"] + r["size"])]
        assert at == list(range(r["position"], r["position"] + r["size"]))
    for t in {r["tree"] for r in tree.values()}:  # gapless, and children after their parents before the next branch
        at, stack = 0, []
        for r in sorted((r for r in tree.values() if r["tree"] == t), key=lambda r: r["offset"]):
            while stack and stack[-1] != r["parent"]:
                stack.pop()
            assert r["offset"] == at and (not r["parent"] or stack)
            stack.append(r["node"])
            at += r["size"]


def test_reading_depends_on_positions_and_intervals(forest):
    moved = F.transform("attends", lambda x: F.struct((x["start"] + 1).alias("start"), (x["end"] + 1).alias("end")))
    late = F.transform("positions", lambda x: x + 1)
    for broken in (dataclasses.replace(forest, nodes=forest.nodes.withColumn("attends", moved)), dataclasses.replace(forest, packed=forest.packed.withColumn("positions", late))):
        with pytest.raises(Exception, match="positions"):
            chat_tree.read_back(broken).collect()


def test_query(spark, tmp_path):
    """The registered query: conversation -7, and digests against plain ones."""
    import hashlib

    spark.createDataFrame([r for r in CONVS if r[0]], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op8_chat_tree(spark, str(tmp_path)).collect()}
    said = r"\### Assistant: </turn> ok"
    turns = f"user\n{said}\nassistant\n{said}\n"
    r = got[-7]
    assert (r["n_turns"], r["loss_chars"]) == (2, len(said)) and r["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["formatted_chars"] == 2 * (15 + len(said) + 3) + len("userassistant")
    assert len(got) == 1 + len({r[0] for r in CONVS if r[0]})
