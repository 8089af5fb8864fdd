"""Chat formatting into a prefix tree.

Conversations are written with a turn template whose control strings are escaped inside texts, so the format
reads back exactly. Conversations that begin with the same turns share those turns' nodes: each node's tokens
stand once in its tree's stream, depth first, with the position id of its first token and the intervals of the
stream that it may attend to (its ancestors).

Template, per turn: ``### ROLE: TEXT</turn>`` and a line feed. In texts a backslash goes before ``\\``, ``#`` and
``<``, in roles before ``:`` too; so no control string can stand unescaped in them. Tokens of the mark-up and of
the text are encoded apart, and the loss mask covers exactly the text tokens of the assistant.

Equal conversations are one leaf. Leaves are range-sorted by their path of node digests, which is depth-first
order; a leaf adds the nodes that it doesn't share with the leaf before it, and stream offsets are running sums
in two levels (inside a partition, then over partitions), so a first turn that a third of all conversations
share is spread over as many partitions as its leaves.

Defined cases: null text and null role are empty; rows of a conversation come by turn, then role, then text, and
repeated rows are turns of their own; null conv_id is one conversation; empty tables give no rows; further columns
are ignored. One conversation is one training sample and is held by one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import cut, salted_join, slices, spread_join, table
from candlespark.llm.tokenize import tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LEARNT_ROLE = "assistant"


def escape(text: str, marks: str = "\\#<") -> str:
    """``text`` with a backslash before every one of ``marks``."""
    return "".join("\\" + c if c in marks else c for c in text) if any(m in text for m in marks) else text


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return ESCAPED.sub(r"\1", text)


def parts_of(role: str, text: str) -> tuple[str, str, str]:
    """A formatted turn: mark-up before the text, the escaped text, mark-up after it."""
    marked = escape(role, "\\#<:")
    return f"### {marked}: ", escape(text), "</turn>\n"


@lru_cache(maxsize=2)
def encoding(name: str):
    """A lossless byte-level encoding of ``tiktoken`` from a public vocabulary file."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def conversations_of(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` to conv_id, leaf, path (node digests) and turns (role, text)."""
    turn = F.struct(F.col("turn").isNull().alias("n"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            paths = []
            for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                at, path = b"", []
                for role, text in zip(roles, texts):
                    role, text = role.encode(), text.encode()
                    at = hashlib.blake2b(at + len(role).to_bytes(8, "little") + role + text, digest_size=8).digest()
                    path.append(int.from_bytes(at, "little", signed=True))
                paths.append(path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([p[-1] for p in paths], pa.int64()), pa.array(paths, pa.list_(pa.int64())), batch.column("roles"), batch.column("texts")],
                names=["conv_id", "leaf", "path", "roles", "texts"],
            )

    return grouped.mapInArrow(run, "conv_id long, leaf long, path array<long>, roles array<string>, texts array<string>")


def encoded(leaves: DataFrame, vocabulary: str) -> DataFrame:
    """``leaves`` with, per turn, its token ids and the range of its text tokens that the loss covers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoding(vocabulary)
        for batch in slices(batches, 200):
            ids, lo, hi = [], [], []
            for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                rows = []
                for role, text in zip(roles, texts):
                    before, body, after = (enc.encode_ordinary(p) for p in parts_of(role, text))
                    end = len(before) + len(body)
                    rows.append((before + body + after, len(before) if role == LEARNT_ROLE else end, end))
                for out, values in zip((ids, lo, hi), zip(*rows)):
                    out.append(list(values))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("path"), pa.array(ids, pa.list_(ints)), pa.array(lo, ints), pa.array(hi, ints)], names=["leaf", "path", "ids", "loss_from", "loss_to"])

    return leaves.select("leaf", "path", "roles", "texts").mapInArrow(run, "leaf long, path array<long>, ids array<array<int>>, loss_from array<int>, loss_to array<int>")


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves(leaf, path, lengths)`` with root, shared (nodes in common with the leaf before) and base (offset
    in the root's stream of the first node that the leaf adds)."""
    rows = leaves.repartitionByRange(F.col("path")).sortWithinPartitions("path").withColumn("pid", F.spark_partition_id())
    rows = cut(rows.withColumn("root", F.element_at("path", 1)))
    ends = rows.groupBy("pid").agg(F.max("path").alias("end"))
    ends = ends.select("pid", F.lag("end").over(Window.orderBy("pid")).alias("end"))
    before = F.lag("path").over(Window.partitionBy("pid").orderBy("path"))
    rows = rows.join(F.broadcast(ends), "pid").withColumn("before", F.coalesce(before, F.col("end"), F.array().cast("array<long>")))
    rows = rows.withColumn("shared", F.size(F.array_intersect("path", "before"))).drop("before", "end")
    own = F.aggregate(F.slice("lengths", F.col("shared") + 1, F.size("lengths")), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = cut(rows.withColumn("own", own))
    inside = Window.partitionBy("root", "pid").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("root", "pid").agg(F.sum("own").alias("own"))
    over = Window.partitionBy("root").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("root", "pid", F.coalesce(F.sum("own").over(over), F.lit(0)).alias("begin"))
    rows = rows.withColumn("inner", F.coalesce(F.sum("own").over(inside), F.lit(0))).join(blocks, ["root", "pid"])
    return rows.withColumn("base", F.col("begin") + F.col("inner")).select("leaf", "root", "path", "lengths", "shared", "base")


def prefix_tree(leaves: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The trees' nodes: root, node, parent, depth, start (offset in the root's stream), position (id of the
    first token), ids, loss_from, loss_to, and attends (intervals of the stream, itself last)."""
    text = cut(encoded(leaves, vocabulary))
    where = cut(placed(text.select("leaf", "path", F.transform("ids", lambda x: F.size(x).cast("long")).alias("lengths"))))

    def unfold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 200):
            out = {c: [] for c in ("leaf", "root", "node", "parent", "depth", "start", "position", "length", "shared")}
            for row in batch.to_pylist():
                position, start, parent = 0, row["base"], None
                for depth, (node, length) in enumerate(zip(row["path"], row["lengths"])):
                    added = depth >= row["shared"]
                    for c, v in zip(out, (row["leaf"], row["root"], node, parent, depth, start if added else None, position, length, not added)):
                        out[c].append(v)
                    position, parent = position + length, node
                    start += length if added else 0
            kinds = (pa.int64(),) * 4 + (pa.int32(),) + (pa.int64(),) * 3 + (pa.bool_(),)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    nodes = cut(where.mapInArrow(unfold, "leaf long, root long, node long, parent long, depth int, start long, position long, length long, shared boolean"))
    own = nodes.where("NOT shared")
    shared = nodes.where("shared").select("leaf", "node", "depth", "length")
    used = shared.groupBy("node").agg(F.count("*").alias("m")).join(own.select("node", "start"), "node")
    shared = spread_join(shared, used, "node", "m")
    span = F.struct("depth", "start", (F.col("start") + F.col("length")).alias("end"))
    spans = shared.select("leaf", span.alias("span")).unionByName(own.select("leaf", span.alias("span")))
    spans = spans.groupBy("leaf").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    facts = own.join(spans, "leaf").join(text.select("leaf", "ids", "loss_from", "loss_to"), "leaf")
    at = F.col("depth") + 1
    step = lambda a, s: F.when((F.size(a) > 0) & (F.element_at(F.coalesce(a, F.array()), -1)["end"] == s["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), s["end"].alias("end"))))).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    joined = F.aggregate(F.slice("spans", 2, F.col("depth")), F.transform(F.slice("spans", 1, 1), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), step)
    return facts.select(
        "root", "node", "parent", "depth", "start", "position",
        F.element_at("ids", at).alias("ids"), F.element_at("loss_from", at).alias("loss_from"), F.element_at("loss_to", at).alias("loss_to"),
        joined.alias("attends"),
    )


def read_back(tree: DataFrame, paths: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Conversations decoded from a tree's nodes along ``paths(leaf, path)``: leaf, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    steps = paths.select("leaf", F.posexplode("path").alias("depth", "node"))
    found = salted_join(steps, tree.select("node", "ids", "loss_from", "loss_to"), "node", "leaf")
    found = found.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "ids", "loss_from", "loss_to"))).alias("nodes"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoding(vocabulary)
        for batch in slices(batches, 100):
            out = []
            for nodes in batch.column("nodes").to_pylist():
                whole = enc.decode_bytes([i for n in nodes for i in n["ids"]]).decode()
                loss = unescape("".join(enc.decode_bytes(n["ids"][n["loss_from"] : n["loss_to"]]).decode() for n in nodes))
                turns, at = hashlib.sha256(), 0
                count = 0
                for m in TURN.finditer(whole):
                    if m.start() != at:
                        raise ValueError("a formatted conversation doesn't read back")
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    at, count = m.end(), count + 1
                if at != len(whole):
                    raise ValueError("a formatted conversation doesn't read back")
                out.append((count, turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return found.mapInArrow(run, "leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_format(rows: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows(conv_id, turn, role, text)`` to the tree, the paths of its distinct conversations (leaf, path), and
    the leaf of every conversation (conv_id, leaf)."""
    convs = conversations_of(rows)
    leaves = cut(convs.drop("conv_id").dropDuplicates(["leaf"]))
    return prefix_tree(leaves, vocabulary), leaves.select("leaf", "path"), convs.select("conv_id", "leaf")


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted, and read back from the tree."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    tree, paths, convs = chat_format(rows.unionByName(extra))
    return convs.join(read_back(tree, paths), "leaf").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, 14 + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:'))
            + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<')) AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS LAST, role, text)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
