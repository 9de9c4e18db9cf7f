"""Chat formatting as prefix trees: conversations that begin alike share tokens.

All conversations make one forest: a node is a turn with all turns before it, and is emitted once. The forest is
cut into segments, rows of bounded size. A prefix whose conversations are too many for one segment is a
segment of one node; the subtrees below it are dealt over segments, which name that node, as one `above` them. So a turn
that very many conversations share is still emitted once, and no task gathers those conversations. In a segment
nodes come depth-first; a token's position counts from the tree's root, and a node attends to itself, to its
ancestors' intervals and to all nodes above the segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import partitions, stage
from leadloom.llm.tokenize import encoder

#: Characters and conversations up to which the conversations of a prefix stay in one segment; a conversation's
#: own turns are never parted but below a prefix that is a segment of its own.
MOST_CHARS, MOST_CONVERSATIONS = 1 << 17, 512
#: Conversations whose turns are encoded in one call.
TOGETHER = 256
#: Hexadecimal digits of a turn's digest in a path.
DIGITS = 32
#: The template: a turn is HEAD + role + MIDDLE + text + TAIL.
HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
#: The role whose texts are learnt.
LEARNT = "assistant"

_CONTROL = re.compile(r"\\|#|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """The text with a backslash before each backslash, each # and the slash of each </turn>: no control string is left."""
    return _CONTROL.sub(lambda m: "<\\/turn>" if m[0] == "</turn>" else "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """A role escaped like a text, with a backslash before each colon too."""
    return escape(role).replace(":", "\\:")


INTERVAL = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
NODE = T.StructType(
    [T.StructField("parent", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("position", T.LongType()),
     T.StructField("loss", INTERVAL), T.StructField("attends", T.ArrayType(INTERVAL))]
)
ABOVE = T.StructType([T.StructField("segment_id", T.StringType()), T.StructField("tokens", T.LongType())])
SEGMENTS = T.StructType(
    [T.StructField("segment_id", T.StringType()), T.StructField("above", T.ArrayType(ABOVE)), T.StructField("ids", T.BinaryType()), T.StructField("nodes", T.ArrayType(NODE)),
     T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("leaf", T.IntegerType())])))]
)


class Tree:
    """One segment while it is made: adding conversations in sorted order emits their nodes depth-first.

    `above` are the segments of the turns before, with their tokens. A turn is given with the ids of its frame's
    beginning, its text and its frame's end.
    """

    def __init__(self, name: str, above: list[dict]):
        self.name, self.above = name, above
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.members: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []
        self.base = sum(x["tokens"] for x in above)

    def add(self, turns: list[tuple[str, str]], encoded: list[list[np.ndarray]]) -> None:
        shared = 0
        while shared < len(turns) and shared < len(self.path) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn, (head, body, tail) in zip(turns[shared:], encoded[shared:]):
            parent = self.path[-1][1] if self.path else -1
            start, end = self.size, self.size + len(head) + len(body) + len(tail)
            before = self.nodes[parent] if self.path else {"attends": [], "position": self.base, "start": 0, "end": 0}
            learnt = turn[0] == LEARNT
            loss = {"start": start + len(head), "end": start + len(head) + len(body)} if learnt else {"start": start, "end": start}
            position = before["position"] + before["end"] - before["start"]
            self.nodes.append({"parent": parent, "start": start, "end": end, "position": position, "loss": loss, "attends": [*before["attends"], {"start": start, "end": end}]})
            self.path.append((turn, len(self.nodes) - 1))
            self.ids += [head, body, tail]
            self.size = end

    def member(self, conv_id: int | None) -> None:
        self.members.append({"conv_id": conv_id, "leaf": self.path[-1][1] if self.path else -1})

    def row(self) -> dict:
        ids = np.concatenate([*self.ids, np.zeros(0, np.uint32)]).astype("<u4").tobytes()
        return {"segment_id": self.name, "above": self.above, "ids": ids, "nodes": self.nodes, "conversations": self.members}


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (role and text by turn), chars and path (the digests of the turns) of each conversation.

    Null roles and texts are empty; rows of one turn number come by role and text. A row without a
    conv_id is a conversation of one turn by itself.
    """
    one = F.struct(F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    grouped = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    single = rows.filter("conv_id IS NULL").select("conv_id", F.array("one").alias("turns"))
    name = lambda t: F.substring(F.sha2(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256), 1, DIGITS)
    path = F.array_join(F.transform("turns", name), "")
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.length(t["role"]) + F.length(t["text"]) + 16)
    return grouped.unionByName(single).select("conv_id", "turns", chars.alias("chars"), path.alias("path"))


def prefix_id(path, depth):
    """The name of the node of the first `depth` turns of a path."""
    return F.md5(F.substring(path, F.lit(1), depth * DIGITS))


def hot_prefixes(found: DataFrame) -> DataFrame:
    """prefix, depth, n and chars of the prefixes with more conversations or characters than a segment takes, but of one conversation alone."""
    paths = found.groupBy("path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    each = paths.select("path", "n", "chars", F.explode(F.sequence(F.lit(1), (F.length("path") / DIGITS).cast("int"))).alias("depth"))
    counted = each.groupBy(prefix_id(F.col("path"), F.col("depth")).alias("prefix"), "depth").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    return counted.filter((F.col("n") > 1) & ((F.col("n") > MOST_CONVERSATIONS) | (F.col("chars") > MOST_CHARS)))


def segments(turns: DataFrame, vocabulary_path: str) -> DataFrame:
    """The segments that hold all conversations: token ids (little-endian, 32 bits), nodes and conversations.

    A node has its parent's number (-1 for the first of the segment), its interval of tokens, the position of its first token,
    the interval of learnt tokens and the intervals of the segment that its tokens attend to (ancestors, then itself
    up to the token); they also attend to all tokens of the segments `above`, from the root on. A conversation names its
    last node, -1 if that is the last one above. Very long turns stay whole; equal conversations share all tokens; other
    columns are not looked at. An empty table gives no rows.
    """
    # The number tells equal conversations apart; it is fixed once written.
    found = stage(conversations(turns).withColumn("serial", F.monotonically_increasing_id()), "conversations")
    hot = stage(hot_prefixes(found), "prefixes")
    # The deepest hot prefix of each path: they are nested, so its depth is their number.
    paths = found.select("path").distinct()
    each = paths.select("path", F.explode(F.sequence(F.lit(1), (F.length("path") / DIGITS).cast("int"))).alias("depth"))
    depths = each.select("path", prefix_id(F.col("path"), F.col("depth")).alias("prefix")).join(hot.select("prefix", "n", "chars"), "prefix").groupBy("path").agg(F.count("*").alias("hot"), F.min(F.struct("n", "chars")).alias("least"))
    total = found.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    placed = found.join(depths, "path", "left").withColumn("hot", F.coalesce("hot", F.lit(0)).cast("int"))
    # Subtrees below a hot prefix, or at the root, are dealt over segments by their first node; what ends there by conversation.
    shares = F.greatest(F.ceil(F.coalesce("least.chars", F.lit(total)) / MOST_CHARS), F.ceil(F.coalesce("least.n", F.lit(0)) / MOST_CONVERSATIONS), F.lit(1))
    ends = F.length("path") == F.col("hot") * DIGITS
    unit = F.when(ends, F.xxhash64("serial")).otherwise(F.xxhash64(F.substring("path", F.lit(1), (F.col("hot") + 1) * DIGITS)))
    below = F.concat(F.when(F.col("hot") > 0, prefix_id(F.col("path"), F.col("hot"))).otherwise(F.lit("root")), F.lit("-"), F.pmod(unit, shares).cast("string"))
    members = placed.select(below.alias("segment_id"), "hot", "path", "conv_id", "turns", F.lit(True).alias("member"))
    # A hot prefix is a segment of one node: its turns come from any conversation that begins so.
    one = each.select("path", "depth", prefix_id(F.col("path"), F.col("depth")).alias("prefix")).join(hot.select("prefix"), "prefix").groupBy("prefix", "depth").agg(F.min("path").alias("path"))
    texts = found.join(one.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.first("turns").alias("turns"))
    nodes = one.join(texts, "path").select(F.col("prefix").alias("segment_id"), (F.col("depth") - 1).cast("int").alias("hot"), "path", F.lit(None).cast("long").alias("conv_id"), F.slice("turns", F.lit(1), F.col("depth")).alias("turns"), F.lit(False).alias("member"))
    rows = members.unionByName(nodes).withColumn("above", F.when(F.col("hot") > 0, F.transform(F.sequence(F.lit(1), F.col("hot")), lambda d: prefix_id(F.col("path"), d))).otherwise(F.array().cast("array<string>")))
    dealt = rows.repartition(partitions(turns.sparkSession), "segment_id").sortWithinPartitions("segment_id", "path", "conv_id").select("segment_id", "hot", "above", "conv_id", "turns", "member")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path).texts
        tree = None
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER).to_pylist()
                listed = [[(t["role"], t["text"]) for t in r["turns"]] for r in some]
                distinct = {turn: k for k, turn in enumerate(dict.fromkeys(turn for turns in listed for turn in turns))}
                # A turn's frame and text are encoded apart, so that the loss mask falls between tokens.
                pieces = encode([x for role, text in distinct for x in (HEAD + escape_role(role) + MIDDLE, escape(text), TAIL)])
                for r, turns in zip(some, listed):
                    ids = [pieces[3 * distinct[t] : 3 * distinct[t] + 3] for t in turns]
                    if tree is None or tree.name != r["segment_id"]:
                        if tree is not None:
                            yield pa.RecordBatch.from_pylist([tree.row()], schema=arrow)
                        tree = Tree(r["segment_id"], [{"segment_id": name, "tokens": sum(map(len, own))} for name, own in zip(r["above"], ids)])
                    tree.add(turns[r["hot"] :], ids[r["hot"] :])
                    if r["member"]:
                        tree.member(r["conv_id"])
        if tree is not None:
            yield pa.RecordBatch.from_pylist([tree.row()], schema=arrow)

    interval = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    node = pa.struct([("parent", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("loss", interval), ("attends", pa.list_(interval))])
    above = pa.list_(pa.struct([("segment_id", pa.string()), ("tokens", pa.int64())]))
    arrow = pa.schema([("segment_id", pa.string()), ("above", above), ("ids", pa.binary()), ("nodes", pa.list_(node)), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])))])
    return dealt.mapInArrow(build, SEGMENTS)


READ = "conv_id long, formatted string, turns array<struct<role:string,text:string>>, learnt array<string>"


def read_back(made: DataFrame, vocabulary_path: str) -> DataFrame:
    """conv_id, the formatted text, the turns and the texts under the loss mask of each conversation, from segments alone."""
    whole = made.filter(F.size("conversations") > 0)
    asked = whole.select(F.col("segment_id").alias("below"), F.posexplode("above").alias("k", "one")).select("below", "k", F.col("one.segment_id").alias("segment_id"))
    single = made.filter(~F.col("segment_id").contains("-")).select("segment_id", "ids", F.get("nodes", F.lit(0))["loss"].alias("loss"))
    fetched = asked.join(single, "segment_id").groupBy("below").agg(F.array_sort(F.collect_list(F.struct("k", "ids", "loss"))).alias("fetched"))
    both = whole.join(fetched, whole["segment_id"] == fetched["below"], "left").select("ids", "nodes", "conversations", "fetched")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(vocabulary_path).decode

        def turn(ids: np.ndarray, start: int, end: int, loss: dict) -> tuple[str, dict, list[str]]:
            text = decode(ids[start:end])
            head = re.match(r"### ((?:\\.|[^\\:])*): ", text, re.DOTALL)
            learnt = [unescape(decode(ids[loss["start"] : loss["end"]]))] if loss["end"] > loss["start"] else []
            return text, {"role": unescape(head[1]), "text": unescape(text[head.end() : -len(TAIL)])}, learnt

        for batch in batches:
            for k in range(batch.num_rows):
                ids, nodes, members, fetched = (batch.column(c)[k].as_py() for c in range(4))
                ids = np.frombuffer(ids, "<u4")
                top = []
                for one in fetched or ():
                    own = np.frombuffer(one["ids"], "<u4")
                    top.append(turn(own, 0, len(own), one["loss"]))
                # Each node is read once; the last one of a conversation attends to its whole path.
                by_start = {n["start"]: turn(ids, n["start"], n["end"], n["loss"]) for n in nodes}
                out = []
                for member in members:
                    shown = [*top, *(by_start[x["start"]] for x in nodes[member["leaf"]]["attends"])] if member["leaf"] >= 0 else top
                    out.append({"conv_id": member["conv_id"], "formatted": "".join(x[0] for x in shown), "turns": [x[1] for x in shown], "learnt": [y for x in shown for y in x[2]]})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("learnt", pa.list_(pa.string()))])
    return both.mapInArrow(read, READ)


def digests(read: DataFrame) -> DataFrame:
    """Counts and checksums of conversations that were read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
