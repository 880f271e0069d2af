"""Chat formatting in prefix trees: turns that conversations share from the start are emitted once.

A turn is formatted as ``<turn role="R">``, a line break, the text, ``</turn>`` and a line break; in texts and roles
a backslash is written ``\\\\``, ``<`` is ``\\l`` and a quote in a role ``\\q``, so none can hold a control string and
everything can be read back. Different conversations are sorted by the hashes of their turns, which is the
depth-first order of their tree, and range-partitioned, so conversations with a common first turn may lie
in many partitions. Each task cuts its sorted run into packs of at most ``pack_size`` tokens (a longer
conversation is a pack of its own); a pack emits every turn of its tree once.

Each turn of a pack has the position id of its first token (the tokens of its ancestors come before it) and the
intervals of pack tokens that it attends to besides itself: those of its ancestors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready

TURN = re.compile(r'<turn role="([^"<]*)">\n([^<]*)</turn>\n')
TRAINED = "assistant"  # the role whose texts are under the loss mask
CODES = {"\\": "\\", "<": "l", '"': "q"}


def escaped(text: str, controls: str = r"[\\<]") -> str:
    return re.sub(controls, lambda m: "\\" + CODES[m[0]], text)


def unescaped(text: str) -> str:
    back = {code: char for char, code in CODES.items()}
    return re.sub(r"\\(.)", lambda m: back[m[1]], text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the place of its escaped text."""
    head, body = f'<turn role="{escaped(role, r"[\\<\"]")}">\n', escaped(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parsed(chat: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    turns, at = [], 0
    while at < len(chat):
        turn = TURN.match(chat, at)
        if turn is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescaped(turn[1]), unescaped(turn[2])))
        at = turn.end()
    return turns


NODE = "array<struct<start:bigint,end:bigint,parent:bigint,position:bigint,char_start:bigint,char_end:bigint,loss_start:bigint,loss_end:bigint>>"
PACK = f"text string, token_ids array<int>, nodes {NODE}, intervals array<array<struct<start:bigint,end:bigint>>>, leaves array<struct<path:string,node:bigint>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct([(k, pa.int64()) for k in ("start", "end", "parent", "position", "char_start", "char_end", "loss_start", "loss_end")])
_SCHEMA = pa.schema([("text", pa.string()), ("token_ids", pa.list_(pa.int32())), ("nodes", pa.list_(_NODE)),
                     ("intervals", pa.list_(pa.list_(_SPAN))), ("leaves", pa.list_(pa.struct([("path", pa.string()), ("node", pa.int64())])))])


class Pack:
    """One prefix tree, built depth first."""

    def __init__(self, encode):
        self.encode, self.tokens, self.size, self.chars = encode, [], 0, 0
        self.text, self.nodes, self.intervals, self.leaves, self.open = [], [], [], [], []

    def depth(self, turns: list[tuple[str, str]]) -> int:
        """Turns that the conversation shares with the one added before."""
        same = 0
        while same < min(len(turns), len(self.open)) and self.open[same][1] == turns[same]:
            same += 1
        return same

    def add(self, path: str, turns: list[tuple[str, str]], ready_turns) -> None:
        del self.open[self.depth(turns):]
        for turn, (chat, low, high, ids) in list(zip(turns, ready_turns))[len(self.open):]:
            length = len(chat) if ids is None else len(ids)
            parent = self.open[-1][0] if self.open else -1
            before = self.nodes[parent] if self.open else None
            spans = []
            if before:
                spans = [dict(s) for s in self.intervals[parent]]
                if spans and spans[-1]["end"] == before["start"]:
                    spans[-1]["end"] = before["end"]
                else:
                    spans.append({"start": before["start"], "end": before["end"]})
            trained = turn[0] == TRAINED
            self.open.append((len(self.nodes), turn))
            self.nodes.append({
                "start": self.size, "end": self.size + length, "parent": parent,
                "position": before["position"] + before["end"] - before["start"] if before else 0,
                "char_start": self.chars, "char_end": self.chars + len(chat),
                "loss_start": self.chars + low if trained else None, "loss_end": self.chars + high if trained else None})
            self.intervals.append(spans)
            self.text.append(chat)
            self.tokens += ids or []
            self.size += length
            self.chars += len(chat)
        self.leaves.append({"path": path, "node": self.open[-1][0] if self.open else -1})

    def row(self) -> dict:
        return {"text": "".join(self.text), "token_ids": self.tokens if self.encode else None, "nodes": self.nodes,
                "intervals": self.intervals, "leaves": self.leaves}


def _packed(pack_size: int, tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        if tokenizer:
            from tokenizers import Tokenizer

            encode = Tokenizer.from_file(tokenizer)
            encode.encode_special_tokens = True
        pack = Pack(encode)
        for batch in batches:
            for row in batch.to_pylist():
                turns = [(t["role"], t["text"]) for t in row["turns"]]
                chats = [formatted(*t) for t in turns]
                ids = [e.ids for e in encode.encode_batch([c[0] for c in chats], add_special_tokens=False)] if encode else [None] * len(chats)
                fresh = [(*c, i) for c, i in zip(chats, ids)]
                more = sum(len(c[0]) if c[3] is None else len(c[3]) for c in fresh[pack.depth(turns):])
                if pack.leaves and pack.size + more > pack_size:
                    yield pa.RecordBatch.from_pylist([pack.row()], _SCHEMA)
                    pack = Pack(encode)
                pack.add(row["path"], turns, fresh)
        if pack.leaves:
            yield pa.RecordBatch.from_pylist([pack.row()], _SCHEMA)

    return run


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> (conv_id, path, turns): whole conversations, ``path`` names their content."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return turns.withColumn("path", F.sha2(F.to_json("turns"), 256))


def trees(chats: DataFrame, pack_size: int = 1 << 16, tokenizer: str | None = None) -> DataFrame:
    """Conversations -> packs (text, token_ids, nodes, intervals, leaves), each conversation content a leaf of one pack.

    Tokens are code points, or those of the tokenizer file, turn by turn.
    """
    order = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    paths = chats.select("path", "turns").dropDuplicates(["path"]).withColumn("order", order)
    return paths.repartitionByRange("order", "path").sortWithinPartitions("order", "path").select("path", "turns").mapInArrow(
        _packed(pack_size, tokenizer), PACK)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        for pack in batch.to_pylist():
            rows = []
            for leaf in pack["leaves"]:
                chain, node = [], leaf["node"]
                while node >= 0:
                    chain.append(pack["nodes"][node])
                    node = chain[-1]["parent"]
                chain.reverse()
                chat = "".join(pack["text"][n["char_start"]:n["char_end"]] for n in chain)
                loss = "".join(unescaped(pack["text"][n["loss_start"]:n["loss_end"]]) for n in chain if n["loss_start"] is not None)
                turns = parsed(chat)
                content = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((leaf["path"], len(turns), hashlib.sha256(content.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(chat)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def read_back(packs: DataFrame) -> DataFrame:
    """Digests of every conversation content in the packs, from the packs' texts, turns and loss spans alone."""
    return packs.mapInArrow(_read, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(rows: DataFrame, pack_size: int = 1 << 16, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text) rows -> (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Turns come in the order of turn, role and text, null turns first; null roles and texts are empty. Rows with a null
    conv_id are one conversation. Repeated rows are turns each. Equal conversations share their leaf. An empty table
    gives an empty result. One conversation is put together in one task, as its formatted text is one value.
    """
    stages = Stages(ready(rows.sparkSession))
    chats = stages.put("chat-turns", conversations(rows))
    packs = stages.put("chat-packs", trees(chats, pack_size, tokenizer))
    return chats.select("conv_id", "path").join(read_back(packs), "path").drop("path")
