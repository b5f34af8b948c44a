"""Chat formatting as prefix trees.

Conversations that share their first turns are merged: in a pack, a shared turn is written once, depth first. A pack is
one row: its text, and its nodes with position ids (a start; they run on within a node) and the intervals of the text
that a node may attend to (its ancestors, merged, and causally itself). Tokens are code points here.

Turns: `<|role|>` + escaped text + `<|end|>\\n`. A backslash before each backslash and `<` of role and text makes this
reversible: no text can hold a control string.

Conversations are range-partitioned by the path of their turns' hashes and their id. Shared prefixes lie side by side in
that order, and a first turn that a third of all conversations share is spread over many partitions; each pack (and each
partition) repeats the turns it needs once.

Defined results: null text or role is empty; each row with a null conv_id is a conversation of its own (only equal ones share it); equal turn numbers are ordered
by role and text; repeated rows are repeated turns; an empty table gives no packs; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import prepare

#: Code points and conversations of a pack, beyond which a new one begins.
PACK_CHARS, PACK_CONVERSATIONS = 200_000, 2_000
LOSS_ROLE = "assistant"

PACKS = (
    "text string, nodes array<struct<start:long,end:long,parent:int,position:long,loss_start:long,loss_end:long,"
    "attend:array<struct<start:long,end:long>>>>, leaves array<struct<conv_id:long,node:int>>"
)
_PACKS = pa.schema([
    ("text", pa.string()),
    ("nodes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("parent", pa.int32()), ("position", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attend", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))),
    ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())]))),
])
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_SPECIAL, _ESCAPED = re.compile(r"[\\<]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|((?:[^\\<|]|\\.|\|(?!>))*)\|>((?:[^\\<]|\\.)*)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def head(role: str) -> str:
    """Pipes of a role are escaped too, so that the first `|>` ends it."""
    return "<|" + escape(role).replace("|", "\\|") + "|>"


def format_turn(role: str, text: str) -> str:
    return f"{head(role)}{escape(text)}<|end|>\n"


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("a turn without an end")
    return turns


class Pack:
    """A prefix tree being written depth first."""

    def __init__(self):
        self.parts, self.chars, self.nodes, self.leaves = [], 0, [], []
        self.path: list[tuple[tuple[str, str], int]] = []  # turns and nodes from the root to the last leaf

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for role, text in turns[shared:]:
            written = format_turn(role, text)
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if self.path else None
            attend = []
            if above:
                attend = [dict(x) for x in above["attend"]]
                if attend and attend[-1]["end"] == above["start"]:
                    attend[-1]["end"] = above["end"]
                else:
                    attend.append({"start": above["start"], "end": above["end"]})
            start, first = self.chars, self.chars + len(head(role))
            is_loss = role == LOSS_ROLE
            self.nodes.append({
                "start": start, "end": start + len(written), "parent": parent,
                "position": above["position"] + above["end"] - above["start"] if above else 0,
                "loss_start": first if is_loss else start, "loss_end": start + len(written) - len("<|end|>\n") if is_loss else start, "attend": attend,
            })
            self.parts.append(written)
            self.chars += len(written)
            self.path.append(((role, text), len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1]})

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"text": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}], schema=_PACKS)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = Pack()
    for batch in batches:
        for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if pack.leaves and (pack.chars >= PACK_CHARS or len(pack.leaves) >= PACK_CONVERSATIONS):
                yield pack.batch()
                pack = Pack()
            pack.add(conv_id, [(t["role"], t["text"]) for t in turns])
    if pack.leaves:
        yield pack.batch()


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Packs (PACKS) of all conversations (conv_id, turn, role, text)."""
    prepare(conversations.sparkSession)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.select(F.col("conv_id").cast("long"), turn.alias("one"))
    whole = whole.groupBy("conv_id", F.when(F.col("conv_id").isNull(), F.struct("one")).alias("alone")).agg(F.sort_array(F.collect_list("one")).alias("turns"))
    ordered = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    return ordered.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns").mapInArrow(_write, PACKS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        for pack in batch.to_pylist():
            text, nodes, rows, done = pack["text"], pack["nodes"], [], {}
            for leaf in pack["leaves"]:
                k = leaf["node"]
                if k not in done:
                    seen = [*nodes[k]["attend"], nodes[k]]  # what the last token may look at, in order
                    formatted = "".join(text[x["start"] : x["end"]] for x in seen)
                    turns = parse_turns(formatted)
                    chain = [k]
                    while nodes[chain[-1]]["parent"] >= 0:
                        chain.append(nodes[chain[-1]]["parent"])
                    loss = "".join(unescape(text[nodes[n]["loss_start"] : nodes[n]["loss_end"]]) for n in reversed(chain))
                    done[k] = {
                        "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                        "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(formatted),
                    }
                rows.append({"conv_id": leaf["conv_id"], **done[k]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_back(packs: DataFrame) -> DataFrame:
    """One row per conversation, read from the packs alone."""
    return packs.mapInArrow(_read, READ_BACK)
