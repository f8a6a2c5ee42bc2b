"""Operator 6: chat formatting over a prefix tree.

A turn is written as ``<s>[INST]role[/INST]text</s>``.  Control strings inside
roles and texts get a backslash after their first character and backslashes
are doubled, so no text can pose as markup and every text can be read back.

Conversations are ordered by the array of the hashes of all their turns, which is
the depth-first order of the tree of their common beginnings, however long.  Ranges of that order
are formatted independently: a range ("pack") holds the turns of a shared
beginning once, each at the position that it has in its conversation, and with
the stretches of its ancestors as the only others that it attends to.  Within a
pack no turn is written twice for one beginning; a pack repeats, of what others
hold, the beginning of its first conversation at most, so all repeats together
are no more than one conversation for each ``PACK_CHARS`` characters written, for each
``PACK_CONVERSATIONS`` conversations and for each partition.  Equal conversations may lie in several packs.

Defined results: null texts and roles count as empty; rows of a conversation
are taken by turn, then role, then text (nulls first), repeated rows are turns
of their own; an empty table has no packs; extra columns are ignored; each row
without conv_id is a conversation of its own; a conversation is held whole by
one task, so a very long one takes memory of some times its size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The template's control strings.
START, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (START, HEAD, BODY, END)
#: Packs start anew after about so many characters, or so many conversations (equal ones add no characters).
PACK_CHARS, PACK_CONVERSATIONS = 1 << 20, 1 << 16
#: Characters of conversations that are read back in one batch, about.
READ_CHARS = 1 << 22
#: Roles whose texts are learnt.
LEARNT = ("assistant",)

PACKS = (
    "pack string, formatted string, "
    "nodes array<struct<start:bigint,end:bigint,position:bigint,parent:int,learnt:boolean,body:bigint>>, "
    "attends array<array<struct<start:bigint,end:bigint>>>, "
    "conversations array<struct<conv_id:bigint,leaf:int>>"
)


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order and the hash of each."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    one = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    one = one.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    return one.select("conv_id", "turns", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("hashes"))


class _Pack:
    def __init__(self) -> None:
        self.text: list[str] = []
        self.nodes: list[tuple] = []
        self.attends: list[list[tuple[int, int]]] = []
        self.conversations: list[tuple] = []
        self.path: list[tuple[str, str]] = []
        self.ids: list[int] = []
        self.at = 0

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        """Appends the turns that the conversation before doesn't share."""
        shared = 0
        while shared < min(len(turns), len(self.path)) and turns[shared] == self.path[shared]:
            shared += 1
        del self.ids[shared:]
        for role, text in turns[shared:]:
            parent = self.ids[-1] if self.ids else -1
            head = f"{START}{HEAD}{escaped(role)}{BODY}"
            turn = f"{head}{escaped(text)}{END}"
            before = self.nodes[parent] if self.ids else None
            position = before[2] + before[1] - before[0] if before else 0
            stretch = self.attends[parent] if self.ids else []
            if stretch and stretch[-1][1] == self.at:
                stretch = [*stretch[:-1], (stretch[-1][0], self.at + len(turn))]
            else:
                stretch = [*stretch, (self.at, self.at + len(turn))]
            self.ids.append(len(self.nodes))
            self.nodes.append((self.at, self.at + len(turn), position, parent, role in LEARNT, self.at + len(head)))
            self.attends.append(stretch)
            self.text.append(turn)
            self.at += len(turn)
        self.path = turns
        self.conversations.append((conv_id, self.ids[-1] if self.ids else -1))

    def row(self) -> tuple:
        name = hashlib.md5(repr((self.conversations[0], self.conversations[-1], self.at)).encode()).hexdigest()
        return name, "".join(self.text), self.nodes, self.attends, self.conversations


def packed(turns: DataFrame) -> DataFrame:
    """Packs of formatted conversations: the text, and for each turn in it where it
    stands, the position id of its first character, its parent, where its text
    starts, whether it is learnt, and the merged stretches that it attends to
    (its own, causally, is the last)."""
    order = ["hashes", "conv_id"]
    ordered = conversations(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    shape = _arrow(PACKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack()
        for batch in batches:
            for conv_id, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pack.add(conv_id, [(t["role"], t["text"]) for t in rows])
                if pack.at >= PACK_CHARS or len(pack.conversations) >= PACK_CONVERSATIONS:
                    yield _batch([pack.row()], shape)
                    pack = _Pack()
        if pack.conversations:
            yield _batch([pack.row()], shape)

    return ordered.select("conv_id", "turns").mapInArrow(run, PACKS)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape)], schema=shape)


_TURN = re.compile(f"{re.escape(START)}{re.escape(HEAD)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.S)


def read_back(packs: DataFrame) -> DataFrame:
    """Per conversation its turns and learnt texts, read from the packs alone: the
    stretches that its last turn attends to, parsed and unescaped."""
    schema = "conv_id long, roles array<string>, texts array<string>, learnt array<string>, formatted_chars long"

    shape = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                text, nodes, attends, convs = (batch.column(n)[k].as_py() for n in ("formatted", "nodes", "attends", "conversations"))
                out, held = [], 0
                for c in convs:
                    if held >= READ_CHARS:
                        yield _batch(out, shape)
                        out, held = [], 0
                    leaf, learnt = c["leaf"], []
                    own = "".join(text[s["start"] : s["end"]] for s in attends[leaf]) if leaf >= 0 else ""
                    turns = _TURN.findall(own)
                    while leaf >= 0:
                        n = nodes[leaf]
                        if n["learnt"]:
                            learnt.append(unescaped(text[n["body"] : n["end"] - len(END)]))
                        leaf = n["parent"]
                    held += len(own) + 1
                    out.append((c["conv_id"], [unescaped(a) for a, _ in turns], [unescaped(b) for _, b in turns], learnt[::-1], len(own)))
                yield _batch(out, shape)

    return packs.mapInArrow(run, schema)
