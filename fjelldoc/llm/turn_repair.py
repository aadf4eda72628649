"""Conversation structure repair by scalar big-integer weights (operator 12).

A conversation shall have the role initials `(s?(ua)+)?`. Its cheapest repair is a path through a graph whose nodes
are (message, state of that pattern) and whose edges are edits: Keep, Rerole, Delete, Insert. A path's weight
is one integer: its high digits are the cost, its low ones the edits' initials, one byte each from the first
position on, with zero bytes up to a fixed width at the end. So the ordinary minimum of integers picks the
cheapest path and, of equally cheap ones, the one whose initials come first in ASCII. An edge put before a
path moves the path's letters on by one byte. The roles of the result follow from its length: an odd one
begins with `s`.

How it is spread: one exchange by conversation. Each message comes twice, first as a few bytes (fault, initial, turn) of
which the path is found, then with its text, which goes straight on: a task holds some bytes per message of one
conversation, never its texts. Weights of n messages have about 2.4 n bytes, so a path takes time with the square
of n (some 10 s for 50 000 messages); the order of messages and a digest of a whole conversation allow no split.

Defined cases: null roles and texts are one space; null conversation ids are one conversation; messages of equal
(or null) turn stand in order of role and of their text's MD5, a copy after its original; a role's initial is its
first character, whatever the role is; an empty role has none and can't be kept; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjelldoc.llm.common import SPACE, bounded_batches

NOT_SPACE = SPACE.replace("[", "[^", 1)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
MOST = (1 << 63) - 1
#: States of the pattern: nothing yet, after s, after u, after a. The state that an initial leads to, by state.
START, S, U, A = range(4)
NEXT = [{"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U}]
FINE, BLANK, DUPLICATE, CUT, GONE = range(5)
#: place -1: what was found in the conversation; from 0 on: its edits in order, with the message that results.
EDITS = "conv_id long, place long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, dropped: the messages with damage dealt by crc32(`conv_id:turn`) % 20."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), part("role").alias("role"), part("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("code") == 0).alias("dropped"))


def _fault(earlier: Column) -> Column:
    last = F.regexp_extract("text", rf"({NOT_SPACE}){SPACE}*\z", 1)
    return F.when(F.col("dropped"), GONE).when(~F.col("text").rlike(NOT_SPACE), BLANK).when(earlier, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)


def cheapest(faults: bytes, initials: str) -> tuple[int, str]:
    """Cost and initials of the edits of the least path. faults: by message; initials: by message, a space for none."""
    n = len(faults)
    width = 8 * (n + (4 * n + 6) // 3 + 4)  # deleting all and inserting two costs 4 n + 6; each insert costs 3
    mask, top = (1 << width) - 1, width - 8
    dear = (8 * n + 99) << width

    def edge(letter: str, cost: int, path: int) -> int:
        return (((path >> width) + cost) << width) | ord(letter) << top | (path & mask) >> 8

    after = [0, dear, dear, 0]
    for i in range(n, -1, -1):
        if i < n:
            here = [edge("D", DELETE, path) for path in after]
            if faults[i] in (FINE, CUT):
                more = TRUNCATED if faults[i] == CUT else 0
                for state, paths in enumerate(NEXT):
                    options = [here[state], *[edge("R", REROLE + more, after[to]) for initial, to in paths.items() if initial != "s"]]
                    if initials[i] in paths:
                        options.append(edge("K", more, after[paths[initials[i]]]))
                    here[state] = min(options)
        else:
            here = after
        # two inserted messages lead to every state that any number of them leads to
        for _ in range(2):
            here = [min(here[state], *[edge("I", INSERT, here[to]) for initial, to in paths.items() if initial != "s"]) for state, paths in enumerate(NEXT)]
        after = here
    return after[START] >> width, (after[START] & mask).to_bytes(width // 8, "big").rstrip(b"\0").decode()


class _Conversation:
    """What is known of a conversation: first its messages' few bytes, then, once solved, the place among its edits."""

    def __init__(self, conv_id):
        self.conv_id, self.faults, self.initials = conv_id, bytearray(), []
        self.least = self.most = None
        self.turns, self.audit, self.place, self.odd, self.made = 0, None, 0, False, 0

    def note(self, fault: int, initial: str, turn: int | None) -> None:
        if fault == GONE:
            return
        self.faults.append(fault)
        self.initials.append(initial or " ")
        if turn is not None:  # turns ascend
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def solve(self) -> tuple:
        cost, self.audit = cheapest(bytes(self.faults), "".join(self.initials))
        self.odd = (len(self.audit) - self.audit.count("D")) % 2 == 1
        gaps = min(self.most - self.least + 1 - self.turns, MOST) if self.turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:]))
        return (self.conv_id, -1, None, None, None, gaps, *[self.faults.count(f) for f in (BLANK, DUPLICATE, CUT)], illegal, cost)

    def _row(self, edit: str, role: str | None, text: str | None) -> tuple:
        if edit != "D":
            if edit != "K":
                role = "assistant" if (self.made - self.odd) % 2 else "user"
            self.made += 1
        self.place += 1
        return (self.conv_id, self.place - 1, edit, role, text, None, None, None, None, None, None)

    def inserted(self):
        while self.place < len(self.audit) and self.audit[self.place] == "I":
            yield self._row("I", None, "")

    def message(self, role: str, text: str):
        yield from self.inserted()
        yield self._row(self.audit[self.place], role, text) if self.audit[self.place] != "D" else self._row("D", None, None)


def _edits(batches):
    import pyarrow as pa

    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in map(str.split, EDITS.split(", "))])
    out, size, now = [], 0, None

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    def ended(conversation):
        if conversation is not None:
            if conversation.audit is None:
                out.append(conversation.solve())
            out.extend(conversation.inserted())

    for batch in batches:
        for conv_id, kind, fault, initial, turn, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now is None or conv_id != now.conv_id:
                ended(now)
                now = _Conversation(conv_id)
            if not kind:
                now.note(fault, initial, turn)
                continue
            if now.audit is None:
                out.append(now.solve())
            out.extend(now.message(role, text))
            size += len(text)
            if size > 1 << 22 or len(out) > 50_000:
                yield batch_of()
                out, size = [], 0
    ended(now)
    if out:
        yield batch_of()


def repair(messages: DataFrame) -> DataFrame:
    """The edits of each conversation (see EDITS), its rows together and in order of place within a partition.

    messages: conv_id, turn, role, text, copy, dropped; a dropped message only names its conversation.
    """
    bounded_batches(messages.sparkSession)
    known = messages.withColumn("digest", F.md5("text")).repartition("conv_id")
    # the exchange by conversation serves this window too
    same = Window.partitionBy("conv_id", "role", "digest", "dropped").orderBy(F.asc_nulls_first("turn"), "copy")
    judged = known.withColumn("fault", _fault(F.row_number().over(same) > 1))
    first = F.struct(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"))
    second = F.struct(F.lit(1).alias("kind"), F.col("text").alias("text"))
    both = judged.withColumn("as", F.explode(F.when(F.col("dropped"), F.array(first)).otherwise(F.array(first, second))))
    order = ["conv_id", "as.kind", F.asc_nulls_first("turn"), "role", "digest", "copy"]
    rows = both.sortWithinPartitions(*order).select("conv_id", "as.kind", "fault", F.substring("role", 1, 1).alias("initial"), "turn", "role", "as.text")
    return rows.mapInArrow(_edits, EDITS)


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of `repair`: its counts and cost, audit (the edits' initials) and repaired_sha256."""
    out = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def fold(batches):
        import hashlib

        import pyarrow as pa

        schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in map(str.split, out.split(", "))])

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        head, audit, digest, begun, rows = None, [], hashlib.sha256(), False, []

        def ended():
            if head is not None:
                rows.append((*head, "".join(audit), digest.hexdigest()))

        for batch in batches:
            for conv_id, place, edit, role, text, *counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if place < 0:
                    ended()
                    head, audit, digest, begun = (conv_id, *counts), [], hashlib.sha256(), False
                    continue
                audit.append(edit)
                if edit != "D":
                    digest.update((("\n" if begun else "") + role + ":" + text).encode())
                    begun = True
            if rows:
                yield batch_of()
                rows.clear()
        ended()
        if rows:
            yield batch_of()

    return edits.mapInArrow(fold, out)
