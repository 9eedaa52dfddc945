r"""Conversations as text with marked turns and a loss mask, proved by reading them back.

The grammar of a rendered conversation:

    conversation = turn*
    turn         = "[INST]" body "[/INST]"  |  "<s>" body "</s>"  |  "<<SYS>>" body "<</SYS>>"
                 | "[ROLE]" body "[TEXT]" body "[/ROLE]"
    body         = characters in which every mark follows an odd run of backslashes

for users, assistants, the system, and any other role by its name. A run of backslashes before a mark is
read in pairs, one backslash each; an odd one makes the mark plain text. All other backslashes are
themselves, so that texts without marks are written as they are.

Texts are written as they are first, and the whole is parsed. If the turns that come back are not the
turns that went in, those that do not come back alone are escaped, and it is parsed again.

Turns are range-partitioned by conversation and turn and written in segments of bounded size, so that a
conversation of any length is spread over tasks and none is held as a whole. Only the digest of a
conversation in several segments is taken by one task, segment after segment: a digest has no parts.

Turns of a conversation are ordered by ``turn``, then by role and a hash of the text; a null turn comes
first. Repeated rows are turns of their own. A null text is empty, a null role is the empty one, rows
without a conv_id are one conversation without an id. An empty table has no conversations. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.store import alone

OPEN = {"user": "[INST]", "assistant": "<s>", "system": "<<SYS>>"}
CLOSE = {"user": "[/INST]", "assistant": "</s>", "system": "<</SYS>>"}
NAMED, BETWEEN, END_NAMED = "[ROLE]", "[TEXT]", "[/ROLE]"
LEARNED = "assistant"  # whose texts are under the loss mask
_ROLE_OF = {mark: role for role, mark in OPEN.items()}
_MARKS = "|".join(map(re.escape, [*OPEN.values(), *CLOSE.values(), NAMED, BETWEEN, END_NAMED]))
_MARK = re.compile(_MARKS)
_RUN = re.compile(rf"(\\*)({_MARKS}|\Z)")
TURNS, CHARS = 1024, 1 << 20  # of a segment, but for the last turn's length
SALTS = 1024  # pieces into which equal rows may fall
SEGMENTS = "conv_id long, part int, number long, whole boolean, n_turns long, formatted string, loss array<struct<start:long,end:long>>"

Turn = tuple[str, str]


class Broken(ValueError):
    """A text that the grammar does not make."""


def escape(text: str) -> str:
    r"""Doubles the backslashes before a mark and at the end, and puts one more before a mark."""
    return _RUN.sub(lambda m: m[1] * 2 + ("\\" if m[2] else "") + m[2], text)


def unescape(body: str) -> str:
    if "\\" not in body:
        return body
    return _RUN.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], body)


def _marks(text: str) -> Iterator[tuple[int, str]]:
    """Marks that are not plain text, with their places."""
    for m in _MARK.finditer(text):
        at = m.start()
        while at and text[at - 1] == "\\":
            at -= 1
        if (m.start() - at) % 2 == 0:
            yield m.start(), m[0]


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns (role, text) of a rendered conversation and the places of their bodies."""
    out, at, marks = [], 0, _marks(text)

    def body(end: str) -> tuple[str, int, int]:
        nonlocal at
        place, mark = next(marks, (len(text), ""))
        if mark != end:
            raise Broken(f"{mark or 'the end'} at {place} in place of {end}")
        start, at = at, place + len(mark)
        return unescape(text[start:place]), start, place

    for place, mark in marks:
        if place != at:
            raise Broken(f"text between turns at {at}")
        at += len(mark)
        if mark == NAMED:
            role = body(BETWEEN)[0]
            out.append((role, *body(END_NAMED)))
        elif mark in _ROLE_OF:
            out.append((_ROLE_OF[mark], *body(CLOSE[_ROLE_OF[mark]])))
        else:
            raise Broken(f"{mark} at {place} in place of a turn")
    if at != len(text):
        raise Broken(f"text after the last turn at {at}")
    return out


def render(turn: Turn) -> str:
    """A turn whose role and text are ready to be written."""
    role, text = turn
    if role in OPEN:
        return OPEN[role] + text + CLOSE[role]
    return NAMED + role + BETWEEN + text + END_NAMED


def _comes_back(texts: list[str], turns: list[Turn]) -> list[tuple[str, str, int, int]] | None:
    try:
        found = parse("".join(texts))
    except Broken:
        return None
    return found if [t[:2] for t in found] == turns else None


def _escaped(turn: Turn) -> str:
    role, text = turn
    return render((role if role in OPEN else escape(role), escape(text)))


def write_turns(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns, and where the texts under the loss mask lie in them.

    Each round escapes more: nothing, what does not come back alone, everything.
    """
    plain = [render(t) for t in turns]
    for some in (
        lambda: plain,
        lambda: [p if _comes_back([p], [t]) else _escaped(t) for p, t in zip(plain, turns)],
        lambda: [_escaped(t) for t in turns],
    ):
        texts = some()
        found = _comes_back(texts, turns)
        if found is not None:
            return "".join(texts), [(a, b) for role, _, a, b in found if role == LEARNED]
    raise Broken("escaped turns do not come back")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to segments. ``whole``: the conversation surely has no other segment."""
    part, number = TaskContext.get().partitionId(), 0
    rows: list[dict] = []
    conv, turns, chars, first, split, waiting = None, [], 0, True, False, 0

    def flush(last: bool) -> None:
        nonlocal number, turns, chars, waiting
        text, loss = write_turns(turns)
        # The first and the last conversation of a part may go on in its neighbours.
        whole = not (first or last or split)
        spans = [{"start": a, "end": b} for a, b in loss]
        rows.append({"conv_id": conv, "part": part, "number": number, "whole": whole, "n_turns": len(turns), "formatted": text, "loss": spans})
        number, turns, chars, waiting = number + 1, [], 0, waiting + len(text)

    def batch_of() -> pa.RecordBatch:
        nonlocal waiting
        waiting = 0
        columns = {f.name: [r[f.name] for r in rows] for f in _SCHEMA}
        rows.clear()
        return pa.RecordBatch.from_pydict(columns, schema=_SCHEMA)

    for batch in batches:
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
            if turns and c != conv:
                flush(False)
                first = split = False
            elif len(turns) >= TURNS or chars >= CHARS:
                split = True
                flush(False)
            conv = c
            turns.append((role, text))
            chars += len(text)
            if waiting >= CHARS or len(rows) >= TURNS:
                yield batch_of()
    if turns:
        flush(True)
    if rows:
        yield batch_of()


_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int32()),
        ("number", pa.int64()),
        ("whole", pa.bool_()),
        ("n_turns", pa.int64()),
        ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def segments(conversations: DataFrame) -> DataFrame:
    """``SEGMENTS`` of all conversations; part and number give a conversation's segments their order."""
    rows = alone(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # Equal rows may lie in any order, so the row's number may part them.
    order = ["conv_id", "turn", "role", "hash", "salt"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id() % SALTS})
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(_segments, SEGMENTS)


def write(conversations: DataFrame, path: str) -> None:
    """Segments as Parquet."""
    segments(conversations).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


class _Digest:
    """Digests of a conversation from its segments, one after the other."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.counts = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

    def add(self, text: str, loss: list[dict]) -> None:
        found = parse(text)
        for role, said, _, _ in found:
            self.turns.update(f"{role}\n{said}\n".encode())
        learned = 0
        for span in loss:
            said = unescape(text[span["start"] : span["end"]])
            learned += len(said)
            self.loss.update(said.encode())
        self.counts = [a + b for a, b in zip(self.counts, (len(found), learned, len(text)))]

    def row(self) -> tuple:
        n, learned, length = self.counts
        return self.conv, n, self.turns.hexdigest(), learned, self.loss.hexdigest(), length


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose segments lie side by side in order; one is open at a time."""
    now, rows = None, []
    for batch in batches:
        for conv, text, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss"))):
            if now is not None and now.conv != conv:
                rows.append(now.row())
                now = None
            now = now or _Digest(conv)
            now.add(text, loss)
        if rows:
            yield _digest_batch(rows)
            rows = []
    if now is not None:
        yield _digest_batch([now.row()])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [c.split(" ")[0] for c in _DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from the files."""
    rows = read(spark, path)
    several = rows.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    columns = ["conv_id", "formatted", "loss"]
    return rows.where("whole").select(columns).mapInArrow(_digests, _DIGEST).unionByName(several.select(columns).mapInArrow(_digests, _DIGEST))
