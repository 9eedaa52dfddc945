"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The field's nodes are the words that hold a digit or an @; all other words are taken for ordinary. Its
unary potentials come from a word's shape and from its neighbours' shapes; neighbouring nodes share a
chain potential. Mentions share a skip potential, however far apart, if they have the same word, the same name before
an @, or the same digits: those of a word, or of a run of neighbouring nodes that a number is written over, whole or
from its end. A mention is linked to the one before it, to the first, and to the first inside a pattern's span.
Loopy message passing over all of a batch's documents at once makes equal things get equal labels across a
document; it goes on until the messages settle. Words in spans of the patterns are fixed.

The potentials are trained piecewise, in closed form, from counts over all documents, the patterns' spans being the
labels; the tables are hashed to a fixed size. A word outside all spans is unlabelled where a mention linked to it has a
pattern's label: it doesn't count. All other words outside spans are ordinary; nothing else teaches what is. Spans are
added only where a label's marginal is ``SURE``.

Null and empty texts have no spans. A table without any such word teaches nothing and adds nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import words as W
from docweave.llm.store import alone

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: ordinary
SLOTS = 1 << 16
SETTLED, DAMPING = 1e-3, 0.5
STEADY = 100  # rounds after which steps shrink, so that messages that swing settle too
SURE = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def patterns(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of the fixed patterns, by start, then kind. Linear in the text's length."""
    out = []
    at = text.find("@")
    free = 0  # where the last match ended
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_SHAPED = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]")
_LEFT = re.compile(r"^[^0-9A-Za-z@+(]+")
_RIGHT = re.compile(r"[^0-9A-Za-z)]+$")


def _shape(core: str) -> str:
    s = _DIGITS.sub("0", _SHAPED.sub("a", core[:64]))
    return s if len(core) <= 64 else f"{s}~{len(core).bit_length()}"


@dataclass
class Nodes:
    """The nodes of some documents, as one graph."""

    doc: list[int]
    start: list[int]
    end: list[int]
    word: list[int]
    label: list[int]  # from the patterns
    shape: list[int]
    context: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _slot(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % SLOTS


_NUMBER = re.compile(r"[0-9+(). -]*[0-9][0-9+(). -]*")
LONGEST = 19  # digits of a number


def _digit_keys(digits: str) -> list[str]:
    """Of a number: all its digits and, where it can be a phone, the last ones, as countries' codes may be left out."""
    return [f"d{digits}", *(f"d{digits[-k:]}" for k in range(7, min(len(digits) - 1, 10) + 1) if len(digits) <= 15)]


def _mentions(cores: list[str], words: list[int]) -> Iterator[tuple[str, range]]:
    """What makes distant words the same or similar, with the words (by place) that it stands for: equal words or names
    before an @, and the digits of a word or of a run of neighbours that one number may be written over."""
    digits = ["".join(_DIGITS.findall(c)) for c in cores]
    number = [bool(_NUMBER.fullmatch(c)) for c in cores]
    joined = [n > 0 and number[n] and number[n - 1] and words[n - 1] == words[n] - 1 for n in range(len(cores))]
    for n, core in enumerate(cores):
        alone = not joined[n] and not (n + 1 < len(cores) and joined[n + 1])
        if alone or len(core) >= 4 and not core.isdigit():  # short pieces of a number say nothing by themselves
            yield f"n{core.split('@', 1)[0].lower()}", range(n, n + 1)
        whole, end = digits[n], n + 1
        while True:
            if len(whole) >= 7 and (end == n + 1 or len(whole) <= LONGEST):
                for key in _digit_keys(whole):
                    yield key, range(n, end)
            if end == len(cores) or not joined[end] or len(whole) >= LONGEST:
                break
            whole += digits[end]
            end += 1


def _links(cores: list[str], words: list[int], labels: list[int]) -> list[tuple[int, int]]:
    """Pairs of places: each mention with the one before, the first, and the first inside a pattern's span."""
    found: dict[str, list[range]] = {}
    for key, places in _mentions(cores, words):
        mentions = found.setdefault(key, [])
        if not mentions or mentions[-1].stop <= places.start:
            mentions.append(places)
    out: dict[tuple[int, int], None] = {}
    for mentions in found.values():
        if len(mentions) > 1:
            sure = next((m for m in mentions if labels[m.start]), mentions[0])
            for k, m in enumerate(mentions):
                for other in (mentions[k - 1] if k else m, mentions[0], sure):
                    if other is not m:
                        out.update(((min(i, other.start), max(i, other.start)), None) for i in m)
    return list(out)


def graph(texts: W.Texts) -> tuple[Nodes, list[list[tuple[int, int, int]]]]:
    """Nodes and edges of the texts, and each text's pattern spans."""
    texts.words()
    special = np.zeros(256, bool)
    special[[*range(48, 58), ord("@")]] = True
    marks = np.concatenate([[0], np.cumsum(special[texts.data])])
    active = np.flatnonzero(marks[texts.ends] > marks[texts.starts]) if len(texts.starts) else np.zeros(0, int)
    at = np.searchsorted(active, texts.bounds)
    nodes = Nodes([], [], [], [], [], [], [], [], [])
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(texts.n)]
    for i in range(texts.n):
        mine = active[at[i] : at[i + 1]]
        if not len(mine):
            continue
        base = texts.offsets[i]
        raw = texts.data[base : texts.offsets[i + 1]]
        text = raw.tobytes().decode("utf-8")
        spans[i] = patterns(text)
        if len(text) == len(raw):
            starts, ends = texts.starts[mine] - base, texts.ends[mine] - base
        else:
            chars = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
            starts, ends = chars[texts.starts[mine] - base], chars[texts.ends[mine] - base]
        _add(nodes, i, text, (mine - texts.bounds[i]).tolist(), starts.tolist(), ends.tolist(), spans[i])
    return nodes, spans


def _add(nodes: Nodes, doc: int, text: str, words: list[int], starts: list[int], ends: list[int], spans) -> None:
    first = len(nodes.doc)
    shapes, cores, k = [], [], 0
    reach = 0  # furthest end of the spans that begin before the word
    label = 0
    for n, (w, a, b) in enumerate(zip(words, starts, ends)):
        core = text[a:b]
        left, right = _LEFT.match(core), _RIGHT.search(core)
        if left and left.end() < len(core):
            a += left.end()
        if right and right.start() > 0 and b - (len(core) - right.start()) > a:
            b -= len(core) - right.start()
        core = text[a:b]
        while k < len(spans) and spans[k][0] < b:
            if spans[k][2] >= reach:
                reach, label = spans[k][2], spans[k][1] + 1
            k += 1
        shapes.append(_shape(core))
        cores.append(core)
        nodes.doc.append(doc)
        nodes.start.append(a)
        nodes.end.append(b)
        nodes.word.append(w)
        nodes.label.append(label if reach > a else 0)
        nodes.shape.append(_slot(shapes[-1]))
        if n and words[n - 1] == w - 1:
            nodes.chain.append((first + n - 1, first + n))
    nodes.skip.extend((first + a, first + b) for a, b in _links(cores, words, nodes.label[first:]))
    for n, w in enumerate(words):
        before = shapes[n - 1] if n and words[n - 1] == w - 1 else "w"
        after = shapes[n + 1] if n + 1 < len(words) and words[n + 1] == w + 1 else "w"
        nodes.context.append(_slot(f"{before}|{shapes[n]}|{after}"))


@dataclass
class Model:
    shape: np.ndarray  # counts: slot, label
    context: np.ndarray
    chain: np.ndarray  # counts: label, label
    skip: np.ndarray

    def unary(self, nodes: Nodes) -> np.ndarray:
        prior = self.shape.sum(0) + np.array([1.0] + [0.1] * len(KINDS))
        prior = prior / prior.sum()
        seen = self.shape[nodes.shape]
        by_shape = (seen + 2 * prior) / (seen.sum(1, keepdims=True) + 2)
        near = self.context[nodes.context]
        by_context = (near + 4 * by_shape) / (near.sum(1, keepdims=True) + 4)
        return 0.5 * (np.log(by_shape) + np.log(by_context))

    @staticmethod
    def pair(counts: np.ndarray, agree: float) -> np.ndarray:
        """Log of how much more often two labels meet than by chance; ``agree``: prior counts of equal ones."""
        c = counts + counts.T + 0.5 + agree * np.eye(LABELS)
        share = c.sum(1) / c.sum()
        return np.clip(np.log(c / c.sum() / (share[:, None] * share[None])), -3, 3)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return top[..., 0] + np.log(np.exp(x - top).sum(-1))


def marginals(nodes: Nodes, model: Model) -> np.ndarray:
    """Loopy sum-product message passing; words in pattern spans are fixed to their label."""
    unary = model.unary(nodes)
    fixed = np.flatnonzero(nodes.label)
    unary[fixed] = -30.0
    unary[fixed, np.array(nodes.label)[fixed]] = 0.0
    edges = np.array(nodes.chain + nodes.skip, int).reshape(-1, 2)
    if len(edges):
        tables = np.concatenate(
            [
                np.broadcast_to(model.pair(model.chain, 0.0), (len(nodes.chain), LABELS, LABELS)),
                np.broadcast_to(model.pair(model.skip, 5.0), (len(nodes.skip), LABELS, LABELS)),
            ]
        )
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), LABELS))
        tables = tables.transpose(0, 2, 1)
        doc = np.array(nodes.doc)[source]
        live = np.arange(len(source))  # messages of documents that haven't settled
        step, rounds = 1 - DAMPING, 0
        while len(live):
            belief = unary.copy()
            np.add.at(belief, target[live], message[live])
            out = _log_sum((belief[source[live]] - message[back[live]])[:, None, :] + tables[live])
            out -= _log_sum(out)[:, None]
            change = step * (out - message[live])
            message[live] += change
            rounds += 1
            step *= 0.95 if rounds > STEADY else 1
            moving = np.unique(doc[live[np.abs(change).max(1) >= SETTLED]])
            live = live[np.isin(doc[live], moving)]
        np.add.at(unary, target, message)
    return np.exp(unary - _log_sum(unary)[:, None])


def labelled(nodes: Nodes) -> np.ndarray:
    """False for words outside the patterns' spans that share a skip edge with one inside."""
    label = np.array(nodes.label)
    known = np.ones(len(label), bool)
    e = np.array(nodes.skip, int).reshape(-1, 2)
    for a, b in ((0, 1), (1, 0)):
        known[e[(label[e[:, a]] > 0) & (label[e[:, b]] == 0), b]] = False
    return known


def train(documents: DataFrame) -> Model:
    """Counts of labels by shape, context and edge, over all documents."""
    names = ("kind", "slot", "n")

    def run(batches):
        tables = [np.zeros((SLOTS, LABELS), np.int64) for _ in range(2)] + [np.zeros((LABELS, LABELS), np.int64) for _ in range(2)]
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                nodes, _ = graph(texts)
                if not nodes.doc:
                    continue
                label = np.array(nodes.label)
                known = labelled(nodes)
                np.add.at(tables[0], (np.array(nodes.shape)[known], label[known]), 1)
                np.add.at(tables[1], (np.array(nodes.context)[known], label[known]), 1)
                for t, edges in ((tables[2], nodes.chain), (tables[3], nodes.skip)):
                    if edges:
                        e = np.array(edges)
                        e = e[known[e].all(1)]
                        np.add.at(t, (label[e[:, 0]], label[e[:, 1]]), 1)
        for kind, t in enumerate(tables):
            flat = t.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(flat[at])], names)

    rows = alone(documents, "text").mapInArrow(run, "kind int, slot long, n long")
    got = rows.groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()  # 2 * SLOTS * LABELS + 2 * LABELS**2 rows at most
    kind, slot, n = (np.array(got[c]) for c in names)
    sizes = (SLOTS, SLOTS, LABELS, LABELS)
    tables = []
    for k, size in enumerate(sizes):
        t = np.zeros(size * LABELS)
        t[slot[kind == k]] = n[kind == k]
        tables.append(t.reshape(size, LABELS))
    return Model(*tables)


def added(nodes: Nodes, model: Model) -> dict[int, list[tuple[int, int, int]]]:
    """Spans that the field finds beside the patterns', by document: runs of words with one sure label."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not nodes.doc:
        return out
    p = marginals(nodes, model)
    best = p[:, 1:].argmax(1) + 1
    label = np.where(p[np.arange(len(p)), best] >= SURE, best, 0)
    open_: list[int] | None = None  # doc, label, last word, start, end, any word outside pattern spans
    for n in range(len(label) + 1):
        here = n < len(label) and label[n] > 0
        if here and open_ and open_[:3] == [nodes.doc[n], label[n], nodes.word[n] - 1] and not nodes.label[n]:
            open_[2], open_[4] = nodes.word[n], nodes.end[n]
            continue
        if open_:
            out.setdefault(open_[0], []).append((open_[3], int(open_[1]) - 1, open_[4]))
            open_ = None
        if here and not nodes.label[n]:
            open_ = [nodes.doc[n], label[n], nodes.word[n], nodes.start[n], nodes.end[n]]
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<kind:string,start:long,end:long>>"


def _listed(spans) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]


def _found(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[W.Texts, list, list]]:
    for texts in W.slices(batch.column("text")):
        nodes, base = graph(texts)
        more = added(nodes, model)
        yield texts, base, [sorted({*base[i], *more[i]}) if i in more else base[i] for i in range(texts.n)]


def annotate(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with base_spans and spans: kind, start, end (code points, end exclusive)."""
    new = ("base_spans", "spans")
    kept = [c for c in documents.columns if c not in new]
    documents = documents.select(*[documents[c] for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema] + [f"{c} {_SPANS_SQL}" for c in new])
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            base, spans = [], []
            for _, b, s in _found(batch, sent.value):
                base += map(_listed, b)
                spans += map(_listed, s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, _SPANS), pa.array(spans, _SPANS)], [*batch.schema.names, *new])

    return documents.mapInArrow(run, schema)


def digest(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, a count for each kind and base_sha256 of the patterns' spans, and spans: all, as text."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    documents = alone(documents, "doc_id", "text")

    def run(batches):
        text = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            sha, all_of = [], []
            for _, base, spans in _found(batch, sent.value):
                for b, s in zip(base, spans):
                    for k in range(len(KINDS)):
                        counts[k].append(sum(x[1] == k for x in b))
                    sha.append(hashlib.sha256(text(b).encode()).hexdigest())
                    all_of.append(text(s))
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(all_of, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with every span of the text replaced by its kind in brackets; overlapping ones by the first's."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = batch.column("text").to_pylist()
            for texts, _, spans in _found(batch, sent.value):
                for i, found in enumerate(spans):
                    if found:
                        text, parts, free = new[texts.first + i], [], 0
                        for a, k, b in found:
                            if a >= free:
                                parts += [text[free:a], f"[{KINDS[k].upper()}]"]
                            free = max(free, b)
                        new[texts.first + i] = "".join([*parts, text[free:]])
            yield batch.set_column(at, "text", pa.array(new, pa.string()))

    return documents.mapInArrow(run, documents.schema)
