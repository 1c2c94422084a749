"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. It is rendered on every prefix of a
conversation; what a render adds to the one before is the span of the newest turn. A render that does not
begin with the render before it rewrote history and is reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """Reversible: the result holds no ``<|``, so no control string."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def marked_turns(turns: Sequence[Turn]) -> str:
    """The built-in template: start mark, role, line feed, text, end mark, line feed. Roles and texts are
    escaped, in roles line feeds too."""
    return "".join([f"{START}{escape(r).replace(chr(10), chr(92) + 'n')}\n{escape(t)}{END}\n" for r, t in turns])


def text_span(rendered: str, start: int, end: int) -> tuple[int, int]:
    """Where the (escaped) text of the turn in ``rendered[start:end]`` of ``marked_turns`` lies."""
    return rendered.index("\n", start, end) + 1, rendered.index(END, start, end)


def read_back(rendered: str) -> list[Turn]:
    """The turns that ``marked_turns`` rendered."""
    out, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        cut = rendered.index("\n", at)
        end = rendered.index(END, cut)
        out.append((unescape(rendered[at + len(START) : cut]), unescape(rendered[cut + 1 : end])))
        at = end + len(END) + 1
    return out


@dataclass
class Rendered:
    text: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)
    #: Turns whose render changed what earlier turns had rendered.
    rewrites: list[int] = field(default_factory=list)


#: The built-in template renders a conversation of more turns in windows of this many, and their sum is checked against one render of the whole.
WINDOW = 512


def render(turns: Sequence[Turn], template: Template = marked_turns, window: int = WINDOW) -> Rendered:
    """Renders every prefix and compares consecutive outputs. Where turn k rewrites history, its span
    begins at the first character that differs, and the spans before it are cut there.

    Prefixes cost the square of the turns. The built-in template only appends, so it renders a long conversation window
    by window, each after the last turn of the one before; if the parts do not add up to what it makes of all turns,
    every prefix is rendered after all. Any other template is rendered on every prefix, at any length."""
    if len(turns) <= window or template is not marked_turns:
        return _prefixes(turns, 0, template)
    out = Rendered()
    for at in range(0, len(turns), window):
        lead = 1 if at else 0
        part = _prefixes(turns[at - lead : at + window], lead, template)
        begin = part.spans[0][0]
        if part.rewrites:
            return _prefixes(turns, 0, template)
        out.spans += [(a - begin + len(out.text), b - begin + len(out.text)) for a, b in part.spans]
        out.text += part.text[begin:]
    return out if out.text == template(turns) else _prefixes(turns, 0, template)


def _prefixes(turns: Sequence[Turn], first: int, template: Template) -> Rendered:
    """Spans of the turns from ``first`` on."""
    out = Rendered(template(turns[:first]) if first else "")
    for k in range(first, len(turns)):
        now = template(turns[: k + 1])
        if now.startswith(out.text):
            at = len(out.text)
        else:
            at = _common(out.text, now)
            out.rewrites.append(k)
            out.spans = [(min(a, at), min(b, at)) for a, b in out.spans]
        out.spans.append((at, len(now)))
        out.text = now
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Consecutive rows of one conversation, over the bounds of batches."""
    key, turns, seen = None, [], False
    for batch in batches:
        for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if seen and k != key:
                yield key, turns
                turns = []
            key, seen = k, True
            turns.append((role or "", text or ""))
    if seen:
        yield key, turns


def format_conversations(
    rows: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Template = marked_turns,
    loss_role: str = "assistant",
    span: Callable[[str, int, int], tuple[int, int]] = text_span,
) -> DataFrame:
    """One row per conversation: its id, ``formatted`` (the rendered string), ``spans`` (start and end of
    every turn in it, code points), ``loss_spans`` (the parts of turns by ``loss_role`` that are trained on)
    and ``rewrites`` (turns at which the template rewrote history; 0-based).

    Rows are ordered by turn, ties by role and text, nulls first. A null text or role is empty; rows
    with a null conversation id form one conversation; equal rows are separate turns; an empty table
    gives none. Rows of one conversation go to one task, sorted by Spark, and one conversation at a
    time is in memory. Other columns are left out."""
    kind = rows.schema[conv].dataType.simpleString()
    schema = f"`{conv}` {kind}, formatted string, spans array<struct<start:int,end:int>>, loss_spans array<struct<start:int,end:int>>, rewrites array<int>"
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(found: list) -> pa.RecordBatch:
            key, done = [x[0] for x in found], [x[1] for x in found]
            as_pairs = lambda x: pa.array([[{"start": a, "end": b} for a, b in y] for y in x], pairs)
            return pa.RecordBatch.from_arrays(
                [pa.array(key, key_type), pa.array([d.text for d in done], pa.string()), as_pairs([d.spans for d in done]), as_pairs([x[2] for x in found]), pa.array([d.rewrites for d in done], pa.list_(pa.int32()))],
                names=[conv, "formatted", "spans", "loss_spans", "rewrites"],
            )

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("conv").type
                yield batch

        key_type, found, held = None, [], 0
        for key, turns in _group(typed()):
            done = render(turns, template)
            loss = [span(done.text, *at) for (r, _), at in zip(turns, done.spans, strict=True) if r == loss_role]
            found.append((key, done, loss))
            held += len(done.text)
            if held > 4 << 20:
                yield flush(found)
                found, held = [], 0
        if found:
            yield flush(found)

    plain = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), *(F.col(f"`{a}`").cast("string").alias(b) for a, b in ((role, "role"), (text, "text"))))
    return plain.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(run, schema)


def digests(formatted: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """What ``formatted`` says when it is read back: turns, and the text under the loss mask."""
    kind = formatted.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = read_back(text)
                said = "".join([unescape(text[x["start"] : x["end"]]) for x in loss])
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                for c, v in zip(cols, (len(turns), sha("".join([f"{r}\n{t}\n" for r, t in turns])), len(said), sha(said), len(text)), strict=False):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(conv), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=False))],
                names=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select(conv, "formatted", "loss_spans").mapInArrow(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
