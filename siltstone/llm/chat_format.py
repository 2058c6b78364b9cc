"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. The prefixes of a conversation are rendered one
after another; what a prefix's output has beyond the one before is the last turn's span. A template whose output for a
prefix does not begin with the output for the one before rewrites history; that is reported, not guessed around.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]

#: The default template's control strings (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")


def escape(text: str) -> str:
    r"""Doubles backslashes and puts one after the first character of control strings; unescape() undoes it."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def inst_template(turns: Turns) -> str:
    out = []
    for role, text in turns:
        t = escape(text)
        if role == "user":
            out.append(f"<s>[INST]{t}[/INST]")
        elif role == "assistant":
            out.append(f"{t}</s>")
        elif role == "system":
            out.append(f"[SYS]{t}[/SYS]")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE]{t}</s>")
    return "".join(out)


_PIECE = re.compile(r"<s>\[INST\](?P<user>.*?)\[/INST\]|\[SYS\](?P<system>.*?)\[/SYS\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)</s>|(?P<assistant>.*?)</s>", re.S)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn of the default template's output."""
    out, at = [], 0
    while at < len(formatted):
        m = _PIECE.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        name = next(k for k in ("user", "system", "other", "assistant") if m[k] is not None)
        out.append((unescape(m["role"]) if name == "other" else name, unescape(m[name]), *m.span(name)))
        at = m.end()
    return out


def text_span(template: Callable[[Turns], str], seen: Turns, start: int, now: str) -> tuple[int, int]:
    """Where the last turn's text is within its piece of now: what two renderings with other texts don't share."""
    role = seen[-1][0]
    x, y = (template([*seen[:-1], (role, t)])[start:] for t in ("x", "y"))
    head = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    tail = next((i for i, (a, b) in enumerate(zip(reversed(x), reversed(y))) if a != b), min(len(x), len(y)))
    return head, len(now) - start - tail


def spans_of(template: Callable[[Turns], str], turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, int, tuple[int, int] | None, bool]]:
    """(role, piece, its start, span of an assistant's text in it, rewritten) of each turn: renders successive prefixes
    and compares outputs. Every prefix is rendered whole, however many turns it has."""
    seen: Turns = []
    before, start, n = template([]), 0, 0
    for role, text in turns:
        seen.append((role, text))
        now = template(seen)
        rewritten = not now.startswith(before)
        cut = 0 if rewritten or n == 0 else len(before)
        piece = now[cut:]
        yield role, piece, start, text_span(template, seen, cut, now) if role == "assistant" else None, rewritten
        start += len(piece)
        before = now
        n += 1


def _conversations(batches: Iterator[pa.RecordBatch], width: int = 3) -> Iterator[tuple]:
    """(conv_id, iterator over its rows) from sorted batches; rows are held one batch at a time."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    held = next(rows, None)
    while held is not None:
        conv = held[0]

        def own():
            nonlocal held
            while held is not None and held[0] == conv:
                row = held
                held = next(rows, None)
                yield row

        it = own()
        yield conv, it
        for _ in it:
            pass


def _format(template: Callable[[Turns], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(8)]

        def flush() -> pa.RecordBatch:
            b = pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["conv_id", "seq", "role", "piece", "start", "loss_start", "loss_end", "rewritten"])
            for x in out:
                x.clear()
            return b

        size = 0
        for conv, rows in _conversations(batches):
            turns = ((role, text) for _, role, text in rows)
            for seq, (role, piece, start, at, rewritten) in enumerate(spans_of(template, turns)):
                a, b = (at[0] + start, at[1] + start) if at else (None, None)
                for x, v in zip(out, (conv, seq, role, piece, start, a, b, rewritten), strict=True):
                    x.append(v)
                size += len(piece)
                if size > 1 << 20 or len(out[0]) >= 4096:
                    yield flush()
                    size = 0
        if out[0]:
            yield flush()

    return run


TURNS = "conv_id long, seq long, role string, piece string, start long, loss_start long, loss_end long, rewritten boolean"


def format_turns(conversations: DataFrame, template: Callable[[Turns], str] = inst_template) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...) -> one row for each turn, in order within its partition:
    conv_id, seq (from 0), role, piece (the turn's part of the output), start (of the piece, in code points of the
    whole output), loss_start and loss_end (an assistant's text in the whole output, or null), rewritten (the template
    changed what it had put out before this turn).

    Turns go by turn (null last), then role and text, so ties and repeated rows have a defined order and are all
    formatted. A null role or text is empty. conv_id is taken as a long: a string that is no number stops the query. All
    rows with a null conv_id are one conversation, held in one task. An empty table gives no rows; other columns are
    ignored. Rows are streamed in order, but the turns of one
    conversation are held while it is formatted, and each of its prefixes is rendered: the work grows with the square of
    a conversation's length.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text").drop("turn")
    return rows.mapInArrow(_format(template), TURNS)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conv, turns in _conversations(batches):
            every, loss, n, chars, masked, rewritten = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False
            for _, _, _, piece, start, a, b, changed in turns:
                for role, text, _, _ in parse(piece):
                    every.update(f"{role}\n{text}\n".encode())
                    n += 1
                if a is not None:
                    under = unescape(piece[a - start : b - start])
                    loss.update(under.encode())
                    masked += len(under)
                chars += len(piece)
                rewritten |= changed
            yield conv, n, every.hexdigest(), masked, loss.hexdigest(), chars, rewritten

    held: list[tuple] = []
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
    for r in rows():
        held.append(r)
        if len(held) >= 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema=_DIGEST)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema=_DIGEST)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())])


def digests(formatted: DataFrame) -> DataFrame:
    """format_turns() with the default template -> one row a conversation, read back from the pieces."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")
