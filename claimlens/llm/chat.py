"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. It is rendered over successive prefixes
of a conversation, and what each longer prefix adds is the span of the new turn. No knowledge of the
template's markup is used to find the spans. A template that changes what it has already written
(for instance one that strips earlier answers) is detected: a rendering then doesn't begin with the
one before it, and the conversation is flagged instead of getting wrong spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template below and of common chat formats.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<|", "|>"]

_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TO = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
_FROM = {v[1]: k for k, v in _TO.items()}


class Turn(NamedTuple):
    role: str
    text: str


def escape(text: str) -> str:
    """text without any control string; unescape() gives it back."""
    return _ESCAPE.sub(lambda m: _TO[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _FROM[m[1]], text) if "\\" in text else text


def marked_template(turns: list[Turn]) -> str:
    """The default template: each turn is <|role|>, a line feed, its text, </s>, and a line feed."""
    return "".join([f"<|{r}|>\n{t}</s>\n" for r, t in turns])


#: The turn's role and text within a span of the default template.
MARKED_TURN = re.compile(r"<\|(.*?)\|>\n(.*)</s>\n", re.DOTALL)


class Rendering(NamedTuple):
    text: str
    spans: list[tuple[int, int]]
    rewrites: bool


def render_incrementally(turns: list[Turn], template: Callable[[list[Turn]], str]) -> Rendering:
    """The rendering of all turns, the span that each turn added, and whether an earlier part was changed.

    Where a template rewrites history, the spans are those of the steps that only added text; the
    others are empty, at the place up to which both renderings agree.
    """
    before, spans, rewrites = "", [], False
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if now.startswith(before):
            spans.append((len(before), len(now)))
        else:
            rewrites = True
            same = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
            spans.append((same, same))
        before = now
    return Rendering(before, spans, rewrites)


def body_span(rendered: Rendering, turns: list[Turn], k: int, template: Callable[[list[Turn]], str]) -> tuple[int, int]:
    """Where the text of turn k lies in its span; an empty span if the template doesn't keep the text as it is.

    Two more renderings of the same prefix, with no text and with one unlikely character in its place, show
    how long the markup before and behind the text is.
    """
    start, end = rendered.spans[k]
    bare, probe = (template([*turns[:k], Turn(turns[k].role, t)]) for t in ("", "\0"))
    head = probe.rfind("\0")
    if head < start or probe[:head] + probe[head + 1 :] != bare:
        return start, start
    a, b = head, end - (len(bare) - head)
    return (a, b) if rendered.text[a:b] == turns[k].text else (start, start)


def formatted(df: DataFrame, template: Callable[[list[Turn]], str] = marked_template) -> DataFrame:
    """A row per conversation of df (conv_id, turn, role, text): the formatted text and its spans.

    Returns conv_id, formatted, turn_start, turn_end, body_start, body_end (a list of a code-point
    offset per turn), loss (a flag per turn, true for assistants) and rewrites_history.

    Turns are ordered by turn, then role, then text, so that ties and repeated rows, which are kept,
    have one order; null turns come first. A null role or text is empty. Rows of a null conv_id form
    one conversation. An empty table gives no rows; further columns of df are not used. Roles and
    texts are escaped, so that no text can forge markup. Whole conversations are rendered in one task,
    since a template may look at all turns.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("n"), role.alias("role"), text.alias("text")))).alias("turns"))
    turns = turns.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("formatted", "turn_start", "turn_end", "body_start", "body_end", "loss", "rewrites_history")}
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = [Turn(escape(r), escape(t)) for r, t in zip(roles, texts)]
                r = render_incrementally(turns, template)
                bodies = [body_span(r, turns, k, template) for k in range(len(turns))]
                row = (r.text, [s[0] for s in r.spans], [s[1] for s in r.spans], [b[0] for b in bodies], [b[1] for b in bodies], [x == "assistant" for x in roles], r.rewrites)
                for k, v in zip(out, row):
                    out[k].append(v)
            kinds = [pa.string(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.bool_()), pa.bool_()]
            arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["conv_id", *out])

    kind = df.schema["conv_id"].dataType.simpleString()
    lists = ", ".join(f"{k} array<int>" for k in ("turn_start", "turn_end", "body_start", "body_end"))
    return turns.mapInArrow(run, f"conv_id {kind}, formatted string, {lists}, loss array<boolean>, rewrites_history boolean")


def read_back(formatted_df: DataFrame) -> DataFrame:
    """Digests of what the output of formatted() holds, taken from its text, spans and mask alone.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and rewrites_history.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text, a, b, c, d, loss, rewrites in zip(*(batch.column(k).to_pylist() for k in ("formatted", "turn_start", "turn_end", "body_start", "body_end", "loss", "rewrites_history"))):
                turns, learnt = hashlib.sha256(), hashlib.sha256()
                n = 0
                for i, (start, end) in enumerate(zip(a, b)):
                    m = MARKED_TURN.fullmatch(text, start, end)
                    role, body = (unescape(m[1]), unescape(m[2])) if m else ("", "")
                    turns.update(f"{role}\n{body}\n".encode())
                    if loss[i]:
                        part = unescape(text[c[i] : d[i]])
                        learnt.update(part.encode())
                        n += len(part)
                rows.append((len(a), turns.hexdigest(), n, learnt.hexdigest(), len(text), rewrites))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, t) for v, t in zip(columns, kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"])

    kind = formatted_df.schema["conv_id"].dataType.simpleString()
    return formatted_df.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
