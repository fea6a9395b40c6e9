"""Chat formatting at token level: segments are encoded apart, reserved ids spliced in, loss masks made by prefix sums.

Template. system: <<SYS>> text <</SYS>>; user: <s> [INST] text [/INST]; assistant: text </s>; any other role:
<|role|> role <|text|> text <|end|>. The marks are reserved ids behind the vocabulary. Where a mark's string (or a
special token's) occurs in a text, a backslash goes in behind its first character, and a backslash of the text is
doubled; both are undone on reading. Only an assistant's own text is under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import bounded_batches

# The template's marks, in the order of their ids.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")
BOS, EOS, INST, INST_END, SYS, SYS_END, ROLE, TEXT, END = range(len(MARKS))


class Template:
    """The marks' ids and strings, and the escape of control strings, for one vocabulary."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        bpe = self.encoder.bpe
        self.first = bpe.size
        controls = sorted({*MARKS, *bpe.special}, key=len, reverse=True)
        self._control = re.compile("|".join(re.escape(c) for c in controls))
        self._any = re.compile(r"\\|" + self._control.pattern)
        marks = [m.encode() for m in MARKS]
        self.token_data = np.concatenate([bpe.token_data, np.frombuffer(b"".join(marks), np.uint8)])
        self.token_at = np.concatenate([bpe.token_at, bpe.token_at[-1] + np.cumsum([len(m) for m in marks])])

    def escape(self, text: str) -> str:
        if not self._any.search(text):
            return text
        return self._any.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text

    def ids(self, *marks: int) -> list[int]:
        return [self.first + m for m in marks]

    def render(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The formatted bytes of ids, and where each id's bytes start."""
        size = self.token_at[ids + 1] - self.token_at[ids]
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return self.token_data[np.arange(at[-1]) + np.repeat(self.token_at[ids] - at[:-1], size)].tobytes(), at


_LOADED: dict[str, Template] = {}


def template(path: str) -> Template:
    if path not in _LOADED:
        _LOADED[path] = Template(path)
    return _LOADED[path]


def format_turns(df: DataFrame, path: str, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """df's other columns, `ids` (array<int>) and `loss` (array<boolean>) of every turn.

    A null or empty text is a turn without content; a null role is the empty role, spelled out like any unknown one.
    """
    names = [c for c in df.columns if c not in (role_col, text_col, "ids", "loss")]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        around = {"user": (t.ids(BOS, INST), t.ids(INST_END)), "assistant": ([], t.ids(EOS)), "system": (t.ids(SYS), t.ids(SYS_END))}
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                at = {c: i for i, c in enumerate(part.schema.names)}
                roles = [r or "" for r in part.column(at[role_col]).to_pylist()]
                segments = [t.escape(x or "") for x in part.column(at[text_col]).to_pylist()]
                other = [i for i, r in enumerate(roles) if r not in around]
                segments += [t.escape(roles[i]) for i in other]
                raw = [s.encode() for s in segments]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
                ids, cut = t.encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
                spelled = {i: ids[cut[len(roles) + k] : cut[len(roles) + k + 1]] for k, i in enumerate(other)}
                rows, sizes, opens, closes = [], [], [], []
                place = 0
                for i, role in enumerate(roles):
                    body = ids[cut[i] : cut[i + 1]]
                    before, after = around.get(role) or ([*t.ids(ROLE), *spelled[i].tolist(), *t.ids(TEXT)], t.ids(END))
                    rows += [np.array(before, np.int64), body, np.array(after, np.int64)]
                    if role == "assistant":
                        opens.append(place + len(before))
                        closes.append(place + len(before) + body.size)
                    sizes.append(len(before) + body.size + len(after))
                    place += sizes[-1]
                step = np.zeros(place + 1, np.int64)
                np.add.at(step, opens, 1)
                np.add.at(step, closes, -1)
                flat_ids = np.concatenate(rows).astype(np.int32)
                bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(at[c]) for c in names], pa.ListArray.from_arrays(bounds, pa.array(flat_ids)), pa.ListArray.from_arrays(bounds, pa.array(np.cumsum(step)[:-1] > 0))],
                    [*names, "ids", "loss"],
                )

    return bounded_batches(df).mapInArrow(work, f"{kinds}{', ' if kinds else ''}ids array<int>, loss array<boolean>")


def read_back(turns: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row per conversation, from the formatted ids and masks alone.

    conv_col (of its own type), n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns are read in order
    (ties, and rows that repeat a turn, by their ids) as a stream with running digests, so that a conversation of any
    length needs the memory of one batch. Rows with a null id are one conversation. An empty table gives no rows.
    """
    kind = turns.schema[conv_col].dataType
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), "ids", "loss")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        now, state, out, arrow = None, None, [], None

        def closed() -> None:
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            convs, lists, masks, arrow = batch.column(0).to_pylist(), batch.column(2), batch.column(3), batch.schema.field(0).type
            offsets = np.asarray(lists.offsets).astype(np.int64)
            ids = np.asarray(lists.values)[offsets[0] : offsets[-1]].astype(np.int64)
            loss = np.asarray(masks.values.cast(pa.int8()))[offsets[0] : offsets[-1]].astype(bool)
            data, at = t.render(ids)
            for i, conv in enumerate(convs):
                if state is None or conv != now:
                    closed()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                a, b = int(offsets[i] - offsets[0]), int(offsets[i + 1] - offsets[0])
                head = int(ids[a]) - t.first
                if head == BOS:
                    role, x = "user", a + 2
                elif head == SYS:
                    role, x = "system", a + 1
                elif head == ROLE:
                    x = a + int(np.flatnonzero(ids[a:b] == t.first + TEXT)[0]) + 1
                    role = t.unescape(data[at[a + 1] : at[x - 1]].decode())
                else:
                    role, x = "assistant", a
                text = t.unescape(data[at[x] : at[b - 1]].decode())
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                learned = np.flatnonzero(loss[a:b])
                if learned.size:
                    under = t.unescape(data[at[a + learned[0]] : at[a + learned[-1] + 1]].decode())
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += len(data[at[a] : at[b]].decode())
            if len(out) > 5000:
                yield rows_of(out, arrow)
                out.clear()
        closed()
        if out:
            yield rows_of(out, arrow)

    def rows_of(out: list[tuple], arrow: pa.DataType) -> pa.RecordBatch:
        kinds = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"conv {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    sorted_rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "ids")
    return sorted_rows.mapInArrow(work, schema).withColumnRenamed("conv", conv_col)
