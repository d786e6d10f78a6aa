"""Chat formatting by schema fingerprints.

Records of any layout are told apart by the set of their nested field paths: its hash
selects a declarative mapping, which says where roles and texts are. Canonical turns
then go through one template, in which control strings inside texts are escaped so that
the output reads back exactly, and a loss mask marks what an assistant said.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import chain, combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha256, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates, this one's included; a backslash or more after the
#: first character marks an escaped one.
CONTROL = re.compile(r"([<\[])(\\*)(/?INST\]|/?s>|</?SYS>>|\|[^|<>\[\]\s\\]{1,64}\|>)")
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``single``: (role, field) in the order of turns. ``many``: list field, and role and text
    inside its elements; these follow the single ones. Each field in ``optional`` may be absent.
    """

    name: str
    single: tuple[tuple[str, str], ...] = ()
    many: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    rename: bool = True

    def fingerprints(self) -> list[str]:
        """Those of all layouts it takes: each choice of optional fields, a list also empty."""
        fields = [f for _, f in self.single]
        lists = [f"{self.many[0]}[].{x}" for x in self.many[1:]] if self.many else []
        must = [f for f in fields if f not in self.optional]
        found = []
        for some in chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1)):
            found.append(fingerprint_of({*must, *some, *lists}))
            if self.many:
                found.append(fingerprint_of({*must, *some, f"{self.many[0]}[]"}))
        return found

    def turns(self, record: dict) -> list[tuple[str, str]]:
        found = [(role, record[f]) for role, f in self.single if record.get(f) is not None]
        if self.many:
            at, role, text = self.many
            found += [(x.get(role) or "", x.get(text) or "") for x in record.get(at) or []]
        text_of = lambda x: x if isinstance(x, str) else json.dumps(x)
        return [(ROLES.get(r, r) if self.rename else r, text_of(t)) for r, t in ((text_of(r), t) for r, t in found)]


MAPPINGS = [
    Mapping("turn_rows", many=("turns", "role", "text"), rename=False),
    Mapping("messages", single=(("system", "system"),), many=("messages", "role", "content"), optional=("system", "id")),
    Mapping("from_value", single=(("system", "system"),), many=("conversations", "from", "value"), optional=("system", "id")),
    Mapping("instruction", single=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input", "id")),
    Mapping("prompt_response", single=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system", "id")),
    Mapping("prompt_completion", single=(("user", "prompt"), ("assistant", "completion")), optional=("id",)),
    Mapping("question_answer", single=(("user", "question"), ("assistant", "answer")), optional=("id",)),
]


def paths(value, at: str = "") -> set[str]:
    """The paths of a nested value's leaves; elements of a list share one, nulls have none."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) or {f"{at}[]"}
    return set() if value is None else {at}


def fingerprint_of(found: set[str]) -> str:
    return f"{xxhash.xxh64_intdigest(chr(10).join(sorted(found)).encode('utf-8', 'surrogatepass')):016x}"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans (code points) under the loss mask: what assistants said."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    found = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(TURN).partition(TEXT)
        found.append((unescape(role), unescape(text)))
    return found


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def format_records(records: DataFrame, id_col: str = "conv_id", json_col: str = "record", mappings: list[Mapping] | None = None) -> DataFrame:
    """``(conv_id, fingerprint, layout, formatted, loss)``, a row for each JSON record.

    An unknown layout has null layout, formatted and loss, so that new layouts can be counted by
    fingerprint; null or broken JSON has a null fingerprint too. Null texts and roles are
    empty. Repeated rows are formatted alike; an empty table gives no rows.
    """
    chosen = {f: m for m in reversed(mappings or MAPPINGS) for f in m.fingerprints()}

    def one(raw: str | None):
        try:
            record = json.loads(raw) if raw else None
        except ValueError:
            record = None
        if not isinstance(record, dict):
            return None, None, None, None
        print_ = fingerprint_of(paths(record))
        mapping = chosen.get(print_)
        if not mapping:
            return print_, None, None, None
        formatted, mask = render(mapping.turns(record))
        return print_, mapping.name, formatted, [{"s": s, "e": e} for s, e in mask]

    def batches(it):
        for batch in it:
            found = [one(x) for x in batch.column(1).to_pylist()]
            kinds = (pa.string(), pa.string(), pa.string(), SPANS)
            columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), *columns], names=["conv_id", "fingerprint", "layout", "formatted", "loss"])

    rows = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(json_col).cast("string").alias("record"))
    return rows.mapInArrow(batches, "conv_id long, fingerprint string, layout string, formatted string, loss array<struct<s:long,e:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns, loss_text)`` from :func:`format_records`'s output alone."""

    def batches(it):
        for batch in it:
            texts, masks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in texts]
            loss = ["".join(unescape(x[m["s"] : m["e"]]) for m in mask) for x, mask in zip(texts, masks)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(turns, TURNS), pa.array(loss, pa.string())], names=["conv_id", "formatted", "turns", "loss_text"])

    rows = formatted.where("layout is not null").select("conv_id", "formatted", "loss")
    return rows.mapInArrow(batches, "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss_text string")


def records_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, record)``: a JSON record for each conversation given as rows of turns.

    Turns are ordered by number, ties by role and text. One conversation is one record, and so
    stands in one task; its size is that of a conversation.
    """
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    bare = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select("conv_id", F.to_json(F.struct(bare.alias("turns"))).alias("record"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    records = records_of(table(spark, sf_dir, "conversations")).unionByName(extra)
    back = read_back(format_records(records))
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(spoken).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), sha256(F.col("loss_text")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
marked AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/?INST\]|/?s>|</?SYS>>|\|[^|<>\[\]\s\\]{1,64}\|>)', '\1\2\\\3', 'g') AS safe_role,
    regexp_replace(text, '([<\[])(\\*)(/?INST\]|/?s>|</?SYS>>|\|[^|<>\[\]\s\\]{1,64}\|>)', '\1\2\\\3', 'g') AS safe_text FROM rows)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length(safe_role) + length(safe_text) + 23)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
