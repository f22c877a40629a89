"""Chat formatting: layouts are recognised by a fingerprint of their field paths, mapped to canonical turns by declarative mappings, and written in one reversible template."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Field paths that layouts are told apart by; others in a record are ignored.
RECORD = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, turns array<struct<speaker:string,text:string>>, system string, prompt string, response string, completion string, instruction string, input string, output string, question string, answer string"
PATHS = ["answer", "completion", "conversations[].from", "conversations[].value", "input", "instruction", "messages[].content", "messages[].role", "output", "prompt", "question", "response", "system", "turns[].speaker", "turns[].text"]
#: The JSON reader's limit on the length of a string, which by default is far below that of a text.
READER = {"maxStringLen": str(2**31 - 1)}
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """turns: (role, field) in order, or the array, role and text fields of a list of turns."""

    name: str
    needs: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    array: tuple[str, str, str] = ()
    may: tuple[str, ...] = ()
    roles: bool = False  # whether ROLES are translated

    def fingerprints(self) -> list[str]:
        return [fingerprint_of(self.needs + extra) for n in range(len(self.may) + 1) for extra in combinations(self.may, n)]


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), array=("messages", "role", "content"), may=("system",)),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), array=("conversations", "from", "value"), may=("system",), roles=True),
    Mapping("speaker_text", ("turns[].speaker", "turns[].text"), array=("turns", "speaker", "text"), may=("system",), roles=True),
    Mapping("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response")), may=("system",)),
    Mapping("prompt_completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion")), may=("system",)),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output")), may=("system",)),
    Mapping("instruction_input", ("input", "instruction", "output"), (("user", "instruction\n\ninput"), ("assistant", "output")), may=("system",)),
    Mapping("question_answer", ("answer", "question"), (("user", "question"), ("assistant", "answer")), may=("system",)),
)


def fingerprint_of(paths: tuple[str, ...]) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths that a parsed record holds."""

    def held(path: str) -> Column:
        if "[]." not in path:
            return record[path].isNotNull()
        name, field = path.split("[].")
        return F.coalesce(F.exists(record[name], lambda x: x[field].isNotNull()), F.lit(False))

    return F.sha2(F.array_join(F.filter(F.array(*(F.when(held(p), F.lit(p)) for p in sorted(PATHS))), lambda x: x.isNotNull()), ","), 256)


def canonical_turns(records: DataFrame, record: str = "record", key: str = "conv_id", strict: bool = False) -> DataFrame:
    """(key, pos, role, text, layout) rows from JSON records in any of the mapped layouts.

    A record that is null, not JSON or of no mapped layout gives one row with null pos,
    role, text and layout, so that nothing is lost unseen; with strict it is an error,
    which names the key. Texts may be as long as a column's value can be. Null roles and
    texts become empty; role names of other layouts are translated. Rows with equal keys
    stay apart here and are one conversation to format_turns. An empty table gives no rows.
    """
    parsed = records.select(F.col(key).alias("conv_id"), F.from_json(F.col(record), RECORD, READER).alias("r"))
    parsed = parsed.withColumn("fp", fingerprint(F.col("r")))

    def turns_of(m: Mapping) -> Column:
        if m.array:
            own = F.transform(F.col("r")[m.array[0]], lambda x: F.struct(x[m.array[1]].alias("role"), x[m.array[2]].alias("text")))
        else:
            own = F.array(*(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.col("r")[f] for f in fields.split("\n\n"))).alias("text")) for role, fields in m.turns))
        system = F.when(F.col("r.system").isNotNull(), F.array(F.struct(F.lit("system").alias("role"), F.col("r.system").alias("text"))))
        return F.concat(F.coalesce(system, F.array().cast("array<struct<role:string,text:string>>")), own)

    turns, layout = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    for m in MAPPINGS:
        chosen = F.col("fp").isin(m.fingerprints())
        turns, layout = F.when(chosen, turns_of(m)).otherwise(turns), F.when(chosen, F.lit(m.name)).otherwise(layout)
    if strict:
        unread = F.concat(F.lit("no mapped layout in record "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
        layout = F.when(F.col("fp").isin([p for m in MAPPINGS for p in m.fingerprints()]), layout).otherwise(F.raise_error(unread))
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    translated = F.col("layout").isin([m.name for m in MAPPINGS if m.roles])
    rows = parsed.select("conv_id", layout.alias("layout"), F.posexplode_outer(turns).alias("pos", "turn"))
    role = F.coalesce("turn.role", F.lit(""))
    return rows.select("conv_id", "pos", F.when(F.col("pos").isNotNull(), F.coalesce(F.when(translated, F.element_at(names, role)), role)).alias("role"), F.when(F.col("pos").isNotNull(), F.coalesce("turn.text", F.lit(""))).alias("text"), "layout")


START, BREAK, END = "<|start|>", "\n", "<|end|>\n"


def escaped(c: Column, line: bool = False) -> Column:
    """Text in which no control string can stand; line: nor a line break."""
    c = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))
    return F.replace(c, F.lit("\n"), F.lit("&nl;")) if line else c


def unescaped(c: Column, line: bool = False) -> Column:
    c = F.replace(c, F.lit("&nl;"), F.lit("\n")) if line else c
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code point ranges [start, end) of the assistant's texts).

    Takes (conv_id, pos, role, text) rows; ties in pos go by role, then text. Rows with a
    null pos carry no turn: a conversation of only such rows is an empty string.
    """
    head = F.concat(F.lit(START), escaped(F.coalesce("role", F.lit("")), True), F.lit(BREAK))
    body = escaped(F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "pos", "role", "text", head.alias("head"), body.alias("body"))
    # offsets by a running sum over the rows of a conversation; the grouping after it needs no further shuffle
    size = F.when(F.col("pos").isNotNull(), F.length("head") + F.length("body") + len(END)).otherwise(0)
    before = F.sum(size).over(Window.partitionBy("conv_id").orderBy("pos", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    start = before + F.length("head")
    rows = rows.select("conv_id", F.when(F.col("pos").isNotNull(), F.struct(before.alias("at"), F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("end"))).alias("loss"))).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("t", lambda x: x["loss"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and loss_text, from formatted and loss_spans alone.

    An empty string has no turns; a null one gives nulls. Each row is read by itself, so
    repeated conv_ids stay repeated; an empty table gives no rows.
    """
    pieces = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, BREAK, 1)
        return F.struct(unescaped(F.substr(role, F.lit(len(START) + 1)), True).alias("role"), unescaped(F.substr(x, F.length(role) + 2)).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as one JSON record for each conversation, in the messages layout.

    Null roles and texts become empty; rows without conv_id are one conversation; ties in
    turn go by role, then text, a null turn first; repeated rows are turns each.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    messages = F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return rows.groupBy("conv_id").agg(messages.alias("messages")).select("conv_id", F.to_json(F.struct("messages")).alias("record"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    out = read_back(format_turns(canonical_turns(conversation_records(rows.unionByName(probe)), strict=True)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(9 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;')) + 1 + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 8)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
