"""Chat formatting by schema fingerprints, in built-in functions only.

Records arrive as JSON in different layouts. The nested field paths of a record
(its variant schema without the scalar types) are hashed; the hash selects a
declared mapping, which turns the record into canonical turns. Turns are
written with the marks ``<|im_start|>`` and ``<|im_end|>``; inside texts each
``<|`` gets a backslash between its characters (and each ``<\\|`` one more), so
no text can hold a mark and the escape can be undone. The loss mask is a list
of run lengths, one entry a turn.

Spark's JSON readers give null for a string of more than 20,000,000 characters
and for a variant of more than 128 MiB. So a conversation of more than ``RUN``
characters is written as several records (``parts``), its roles and texts in
pieces of ``PIECE`` characters; ``canonical`` reads each record by itself and
puts the pieces together again.

Defined results: null texts and roles count as empty; rows of a conversation
are ordered by turn, equal turns by role and text, repeated rows stay; a null
id is a conversation of its own; a record whose layout no mapping knows has
null ``layout``, ``turns`` and ``formatted``; a record of more than ``CERTAIN``
characters that cannot be parsed is an error, since it may just be too large for
the readers; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
#: characters of a role or text in one piece, and of a record, with TURN more for each of its turns
PIECE, RUN, TURN = 1 << 20, 8 << 20, 64
#: a record with no more characters than this is never too large for the readers
CERTAIN = 10_000_000


@dataclass(frozen=True)
class Layout:
    """A declared mapping: either a list of messages with role and text fields
    (and other names of roles), or one field for each role."""

    name: str
    messages: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, str], ...] = ()

    def shape(self) -> str:
        """The normal form of the layout's field paths."""
        if self.messages:
            return f"OBJECT<{self.messages}: ARRAY<OBJECT<{', '.join(sorted((self.role, self.text)))}>>>"
        return f"OBJECT<{', '.join(sorted(f for f, _ in self.fields))}>"

    def turns(self, record: Column) -> Column:
        if self.messages:
            schema = f"{self.messages} array<struct<{self.role}:string,{self.text}:string>>"
            names = F.create_map(*[F.lit(x) for kv in self.roles.items() for x in kv]) if self.roles else None

            def turn(m: Column) -> Column:
                role = m[self.role] if names is None else F.coalesce(F.try_element_at(names, m[self.role]), m[self.role])
                return F.struct(role.alias("role"), m[self.text].alias("text"))

            return F.transform(F.from_json(record, schema)[self.messages], turn)
        row = F.from_json(record, ", ".join(f"{f} string" for f, _ in self.fields))
        return F.array(*[F.struct(F.lit(r).alias("role"), row[f].alias("text")) for f, r in self.fields])


LAYOUTS = (
    Layout("messages", "messages", "role", "content"),
    Layout("conversations", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    Layout("prompt", fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("instruction", fields=(("system", "system"), ("instruction", "user"), ("output", "assistant"))),
)


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON record (that of null if it is no JSON)."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    schema = F.when(schema.isNull() & (F.length(record) > CERTAIN), F.raise_error(F.concat(
        F.lit("cannot parse a record of "), F.length(record).cast("string"), F.lit(
            " characters: it is no JSON, has a string of over 20,000,000 characters or needs over 128 MiB"))
        ).cast("string")).otherwise(schema)
    return F.xxhash64(F.regexp_replace(schema, r": (?!OBJECT|ARRAY)[A-Z_]+(\(\d+,\d+\))?", ""))


def _recognised(record: Column, fp: Column, layouts: tuple[Layout, ...]) -> tuple[Column, Column]:
    """Layout and turns of a record with the fingerprint ``fp``."""
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        hit = fp == F.xxhash64(F.lit(x.shape()))
        name = F.when(hit, x.name).otherwise(name)
        turns = F.when(hit, x.turns(record).cast(TURNS)).otherwise(turns)
    return name, turns


def _put_together(pieces: Column) -> Column:
    """Turns of pieces: the first piece of a turn has the number of them as ``n``, the others 0."""
    def whole(all_: Column) -> Column:
        first = F.filter(F.transform(all_, lambda p, i: F.struct(p["n"].alias("n"), i.alias("i"))), lambda x: x["n"] > 0)

        def turn(x: Column) -> Column:
            return let(F.slice(all_, x["i"] + 1, x["n"]), lambda ps: F.struct(
                F.array_join(F.transform(ps, lambda p: p["turn"]["role"]), "").alias("role"),
                F.array_join(F.transform(ps, lambda p: p["turn"]["text"]), "").alias("text")))

        return F.transform(first, turn)

    return let(pieces, whole)


def canonical(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``layout`` and ``turns`` of each record by its fingerprint."""
    kept = df.drop("layout", "turns").withColumn("__fp", fingerprint(F.col(record)))
    name, turns = _recognised(F.col(record), F.col("__fp"), layouts)
    if "parts" in df.columns:
        def read(part: Column) -> Column:
            def known(fp: Column) -> Column:
                name, turns = _recognised(part["record"], fp, layouts)
                return F.struct(name.alias("layout"), F.zip_with(
                    turns, part["n"], lambda t, n: F.struct(t.alias("turn"), n.alias("n"))).alias("pieces"))

            return let(fingerprint(part["record"]), known)

        kept = kept.withColumn("__parts", F.transform("parts", read))
        cut = F.col("parts").isNotNull()
        name = F.when(cut, F.get("__parts", F.lit(0))["layout"]).otherwise(name)
        turns = F.when(cut, _put_together(F.flatten(F.transform("__parts", lambda p: p["pieces"])))).otherwise(turns)
    return kept.withColumns({"layout": name, "turns": turns}).drop("__fp", "__parts", "parts")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def formatted(df: DataFrame) -> DataFrame:
    """Add ``formatted`` and ``mask``: for each turn the characters before its
    text, of its text and after it, and whether the text counts for the loss."""
    def parts(t: Column) -> Column:
        head = F.concat(F.lit(START), F.url_encode(F.coalesce(t["role"], F.lit(""))), F.lit("\n"))
        body = escape(F.coalesce(t["text"], F.lit("")))
        return F.struct(head.alias("head"), body.alias("body"),
                        F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss"))

    tail = END + "\n"
    out = df.drop("formatted", "mask").withColumn("__parts", F.transform("turns", parts))
    return out.withColumns({
        "formatted": F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), ""),
        "mask": F.transform("__parts", lambda p: F.struct(
            F.length(p["head"]).alias("before"), F.length(p["body"]).alias("text"), F.lit(len(tail)).alias("after"),
            p["loss"].alias("loss"))),
    }).drop("__parts")


def read_back(df: DataFrame) -> DataFrame:
    """``read``: role, text and the text under the loss mask of each turn, from
    ``formatted`` and ``mask`` alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.size("mask"))

    def turn(p: Column, i: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 2 - len(END))
        run = F.get(F.col("mask"), i)
        under = F.when(run["loss"], F.substr(p, run["before"] - len(START) + 1, run["text"])).otherwise("")
        return F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text"), unescape(under).alias("loss"))

    return df.drop("read").withColumn("read", F.transform(pieces, turn))


def gathered(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Conversations as ``id_col`` and ``turns`` from rows of role and text by turn."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), text_or_empty("text").alias("text"))
    return rows.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("turns")) \
        .withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _list_record(turns: Column, plain: Column) -> Column:
    """A JSON record in a layout with a list of messages."""
    def renamed(t: Column) -> Column:
        return F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"])

    messages = F.to_json(F.struct(F.transform(turns, lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    conversations = F.to_json(F.struct(F.transform(turns, lambda t: F.struct(
        renamed(t).alias("from"), t["text"].alias("value"))).alias("conversations")))
    return F.when(plain, messages).otherwise(conversations)


def _parts(turns: Column, even: Column, piece: int, run: int) -> Column:
    """Records of bounded runs of a conversation's pieces, each with the ``n`` of its pieces (see ``_put_together``)."""
    def cut(t: Column) -> Column:
        last = F.floor((F.greatest(F.length(t["role"]), F.length(t["text"]), F.lit(1)) - 1) / piece).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            *[F.substr(t[f], i * piece + 1, F.lit(piece)).alias(f) for f in ("role", "text")],
            F.when(i == 0, last + 1).otherwise(0).alias("n")))

    def runs(pieces: Column) -> Column:
        largest = F.array_max(F.transform(pieces, lambda p: F.length(p["role"]) + F.length(p["text"]) + TURN))
        bounds = F.struct(F.greatest(F.floor(F.lit(run) / largest).cast("int"), F.lit(1)).alias("each"),
                          (even | F.exists(pieces, lambda p: p["role"].isin("human", "gpt"))).alias("plain"))

        def made(b: Column) -> Column:
            def record(k: Column) -> Column:
                return let(F.slice(pieces, k * b["each"] + 1, b["each"]), lambda ps: F.struct(
                    _list_record(ps, b["plain"]).alias("record"), F.transform(ps, lambda p: p["n"]).alias("n")))

            return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / b["each"]).cast("int")), record)

        return let(bounds, made)

    return let(F.flatten(F.transform(turns, cut)), runs)


def as_records(conversations: DataFrame, id_col: str = "conv_id", piece: int = PIECE, run: int = RUN) -> DataFrame:
    """JSON records in the four layouts: the roles decide where a layout has
    fixed ones, the id otherwise. A conversation of more than ``run`` characters
    has no ``record`` but ``parts``, several records of pieces of it."""
    turns, roles = F.col("turns"), F.transform("turns", lambda t: t["role"])

    def text(i: int) -> Column:
        return F.get(turns, F.lit(i))["text"]

    even = F.coalesce(F.col(id_col), F.lit(0)) % 2 == 0
    two = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion")))
    three = F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))
    named = F.exists(roles, lambda r: r.isin("human", "gpt"))
    record = F.when(roles == F.array(F.lit("user"), F.lit("assistant")), two) \
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), three) \
        .otherwise(_list_record(turns, named | even))
    chars = F.aggregate(turns, F.lit(0).cast("bigint"), lambda n, t: n + TURN + F.coalesce(F.length(t["role"]), F.lit(0))
                        + F.coalesce(F.length(t["text"]), F.lit(0)))
    return conversations.withColumn("__long", chars > run).select(
        id_col, F.when(~F.col("__long"), record).alias("record"),
        F.when(F.col("__long"), _parts(turns, even, piece, run)).alias("parts"))
