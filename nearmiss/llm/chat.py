r"""Chat formatting with Spark expressions only: sort collected turns, merge adjacent turns of a role, mark, escape, concatenate.

Every block is `open` text (`more` text)* `close` with marks by role (MARKS); any other role is written `[#]role\:text`. All marks begin
with `<` or `[` and go on with another character than a backslash. In texts and role names each `<`, `[` and backslash is followed by
one added backslash, so no mark can arise inside them, and taking out one backslash after each of the three restores the text.

Defined results: rows of a conversation are sorted by turn, then role, then text (null turns first); null text is empty; a null
role is a role with an empty name; a null conversation id is one conversation; an empty table gives no conversation; repeated
rows are repeated turns; other columns are ignored.
"""
from pyspark.sql import Column, DataFrame, functions as F

#: Role, opening mark, mark before each further text of the block, closing mark.
MARKS = [("system", "<SYS>", "<+SYS>", "</SYS>"), ("user", "[INST]", "[+INST]", "[/INST]"), ("assistant", "<s>", "<+s>", "</s>")]
OTHER = ("[#]", "[+#]", "[/#]")
NAMED = "\\:"
_OTHER_TURN = r"(?s)^\[\+?#\]((?:[^<\[\\]++|[<\[\\]\\)*+)\\:(.*)$"


def escape(text: Column) -> Column:
    """Text in which no mark can stand."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    """Inverse of escape."""
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _mark(role: Column, which: int) -> Column:
    out = None
    for name, *marks in MARKS:
        out = (F.when if out is None else out.when)(role == name, marks[which])
    other = F.lit(OTHER[which])
    return out.otherwise(F.concat(other, escape(role), F.lit(NAMED)) if which < 2 else other)


def format_chat(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted string, loss array<struct<start,length>> (code points, from 0: assistant texts)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = chats.withColumn("heads", F.filter(F.sequence(F.lit(0), F.size("turns") - 1),
                                               lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"])))
    block = F.transform("heads", lambda head, k: F.struct(
        F.col("turns")[head]["role"].alias("role"),
        F.transform(F.slice(F.col("turns"), head + 1, F.coalesce(F.get("heads", k + 1), F.size("turns")) - head), lambda t: escape(t["text"])).alias("texts")))
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.transform(b["texts"], lambda t, i: F.struct(F.when(i == 0, _mark(b["role"], 0)).otherwise(_mark(b["role"], 1)).alias("mark"), t.alias("text"),
                                                      (b["role"] == "assistant").alias("loss"))),
        F.array(F.struct(_mark(b["role"], 2).alias("mark"), F.lit("").alias("text"), F.lit(False).alias("loss"))))))
    chats = chats.select("conv_id", block.alias("blocks")).select("conv_id", pieces.alias("pieces"))
    lengths = F.transform("pieces", lambda p: F.struct(F.length(p["mark"]).cast("long").alias("m"), F.length(p["text"]).cast("long").alias("t"), p["loss"].alias("loss")))
    spans = F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
                        lambda acc, p: F.struct((acc["at"] + p["m"] + p["t"]).alias("at"),
                                                F.when(p["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + p["m"]).alias("start"), p["t"].alias("length"))))
                                                .otherwise(acc["spans"]).alias("spans")))["spans"]
    return chats.select("conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), "").alias("formatted"), spans.alias("loss"))


def read_chat(formatted: Column) -> Column:
    """array<struct<role,text>> read back from formatted text, one per turn."""
    def turn(segment):
        role, text = None, None
        for name, first, more, _ in MARKS:
            for mark in (first, more):
                hit = segment.startswith(mark)
                role = (F.when if role is None else role.when)(hit, F.lit(name))
                text = (F.when if text is None else text.when)(hit, F.substring(segment, len(mark) + 1, 2**31 - 1))
        other = segment.rlike(_OTHER_TURN)
        return F.struct(unescape(role.when(other, F.regexp_extract(segment, _OTHER_TURN, 1))).alias("role"),
                        unescape(text.when(other, F.regexp_extract(segment, _OTHER_TURN, 2))).alias("text"))

    return F.filter(F.transform(F.split(formatted, r"(?=[<\[][^\\])", -1), turn), lambda t: t["role"].isNotNull())


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
