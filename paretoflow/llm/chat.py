"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Template: a turn is ``[INST]role[/INST]text</s>``; roles and texts are escaped, so the three
control strings never occur inside them. Every assistant turn becomes an example of its own:
all preceding turns are context, and the loss mask covers only that reply's escaped text.

Defined cases: a null role or text counts as empty; turns are ordered by (turn, role, text),
null turns first; repeated rows stay as repeated turns; rows whose conv_id is null form one
conversation; a conversation that does not end with an assistant turn also gets one closing
example without a trainable part, so the output holds every turn; an empty table gives an
empty result; further columns of the input are ignored.

An example repeats its context, so a conversation of t turns yields O(t^2) text: that is the
method. One conversation is one row of turns; conversations spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, HEAD_END, CLOSE = "[INST]", "[/INST]", "</s>"
#: First character, any backslashes, and the rest of a control string.
CONTROL = r"([<\[])(\\*)(/s>|INST\]|/INST\])"
ESCAPED = r"([<\[])\\(\\*)(/s>|INST\]|/INST\])"
TURN = r"(?s)\[INST\](.*?)\[/INST\](.*?)</s>"


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of each control string."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Take that backslash away again; exact inverse of :func:`escape`."""
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def expand(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, formatted, loss_start, loss_length.

    ``loss_start`` counts code points from 0; a closing example has loss_length 0 and
    trainable false.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    parts = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == "assistant").alias("own"),
        F.transform(
            "turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(HEAD_END))
        ).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("texts"),
    ).withColumn("full", F.zip_with("heads", "texts", lambda h, x: F.concat(h, x, F.lit(CLOSE))))
    n = F.size("full")
    # The index after the last turn stands for the closing example.
    targets = F.filter(
        F.sequence(F.lit(1), n + 1),
        lambda i: F.when(i <= n, F.get("own", i - 1)).otherwise(~F.element_at("own", -1)),
    )
    examples = parts.select("conv_id", "heads", "texts", "full", F.explode(targets).alias("i"))
    trainable = F.col("i") <= n
    context = F.concat(
        F.array_join(F.slice("full", F.lit(1), F.col("i") - 1), ""),
        F.when(trainable, F.get("heads", F.col("i") - 1)).otherwise(""),
    )
    target = F.when(trainable, F.get("texts", F.col("i") - 1)).otherwise("")
    return examples.select(
        "conv_id",
        F.col("i").cast("long").alias("example"),
        trainable.alias("trainable"),
        context.alias("context"),
        target.alias("target"),
    ).select(
        "conv_id",
        "example",
        "trainable",
        F.concat("context", "target", F.when(F.col("trainable"), CLOSE).otherwise("")).alias("formatted"),
        F.char_length("context").cast("long").alias("loss_start"),
        F.char_length("target").cast("long").alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    return F.arrays_zip(
        F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), unescape).alias("role"),
        F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2)), unescape).alias("text"),
    )


def summarize(examples: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from its examples."""
    read = examples.select(
        "conv_id",
        "example",
        "formatted",
        F.when(
            F.col("trainable"),
            unescape(F.expr("substring(formatted, CAST(loss_start + 1 AS INT), CAST(loss_length AS INT))")),
        ).alias("reply"),
    )
    per = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    turns = F.transform(
        F.arrays_zip(
            F.regexp_extract_all("longest", F.lit(TURN), F.lit(1)).alias("r"),
            F.regexp_extract_all("longest", F.lit(TURN), F.lit(2)).alias("x"),
        ),
        lambda t: F.concat(unescape(t["r"]), F.lit("\n"), unescape(t["x"]), F.lit("\n")),
    )
    loss = F.array_join(F.transform("replies", lambda s: s["reply"]), "")
    return per.select(
        "conv_id",
        turns.alias("turns"),
        loss.alias("loss"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
