"""Chat formatting from an event log, with DataFrame functions only.

A log holds one row per event: ``conv_id, seq, message_id, kind, role, text``.
Kinds are

* ``message``: opens a new message with its text (a null kind means this);
* ``delta``: appends a streamed piece to the open message;
* ``edit``: replaces the message's text;
* ``regenerate``: throws the text away; later deltas rebuild it;
* ``delete``: removes the message.

Other kinds are ignored. The fold groups by (conversation, message), so a hot
conversation is first dealt out by message; only finished messages meet by
conversation, where the rendered text has to be one string anyway.

Defined results: null text or role counts as empty; events with equal ``seq``
are taken by kind, role and text, nulls first; repeated ``message`` rows are
messages of their own; a null ``conv_id`` or ``message_id`` is a value like
any other; an empty log gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Fixed control strings of public chat templates, without their first character.
CONTROL_TAILS = r"/?s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]+\|>"
OPENS_MESSAGE = "message"
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """Put a backslash behind the first character of every control string.

    A control string that already holds backslashes there gets one more, so
    ``unescape`` restores every text exactly.
    """
    return F.regexp_replace(text, rf"([<\[])(?=\\*(?:{CONTROL_TAILS}))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(?=\\*(?:{CONTROL_TAILS}))", "$1")


def fold_messages(events: DataFrame) -> DataFrame:
    """Fold a log into finished messages: ``conv_id, seq, role, text``."""
    kind = F.coalesce("kind", F.lit(OPENS_MESSAGE))
    log = events.select(
        "conv_id", "seq", "message_id", kind.alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).where(F.col("kind").isin(*RESETS, "delta"))
    grouped = log.groupBy("conv_id", "message_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log")
    )
    size = F.size("log")
    # Where messages open: at each "message" event, and at the start in any case.
    opens = F.filter(
        F.sequence(F.lit(1), size),
        lambda i: (i == 1) | (F.element_at("log", i)["kind"] == OPENS_MESSAGE),
    )
    with_opens = grouped.withColumn("opens", opens)
    parts = F.transform(
        F.col("opens"),
        lambda start, k: F.slice(
            F.col("log"), start,
            F.coalesce(F.try_element_at("opens", k + 2), size + 1) - start,
        ),
    )
    messages = with_opens.select("conv_id", F.explode(parts).alias("part"))
    last_reset = F.coalesce(
        F.array_max(
            F.transform(F.col("part"), lambda e, i: F.when(e["kind"].isin(*RESETS), i + 1))
        ),
        F.lit(1),
    )
    return (
        messages.withColumn("from", last_reset)
        .where(F.element_at("part", F.col("from"))["kind"] != "delete")
        .select(
            "conv_id",
            F.col("part")[0]["seq"].alias("seq"),
            F.coalesce(
                F.try_element_at(
                    F.filter(F.transform(F.col("part"), lambda e: e["role"]), lambda r: r != ""), F.lit(1)
                ),
                F.lit(""),
            ).alias("role"),
            F.concat_ws(
                "", F.transform(F.slice("part", F.col("from"), F.size("part")), lambda e: e["text"])
            ).alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """Render messages: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` holds start and length, in code points of ``formatted``, of
    every assistant text. Offsets are running sums over a window, so a long
    conversation costs linear work.
    """
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    body = escape(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = messages.withColumns({"head": head, "body": body}).withColumns({
        "at": F.sum(F.char_length("head") + F.char_length("body") + len(END)).over(before)
        - F.char_length("body") - len(END),
        "n": F.char_length("body").cast("long"),
    })
    span = F.when(F.col("role") == "assistant", F.struct(F.col("at").alias("start"), F.col("n").alias("length")))
    return rows.groupBy("conv_id").agg(
        F.concat_ws(
            "",
            F.transform(
                F.array_sort(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece")))),
                lambda p: p["piece"],
            ),
        ).alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse ``formatted`` and its mask again: adds ``turns`` and ``loss_text``."""
    segments = F.split("formatted", r"<\|im_end\|>\n")
    turns = F.transform(
        F.slice(segments, 1, F.size(segments) - 1),
        lambda s: F.struct(
            F.url_decode(F.substr(s, F.lit(len(START) + 1), F.locate("\n", s) - len(START) - 1)).alias("role"),
            unescape(F.substr(s, F.locate("\n", s) + 1)).alias("text"),
        ),
    )
    masked = F.transform(
        "loss_spans",
        lambda p: unescape(F.substr(F.col("formatted"), (p["start"] + 1).cast("int"), p["length"].cast("int"))),
    )
    return rendered.withColumns({"turns": turns, "loss_text": F.concat_ws("", masked)})


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation with counts and digests of what was read back."""
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
