"""Chat formatting of reply trees, with DataFrame operations only.

Messages form trees through their parents. Iterated self-joins enumerate the paths: first each message's ancestor two,
four, eight ... steps up, until no message has one that far; then, from the leaves and by descending powers, every
ancestor of each leaf. Both take as many joins as the logarithm of the longest path. Branches are ranked by the sum of
their messages' scores (ties: the smaller leaf), and each chosen path becomes one conversation.

The template marks turns by control strings. Inside roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``,
so no control string can arise from them and ``read_back`` restores them exactly. The loss mask is the list of spans
(first code point, length) of assistant texts in the formatted string.

Edge cases: a null text or role is empty; a message whose parent is missing is a root; a message on a cycle has no root
and no conversation; a null score counts zero; messages that repeat a (tree, message) pair are one message, the first by
parent, role and text; rows that repeat a (conversation, turn) pair are turns of their own, in the order of role and
text; null tree ids form one tree; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltern.llm.common import stage

#: The template: fixed values.
START, END, TURN_BREAK = "<|im_start|>", "<|im_end|>", "\n"
ASSISTANT = "assistant"


def escape(c):
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c):
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def escape_role(c):
    """Roles end at a line break, so theirs are escaped too."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c):
    # a line break is a backslash and n; a backslash of the role is always doubled before it
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(\\.|[^\\]+)"), 1)
    plain = F.transform(pieces, lambda p: F.when(p == "\\n", "\n").when(F.startswith(p, F.lit("\\")), F.substring(p, 2, 1)).otherwise(p))
    return F.array_join(plain, "")


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, position, message) of the ``top`` paths of each tree; position 0 is the root.

    ``messages``: tree long, message long, parent long (null: root), score double.
    """
    key = [F.col("tree").eqNullSafe(F.col("t2"))]
    one = Window.partitionBy("tree", "message").orderBy(F.col("parent").asc_nulls_first(), "score")
    m = messages.where("message is not null").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    known = m.select(F.col("tree").alias("t2"), F.col("message").alias("m2"))
    m = m.join(known, [*key, F.col("parent") == F.col("m2")], "left").select("tree", "message", F.col("m2").alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))
    m = stage(m, "messages")
    # up[k]: each message's ancestor 2**k steps up, where there is one
    up = [m.where("parent is not null").select("tree", "message", F.col("parent").alias("above"))]
    limit = max(1, m.count()).bit_length()
    while not up[-1].isEmpty():
        if len(up) > limit:  # only cycles reach further than there are messages
            break
        step = up[-1].select(F.col("tree").alias("t2"), F.col("message").alias("m2"), F.col("above").alias("above2"))
        longer = up[-1].join(step, [*key, F.col("above") == F.col("m2")]).select("tree", "message", F.col("above2").alias("above"))
        up.append(stage(longer, "ancestors"))
    on_cycle = up[-1].select(F.col("tree").alias("t2"), F.col("message").alias("m2"))  # they still have one that far
    parents = m.where("parent is not null").select(F.col("tree").alias("t2"), F.col("parent").alias("m2")).distinct()
    leaves = m.join(parents, [*key, F.col("message") == F.col("m2")], "left_anti").join(on_cycle, [*key, F.col("message") == F.col("m2")], "left_anti")
    on_path = leaves.select("tree", F.col("message").alias("leaf"), "message", F.lit(0).cast("long").alias("height"))
    for k in range(len(up) - 2, -1, -1):
        step = up[k].select(F.col("tree").alias("t2"), F.col("message").alias("m2"), "above")
        higher = on_path.join(step, [*key, F.col("message") == F.col("m2")]).select("tree", "leaf", F.col("above").alias("message"), (F.col("height") + (1 << k)).alias("height"))
        on_path = stage(on_path.union(higher), "paths")
    scores = m.select(F.col("tree").alias("t2"), F.col("message").alias("m2"), "score")
    total = on_path.join(scores, [*key, F.col("message") == F.col("m2")]).groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.max("height").alias("depth"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))).where(F.col("rank") <= top)
    chosen = ranked.select(F.col("tree").alias("t2"), F.col("leaf").alias("l2"), "rank", "depth")
    return on_path.join(chosen, [*key, F.col("leaf") == F.col("l2")]).select("tree", "leaf", "rank", (F.col("depth") - F.col("height")).alias("position"), "message")


def format_paths(chosen: DataFrame, contents: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): one conversation for each path; loss spans are (start, length) from 0.

    ``contents``: tree, message, role, text.
    """
    said = contents.select(F.col("tree").alias("t2"), F.col("message").alias("m2"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = chosen.join(said, [F.col("tree").eqNullSafe(F.col("t2")), F.col("message") == F.col("m2")])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("tree", "leaf", "rank", "position", (F.col("role") == ASSISTANT).alias("learn"), head.alias("head"), escape(F.col("text")).alias("body"))
    turn = F.struct("position", "learn", "head", "body", F.length("head").cast("long").alias("h"), F.length("body").cast("long").alias("b"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    tail = len(END) + len(TURN_BREAK)
    begun = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: long, length: long>>)").alias("spans"))

    def add(acc, t):
        own = F.array(F.struct((acc["at"] + t["h"]).alias("start"), t["b"].alias("length")))
        return F.struct((acc["at"] + t["h"] + t["b"] + tail).alias("at"), F.when(t["learn"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + TURN_BREAK))), "")
    return whole.select("tree", "leaf", "rank", text.alias("formatted"), F.aggregate("turns", begun, add)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The conversations with ``turns`` (role, text) and ``learned`` (texts under the mask), read from the string alone."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)  # a split always has a part before the first mark
    body = lambda p: F.substring_index(p, END, 1)
    turn = F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"),
            unescape(F.substr(body(p), F.instr(body(p), "\n") + 1)).alias("text"),
        ),
    )
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": turn, "learned": learned})


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations of numbered turns as trees without branches: tree, message, parent, score, role, text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long"))
    above = F.when(F.col("message") > 1, F.col("message") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "message", above.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` paths of each tree as formatted conversations with their loss masks."""
    one = Window.partitionBy("tree", "message").orderBy(F.col("parent").asc_nulls_first(), "role", "text")
    contents = messages.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("tree", "message", "role", "text")
    return format_paths(paths(messages.select("tree", "message", "parent", "score"), top), contents)


def report(formatted: DataFrame) -> DataFrame:
    """The digest of each conversation, read back from the formatted string."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
