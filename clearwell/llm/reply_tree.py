"""Chat formatting of reply trees.

Messages with parents form trees.  Iterative self-joins enumerate the paths
from each leaf to its root: in each round a table of 2^k-th ancestors is joined
with itself, and the paths known so far are joined with it, so that a path of n
messages takes log2(n) rounds.  Branches are ranked by the sum of their
messages' scores, and the best of each tree is formatted as one conversation.

The template is ``<|role|>`` newline text ``<|end|>`` newline for each turn.  In
roles and texts the characters of ESCAPES become pairs: no control string of this or of other common
templates (``</s>``, ``[INST]``) can occur inside a turn, and unescaping gives
back the text.  The loss mask covers the escaped texts of assistant turns.

Edge cases: null texts and roles are empty ones; turns with equal numbers stand
in the order of role and text, and repeated rows stay repeated; null turns come
first; a null conversation id is a conversation of its own; other columns are
ignored; a message whose parent is missing is a root; messages in a cycle, and
those below one, have no root and are left out; equal scores are settled by the
longer branch, then the smaller leaf; very long texts and paths are kept whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

TURN = r"<\|([^<>|]*)\|>\n([^<]*)<\|end\|>\n"


#: Every backslash of an escaped text begins one of these pairs.
ESCAPES = {"\\": "\\s", "<": "\\l", ">": "\\g", "[": "\\b", "|": "\\p"}
END = "<|end|>\n"


def escape(c):
    for raw, safe in ESCAPES.items():
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c):
    for raw, safe in reversed(ESCAPES.items()):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def chain(turns: DataFrame) -> DataFrame:
    """(conv_id, node, parent, role, text, score): each turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", F.row_number().over(order).cast("long").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): every message on the way from each leaf to its root, up steps above the leaf."""
    links = messages.select(F.struct("conv_id").alias("c"), "node", "parent")
    known = links.select("c", F.col("node").alias("parent"), F.lit(True).alias("there"))
    edges = links.join(known, ["c", "parent"], "left").select("c", "node", F.when(F.col("there"), F.col("parent")).alias("parent"))
    edges = written(edges, "edges")
    inner = edges.where("parent IS NOT NULL").select("c", F.col("parent").alias("node")).distinct()
    found = edges.join(inner, ["c", "node"], "left_anti").select("c", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    jump = edges.where("parent IS NOT NULL").select("c", "node", F.col("parent").alias("above"))
    step = 1
    # A leaf may lead into a cycle: its path would never end.
    bound = messages.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while step <= bound:
        further = found.join(jump, ["c", "node"]).select("c", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        found = written(found.unionByName(further), "paths")
        jump = written(jump.join(jump.select("c", F.col("node").alias("above"), F.col("above").alias("next")), ["c", "above"]).select("c", "node", F.col("next").alias("above")), "jumps")
        if jump.isEmpty():
            return found
        step *= 2
    # A cycle is left, or the next round would have found no jump: only paths that end at a root count.
    rooted = found.join(edges.where("parent IS NULL").select("c", "node"), ["c", "node"], "left_semi").select("c", "leaf").distinct()
    return found.join(rooted, ["c", "leaf"], "left_semi")


def best_branches(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, score, turns): the best path of each tree, its turns in order as an array of (role, text)."""
    on_path = paths(messages)
    body = messages.select(F.struct("conv_id").alias("c"), "node", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = on_path.join(body, ["c", "node"])
    rank = rows.groupBy("c", "leaf").agg(F.sum("score").alias("score"), F.max_by("node", "up").alias("root"), F.count("*").alias("n"))
    best = rank.groupBy("c", "root").agg(F.max_by("leaf", F.struct("score", "n", -F.col("leaf"))).alias("leaf"), F.max("score").alias("score"))
    chosen = rows.drop("score").join(best, ["c", "leaf"])
    turns = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("k"), "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return chosen.groupBy("c", "root", "leaf", "score").agg(turns.alias("turns")).select("c.conv_id", "root", "leaf", "score", "turns")


def format_turns(branches: DataFrame) -> DataFrame:
    """branches with formatted, and mask: the (start, end) of each part under the loss, in code points from 0."""
    piece = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    out = branches.withColumn("__p", piece)
    out = out.withColumn("formatted", F.array_join(F.transform("__p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    mask = """aggregate(__p, named_struct('at', 0, 'm', cast(array() AS array<struct<start:int,end:int>>)),
        (s, p) -> named_struct('at', s.at + length(p.head) + length(p.body) + 8,
            'm', CASE WHEN p.loss THEN concat(s.m, array(named_struct('start', s.at + length(p.head), 'end', s.at + length(p.head) + length(p.body)))) ELSE s.m END)).m"""
    return out.withColumn("mask", F.expr(mask)).drop("__p")


def read_turns(formatted: DataFrame) -> DataFrame:
    """formatted with what its text alone says: read (role, text) and, under the mask, read_loss."""
    roles, texts = (F.regexp_extract_all("formatted", F.lit(TURN), F.lit(k)) for k in (1, 2))
    out = formatted.withColumn("read", F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))))
    return out.withColumn("read_loss", F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))))


def report(read: DataFrame) -> DataFrame:
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("read_loss", "")
    return read.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
