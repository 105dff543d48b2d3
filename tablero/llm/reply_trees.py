"""Reply trees to training conversations.

Rows of a tree name their parent. Iterative self-joins, each of which doubles the distance
covered, find every row's root, depth and branch score, so a path of n replies takes about
log2(n) joins. Leaves are ranked per root by the score of their path, and each chosen
root-to-leaf path is formatted as one conversation with a mask over the assistant's texts.

Template: ``<|role|>``, newline, text, ``<|end|>``, newline per turn. Inside roles and texts a
backslash is doubled and one is put into every control string after its first character, so no
text can open or close a turn, and dropping one backslash of each pair gives the text back.

Nulls: a null text, role or score counts as empty or 0. A parent that is missing, or the row
itself, makes a root; rows on or below a cycle are on no root-to-leaf path. Ties go to the
longer path, then the smaller leaf. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablero.llm.shared import Scratch, table

CONTROLS = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]"]
END = "<|end|>\n"
PROBE = ("</s>[INST] ok [/INST]", -7)


def escape(text: Column) -> Column:
    """Reversibly breaks every control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(
        lambda t, s: F.replace(t, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), CONTROLS, doubled
    )


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(nodes: DataFrame, scratch: Scratch, branches: int = 1) -> DataFrame:
    """Rows (tree, leaf, pos, node) of the best ``branches`` root-to-leaf paths of each root.

    ``nodes`` has tree, node, parent, score; (tree, node) is unique and not null.
    """
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    step = nodes.select(
        "tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    ).join(known, (F.col("tree") == F.col("_t")) & (F.col("parent") == F.col("_n")), "left")
    # up: the row 2^k replies above, null past the root; score and depth cover those between.
    # A row past its root is complete; only the others take part in the next round.
    step = scratch.write(step.select(
        "tree", "node", F.col("_n").alias("up"), "score", F.lit(1).cast("long").alias("depth"),
        F.col("node").alias("root"),
    ), "up0")
    jumps = [step]
    rows, open_rows = step.count(), step.where("up is not null").count()
    complete = step.where("up is null")
    while open_rows and 2 ** (len(jumps) - 1) < rows:
        reach = step.where("up is not null")
        above = reach.unionByName(complete).select(
            F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"),
            F.col("score").alias("_score"), F.col("depth").alias("_depth"),
            F.col("root").alias("_root"),
        )
        step = scratch.write(reach.join(
            above, (F.col("tree") == F.col("_t")) & (F.col("up") == F.col("_n"))
        ).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_score"))
            .alias("score"), (F.col("depth") + F.col("_depth")).alias("depth"),
            F.col("_root").alias("root"),
        ), f"up{len(jumps)}")
        open_rows = step.where("up is not null").count()
        jumps.append(step)
        complete = complete.unionByName(step.where("up is null"))

    parents = jumps[0].where("up is not null").select(
        F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    ends = complete.join(
        parents, (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti"
    )
    best = Window.partitionBy("tree", "root").orderBy(
        F.col("score").desc(), F.col("depth").desc(), F.col("node"))
    chosen = scratch.write(ends.withColumn("_rank", F.row_number().over(best)).where(
        F.col("_rank") <= branches
    ).select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("pos"),
             "depth"), "chosen")
    # From the widest jump down, each row on a path adds the one that far above it; a path
    # joins in at the widest jump that it is longer than.
    found = chosen.where(F.col("depth") > 2 ** len(jumps))
    for k in reversed(range(len(jumps))):
        above = jumps[k].where("up is not null").select(
            F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        entering = chosen.where((F.col("depth") > 2 ** k) & (F.col("depth") <= 2 ** (k + 1)))
        here = F.struct("node", "pos")
        there = F.struct(F.col("up").alias("node"), (F.col("pos") + 2 ** k).alias("pos"))
        found = found.unionByName(entering).join(
            above, (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n")), "left"
        ).select("tree", "leaf", "depth", F.explode(F.when(
            F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("row")
        ).select("tree", "leaf", "row.node", "row.pos", "depth")
    return found.unionByName(chosen.where("depth = 1")).select("tree", "leaf", "pos", "node")


def format_paths(turns: DataFrame) -> DataFrame:
    """One row per (tree, leaf): ``formatted`` and ``loss``, the spans under the mask.

    ``turns`` has tree, leaf, pos (falling towards the leaf), role and text.
    """
    body = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("<|"), escape(F.coalesce("role", F.lit(""))), F.lit("|>\n"))
    pieces = turns.select(
        "tree", "leaf", "pos", head.alias("head"), body.alias("body"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("learned"),
    ).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("pos").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = pieces.withColumn(
        "start", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0))
        + F.length("head")
    )
    grouped = placed.groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("_pieces"),
        F.sort_array(F.collect_list(F.when(F.col("learned"), F.struct(
            "start", (F.col("start") + F.length("body")).alias("end"))))).alias("loss"),
    )
    return grouped.select(
        "tree", "leaf", F.array_join(F.transform("_pieces", lambda p: p["piece"]), "")
        .alias("formatted"), "loss",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    ends = F.split(formatted, r"<\|end\|>\n", -1)
    turns = F.slice(ends, 1, F.size(ends) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring(t, F.lit(3), F.instr(t, "|>") - 3)).alias("role"),
        unescape(F.substring(t, F.instr(t, "|>") + 3, F.length(t))).alias("text"),
    ))


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the mask, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def conversations(rows: DataFrame, branches: int = 1) -> DataFrame:
    """Formats conversations given as rows by turn: each row replies to the one before.

    Every row scores 1, so the longest branch wins. Rows of equal turn follow each other by
    role, then text; rows without a conversation id form one conversation.
    """
    scratch = Scratch(rows.sparkSession, "reply-trees")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = scratch.write(rows.select(
        F.struct("conv_id").alias("tree"), "role", "text",
        F.row_number().over(order).cast("long").alias("node"),
    ), "rows")
    nodes = numbered.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.lit(1.0).alias("score"),
    )
    turns = paths(nodes, scratch, branches).join(numbered, ["tree", "node"])
    return format_paths(turns).select("tree.conv_id", "leaf", "formatted", "loss")


def query(spark: SparkSession, path: str) -> DataFrame:
    """``op10_reply_trees``: digests read back from the formatted conversations."""
    rows = table(spark, path, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE[1]).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE[0]).alias("text"),
    )
    out = conversations(rows.unionByName(probe)).select(
        "conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
        masked(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    said = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def sql() -> str:
    """The same digests in DuckDB, straight from the rows."""
    def grown(column: str) -> str:
        expr = f"replace({column}, '\\', '\\\\')"
        for s in CONTROLS:
            expr = f"replace({expr}, '{s}', '{s[0]}\\{s[1:]}')"
        return expr

    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0,
    text AS t0 FROM conversations
  UNION ALL SELECT {PROBE[1]}, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PROBE[0]}',
    CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PROBE[0]}'
  FROM (SELECT unnest(range(0, 2)) AS i))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), ''
    ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST,
    t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(2 + length({grown('role')}) + 3 + length({grown('text')}) + {len(END)})::BIGINT
    AS formatted_chars
FROM r GROUP BY conv_id"""
