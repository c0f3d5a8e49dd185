"""Token-budget packing of ordered texts into sections.

Packing is greedy: a text joins the open section while the budget lasts. The
state at any point (tokens in the open section, section number) depends on
everything before it, which looks like one sequential pass per series. It is cut
into order blocks instead. For every block a small table says what state leaves
it for any state that may enter. Tables compose, associatively, so a tree of
them gives each block its entry state, and then all blocks are labelled at the
same time: no task sees a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.functions.text import is_blank, padded_id
from tomeweave.functions.tokens import FourCharacters, TokenCounter
from tomeweave.scale import BLOCK, ROWS_PER_BLOCK, OrderBlocks, once, plan_blocks
from tomeweave.session import cut_lineage

FAN_IN = 32  # neighbouring blocks whose tables one task composes
NORMAL = -1  # burst value of a text that fits the budget


def _check(costs, bursts, limit: int) -> None:
    if ((costs > limit) & (bursts == NORMAL)).any():
        raise ValueError("a text above the budget needs a burst")


def label_run(costs, bursts, limit: int, filled: int, number: int):
    """Section number of each text of a run, given the state that enters it.

    ``bursts[i]`` is NORMAL, or the count of numbers an oversized text uses up by itself.
    """
    _check(costs, bursts, limit)
    n = len(costs)
    prefix = np.concatenate([[0], np.cumsum(costs)])
    oversized = np.flatnonzero(bursts != NORMAL)
    labels = np.empty(n, dtype=np.int64)
    i = 0
    while i < n:
        if bursts[i] != NORMAL:
            number += 1 if filled else 0
            labels[i] = number
            number += int(bursts[i])
            filled = 0
            i += 1
            continue
        at = np.searchsorted(oversized, i)
        stop = int(oversized[at]) if at < len(oversized) else n
        fits = int(np.searchsorted(prefix, prefix[i] + limit - filled, side="right")) - 1
        j = min(fits, stop)
        labels[i:j] = number
        filled += int(prefix[j] - prefix[i])
        i = j
        if i < stop:
            number += 1
            filled = 0
    return labels, filled, number


def transfer_table(costs, bursts, limit: int) -> dict:
    """What a block does to any entering state.

    ``lead[k]`` is the cost of the first k + 1 texts, ``fill[k]``/``used[k]`` the
    leaving state and the numbers used when text k is the first that does not
    join the entering section. ``fresh_*`` answers for an empty entering section.
    Its length is bounded by the texts one section can hold.
    """
    _check(costs, bursts, limit)
    n = len(costs)
    prefix = np.concatenate([[0], np.cumsum(costs)])
    oversized = np.flatnonzero(bursts != NORMAL)
    known: dict[int, tuple[int, int]] = {n: (0, 0)}

    def step(k: int) -> tuple[int, int, int]:
        """From a section opened at k: (next text, numbers used until there, tokens if the block ends)."""
        if bursts[k] != NORMAL:
            return k + 1, int(bursts[k]), 0
        at = np.searchsorted(oversized, k)
        stop = int(oversized[at]) if at < len(oversized) else n
        j = min(int(np.searchsorted(prefix, prefix[k] + limit, side="right")) - 1, stop)
        return (j, 1, 0) if j < n else (n, 0, int(prefix[n] - prefix[k]))

    def leave(k: int) -> tuple[int, int]:
        path = []
        while k not in known:
            after, used, tokens = step(k)
            path.append((k, after, used, tokens))
            k = after
        for at, after, used, tokens in reversed(path):
            fill, more = known[after]
            known[at] = (tokens, 0) if tokens else (fill, used + more)
        return known[path[0][0]] if path else known[k]

    reach = min(n, int(np.searchsorted(prefix[:-1], limit)))
    if len(oversized):
        reach = min(reach, int(oversized[0]) + 1)
    fill, used = [], []
    for k in range(reach):
        tokens, more = leave(k)
        fill.append(tokens)
        used.append(1 + more)
    fresh_fill, fresh_used = leave(0)
    return {
        "lead": [int(x) for x in prefix[1 : reach + 1]],
        "fill": fill,
        "used": used,
        "fresh_fill": fresh_fill,
        "fresh_used": fresh_used,
        "first_oversized": int(oversized[0]) if len(oversized) else n,
        "total": int(prefix[n]),
        "rows": n,
    }


_TABLE = ("lead", "fill", "used", "fresh_fill", "fresh_used", "first_oversized", "total", "rows")


def apply_table(table, limit: int, filled: int, number: int) -> tuple[int, int]:
    """The state leaving a block for the state entering it."""
    if not filled:
        return table["fresh_fill"], number + table["fresh_used"]
    k = int(np.searchsorted(np.asarray(table["lead"], dtype=np.int64), limit - filled, side="right"))
    k = min(k, table["first_oversized"])
    if k >= table["rows"]:
        return filled + table["total"], number
    return table["fill"][k], number + table["used"][k]


def compose_tables(first, second, limit: int) -> dict:
    """The table of two neighbouring blocks, of the same kind as theirs."""
    pairs = [apply_table(second, limit, int(f), int(u)) for f, u in zip(first["fill"], first["used"], strict=True)]
    lead = [int(x) for x in first["lead"]]
    through = first["first_oversized"] == first["rows"] and first["total"] < limit
    if through:
        # All of the first block joins the entering section, which goes on into the second one.
        starts = [0, *second["lead"]][: len(second["fill"])]
        reach = int(np.searchsorted(np.asarray(starts, dtype=np.int64) + first["total"], limit))
        pairs += [(int(f), int(u)) for f, u in zip(second["fill"][:reach], second["used"][:reach], strict=True)]
        lead += [int(first["total"] + x) for x in second["lead"][:reach]]
    fresh_fill, fresh_used = apply_table(second, limit, int(first["fresh_fill"]), int(first["fresh_used"]))
    return {
        "lead": lead,
        "fill": [p[0] for p in pairs],
        "used": [p[1] for p in pairs],
        "fresh_fill": fresh_fill,
        "fresh_used": fresh_used,
        "first_oversized": int(first["first_oversized"] if first["first_oversized"] < first["rows"] else first["rows"] + second["first_oversized"]),
        "total": int(first["total"] + second["total"]),
        "rows": int(first["rows"] + second["rows"]),
    }


def pack(
    items: DataFrame,
    group: Sequence[str],
    order: str,
    cost: Column,
    limit: int,
    burst: Column | None = None,
    blocks: OrderBlocks | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """(group, order, ``section``) rows: the 1-based section number of every item.

    Only the narrow columns group, order, cost and burst are moved. ``order`` must
    be unique per group and every cost at least 1. An item that costs more than
    ``limit`` stands alone; ``burst`` says how many numbers it uses for its own parts.
    """
    blocks = plan_blocks(items, order, rows_per_block) if blocks is None else blocks
    group = list(group)
    keyed = items.select(
        *group,
        order,
        blocks.of(F.col(order)).alias(BLOCK),
        F.greatest(cost, F.lit(1)).cast("bigint").alias("_cost"),
        F.when(cost > limit, F.lit(1) if burst is None else F.coalesce(burst, F.lit(1)))
        .otherwise(NORMAL)
        .cast("bigint")
        .alias("_burst"),
    )
    out_fields = [keyed.schema[g] for g in group] + [keyed.schema[order]]
    labelled = T.StructType([*out_fields, T.StructField("section", T.LongType())])
    keys = [*group, BLOCK]

    def label(rows: pd.DataFrame, filled: int, number: int) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        labels, _, _ = label_run(rows["_cost"].to_numpy(), rows["_burst"].to_numpy(), limit, filled, number)
        return rows[[*group, order]].assign(section=labels)

    table_schema = T.StructType(
        [keyed.schema[k] for k in keys]
        + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("lead", "fill", "used")]
        + [
            T.StructField(n, T.LongType())
            for n in ("fresh_fill", "fresh_used", "first_oversized", "total", "rows")
        ]
    )
    state_schema = T.StructType(
        [keyed.schema[k] for k in keys]
        + [T.StructField(n, T.LongType()) for n in ("entry_fill", "entry_number")]
    )

    def tabulate(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        table = transfer_table(rows["_cost"].to_numpy(), rows["_burst"].to_numpy(), limit)
        head = {k: [rows[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, **{k: [v] for k, v in table.items()}})

    def entered(tables: pd.DataFrame, filled: int = 0, number: int = 1) -> pd.DataFrame:
        """The state that enters each of some neighbouring blocks, from the one that enters the first."""
        tables = tables.sort_values(BLOCK)
        states = []
        for table in tables.to_dict("records"):
            states.append((filled, number))
            filled, number = apply_table(table, limit, filled, number)
        fills, numbers = zip(*states)
        return tables[keys].assign(entry_fill=list(fills), entry_number=list(numbers))

    def folded(tables: pd.DataFrame) -> pd.DataFrame:
        tables = tables.sort_values(BLOCK)
        whole = reduce(lambda x, y: compose_tables(x, y, limit), tables.to_dict("records"))
        head = {k: [tables[k].iloc[0]] for k in group}
        return pd.DataFrame({**head, BLOCK: [int(tables[BLOCK].iloc[0]) // FAN_IN], **{k: [whole[k]] for k in _TABLE}})

    def entered_below(_: tuple, tables: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if tables.empty:
            return pd.DataFrame({f.name: [] for f in state_schema.fields})
        return entered(tables.drop(columns="_up"), int(state["entry_fill"].iloc[0]), int(state["entry_number"].iloc[0]))

    levels = [keyed.groupBy(*keys).applyInPandas(tabulate, table_schema)]
    count = len(blocks.bounds) + 1
    up = F.floor(F.col(BLOCK) / FAN_IN).cast("int")
    while count > FAN_IN:
        levels[-1] = cut_lineage(levels[-1], "block-tables")
        levels.append(levels[-1].groupBy(*group, up.alias("_up")).applyInPandas(lambda t: folded(t.drop(columns="_up", errors="ignore")), table_schema))
        count = -(-count // FAN_IN)
    top = levels.pop()
    if group:
        states = top.groupBy(*group).applyInPandas(lambda tables: entered(tables), state_schema)
    else:
        states = top.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda tables: entered(tables), state_schema)
    while levels:
        below = levels.pop().withColumn("_up", up)
        above = states.withColumn("_up", F.col(BLOCK).cast("int"))
        shared = [*group, "_up"]
        states = below.groupBy(*shared).cogroup(above.groupBy(*shared)).applyInPandas(entered_below, state_schema)

    def label_from(_: tuple, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({f.name: [] for f in labelled.fields})
        entry = state.iloc[0]
        return label(rows, int(entry["entry_fill"]), int(entry["entry_number"]))

    return keyed.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(label_from, labelled)


PART = T.StructType([T.StructField(n, T.IntegerType()) for n in ("part", "first", "count")])


def split_oversized(
    docs: DataFrame, limit: int, separator: str = "\n\n", text: str = "text", tokens: TokenCounter = FourCharacters()
) -> DataFrame:
    """Add ``burst`` and ``parts`` (array<struct(part, text)>): the own sections of a document above the budget.

    Both are null for documents that fit. Only an oversized document's list of
    paragraph costs goes to Python. A first paragraph above the budget closes an
    empty part, which emits nothing but uses a number, and no paragraph is ever cut.
    """

    @F.pandas_udf(T.ArrayType(PART))
    def part_ranges(costs: pd.Series) -> pd.Series:
        def one(row):
            if row is None:
                return None
            number, held, out = 0, 0, []
            for at, c in enumerate(row):
                if held + c > limit:
                    number, held = number + 1, 0
                held += c
                if not out or out[-1]["part"] != number:
                    out.append({"part": number, "first": at, "count": 0})
                out[-1]["count"] += 1
            return out

        return costs.map(one)

    large = F.when(F.col("_tokens") > limit, F.split(F.col(text), separator))
    pieces = docs.withColumn("_pieces", large)
    costs = F.transform(tokens.each(F.coalesce("_pieces", F.array().cast("array<string>"))), lambda c: c + 1)
    costed = pieces.withColumn("_parts", part_ranges(F.when(F.col("_pieces").isNotNull(), costs)))
    # A part is a run of paragraphs, so putting all of them together reads each paragraph once.
    whole = lambda p: F.array_join(F.slice("_pieces", p["first"] + 1, p["count"]), separator)
    return costed.withColumns(
        {
            "burst": (F.element_at("_parts", -1)["part"] + 1).cast("bigint"),
            "parts": F.transform("_parts", lambda p: F.struct(p["part"].cast("bigint").alias("part"), F.concat(whole(p), F.lit(separator)).alias("text"))),
        }
    ).drop("_pieces", "_parts")


def sections(
    docs: DataFrame,
    group: str,
    order: str,
    book: str,
    limit: int,
    text: str = "text",
    separator: str = "\n\n",
    tokens: TokenCounter = FourCharacters(),
    blocks: OrderBlocks | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Pack whole texts into sections of at most ``limit`` tokens.

    Returns group, ``section``, ``chunk_id``, ``text_content``, ``token_count``,
    ``character_count`` and ``included_books``. The texts are read twice: once for
    their costs, from which narrow section numbers are made and stored, and once
    to be put together.
    """
    base = docs.select(group, order, book, F.col(text).alias("_text")).where(F.length("_text") > 0)
    costed = split_oversized(base.withColumn("_tokens", tokens.of(F.col("_text"))), limit, separator, "_text", tokens)
    narrow = costed.select(group, order, "_tokens", "burst")
    numbered = cut_lineage(
        pack(narrow, [group], order, F.col("_tokens"), limit, F.col("burst"), blocks, rows_per_block), "numbers"
    )
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("part"), F.col("_text").alias("text")))
    members = (
        costed.join(numbered, [group, order])
        .select(group, order, book, "section", F.explode(once(F.coalesce("parts", whole))).alias("_p"))
        .select(group, order, book, (F.col("section") + F.col("_p.part")).alias("section"), F.col("_p.text").alias("_text"))
    )
    packed = members.groupBy(group, "section").agg(
        F.array_sort(F.collect_list(F.struct(order, "_text", book))).alias("_members")
    )
    joined = packed.select(
        group,
        "section",
        F.array_join(F.transform("_members", lambda m: m["_text"]), "\n\n").alias("text_content"),
        F.transform("_members", lambda m: m[book]).alias("included_books"),
    )
    return joined.where(~is_blank(F.col("text_content"))).select(
        group,
        "section",
        padded_id("%s_section_%02d", F.col(group), F.col("section")).alias("chunk_id"),
        "text_content",
        tokens.of(F.col("text_content")).alias("token_count"),
        F.length("text_content").cast("bigint").alias("character_count"),
        "included_books",
    )
