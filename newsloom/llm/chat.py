"""Preference formatting: shared prompt, paired masked completions.

For a pair of conversations the longest common prefix of turns (same role and text) is
rendered once as the prompt; each side's further turns become its completion, a list of
segments of which only the assistant's are trained on (``mask`` 1).  When one side is a
prefix of the other its completion is empty.  Native array expressions throughout: a row
holds one pair, and nothing but the turns of a conversation is ever gathered.

A turn is rendered as ``<|role|>``, a line break, its text and a line break.  Within a
text ``<|`` becomes ``<\\|`` (and ``<\\|`` gets one more backslash, so the original can be
told), and ``|>`` within a role likewise: no text can pass for the start of a turn.

Defined cases, for turn tables and for ready pairs alike: a null role is ``unknown``, a
null text empty, a null turn both, and a null list of turns empty; so a null role equals
``unknown`` in the prefix.  Turns sort by number (nulls first), then role and text; a pair
whose side has no turns has an empty prompt; repeated turn rows stay repeated; a null
conv_id is a conversation of its own; empty tables give an empty result; texts have no
bound.  Of the conversations table only the four named columns are read; columns of
``pairs`` pass through under their names, and a result column whose name they take gets
underscores appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm._shared import free_name

_TURN = "struct<role:string,text:string>"


def rendered(turn: Column) -> Column:
    role = F.regexp_replace(turn["role"], r"\|(\\*)>", r"|\\$1>")
    text = F.regexp_replace(turn["text"], r"<(\\*)\|", r"<\\$1|")
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def whole_turns(turns: Column) -> Column:
    """``turns`` without nulls."""
    of = lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    return F.coalesce(F.transform(turns, of), F.array().cast(f"array<{_TURN}>"))


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and its ordered ``turns``."""
    c = conversations
    one = F.struct(c[turn].alias("n"), F.coalesce(c[role], F.lit("unknown")).alias("role"), F.coalesce(c[text], F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list("one"))
    return c.select(c[conv_id].alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["role"], t["text"])).cast(f"array<{_TURN}>").alias("turns")
    )


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    same = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def segments(turns: Column, skip: Column) -> Column:
    """The turns after the first ``skip``, rendered and masked."""
    rest = F.slice(turns, skip + 1, F.greatest(F.size(turns) - skip, F.lit(0)))
    return F.transform(rest, lambda t: F.struct(rendered(t).alias("text"), F.when(t["role"] == "assistant", 1).otherwise(0).alias("mask")))


def preference_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` (its other columns pass through) holds two ordered turn arrays; returns
    n_prompt_turns, prompt, and both completions as arrays of (text, mask)."""
    others = [c for c in pairs.columns if c not in (chosen, rejected)]
    taken = list(others)
    names = {}
    for c in ("n_prompt_turns", "prompt", "chosen_completion", "rejected_completion", "a", "b"):
        names[c] = free_name(taken, c)
        taken.append(names[c])
    a, b, n = F.col(names["a"]), F.col(names["b"]), F.col(names["n_prompt_turns"])
    rows = pairs.select(*[pairs[c] for c in others], whole_turns(pairs[chosen]).alias(names["a"]), whole_turns(pairs[rejected]).alias(names["b"]))
    rows = rows.withColumn(names["n_prompt_turns"], common_prefix(a, b))
    return rows.select(
        *[rows[c] for c in others],
        n,
        F.array_join(F.transform(F.slice(a, 1, n), rendered), "").alias(names["prompt"]),
        segments(a, n).alias(names["chosen_completion"]),
        segments(b, n).alias(names["rejected_completion"]),
    )


def derived_pairs(conversations: DataFrame) -> DataFrame:
    """A pair from each conversation: chosen as it stands; rejected with its last
    assistant turn replaced by an echo of the turn before it (empty where there is
    none), and nothing after it."""
    t = turns_of(conversations)
    flags = F.transform(F.col("turns"), lambda x: x["role"] == "assistant")
    last = F.size("turns") - F.array_position(F.reverse(flags), True).cast("int") + 1
    t = t.withColumn("_last", F.when(F.array_contains(flags, True), last).otherwise(F.size("turns") + 1).cast("int"))
    kept = F.slice("turns", 1, F.col("_last") - 1)
    echo = F.coalesce(F.get(F.col("turns"), F.col("_last") - 2)["text"], F.lit(""))
    rejected = F.concat(kept, F.array(F.struct(F.lit("assistant").alias("role"), echo.alias("text"))))
    return t.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all conversations, with masked texts and their digests."""
    made = preference_pairs(derived_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))

    def joined(c: str) -> Column:
        return F.array_join(F.transform(F.col(c), lambda s: s["text"]), "")

    def trained(c: str) -> Column:
        return F.array_join(F.transform(F.filter(F.col(c), lambda s: s["mask"] == 1), lambda s: s["text"]), "")

    return made.select(
        "conv_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        "prompt",
        joined("chosen_completion").alias("chosen"),
        joined("rejected_completion").alias("rejected"),
        F.array_join(F.transform(F.col("chosen_completion"), lambda s: s["mask"].cast("string")), "").alias("chosen_mask"),
        F.array_join(F.transform(F.col("rejected_completion"), lambda s: s["mask"].cast("string")), "").alias("rejected_mask"),
        F.length(trained("chosen_completion")).cast("long").alias("chosen_trained_chars"),
        F.length(trained("rejected_completion")).cast("long").alias("rejected_trained_chars"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM conversations),
l AS (SELECT conv_id, coalesce(max(n) FILTER (role = 'assistant'), max(n) + 1) AS last FROM t GROUP BY conv_id),
r AS (
  SELECT t.conv_id, n, role, text FROM t JOIN l USING (conv_id) WHERE n < last
  UNION ALL
  SELECT l.conv_id, last, 'assistant', coalesce((SELECT text FROM t WHERE t.conv_id = l.conv_id AND t.n = l.last - 1), '') FROM l),
p AS (
  SELECT conv_id, coalesce(min(n) FILTER (t.role IS NULL OR r.role IS NULL OR t.role <> r.role OR t.text <> r.text), max(n) + 1) - 1 AS k
  FROM t FULL JOIN r USING (conv_id, n) GROUP BY conv_id),
a AS (SELECT conv_id, n, role, '<|' || regexp_replace(role, '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || chr(10) AS x FROM t),
b AS (SELECT conv_id, n, role, '<|' || regexp_replace(role, '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || chr(10) AS x FROM r),
ca AS (
  SELECT conv_id, k, coalesce(string_agg(x, '' ORDER BY n) FILTER (n <= k), '') AS prompt,
    coalesce(string_agg(x, '' ORDER BY n) FILTER (n > k), '') AS chosen,
    coalesce(string_agg((role = 'assistant')::INT::VARCHAR, '' ORDER BY n) FILTER (n > k), '') AS chosen_mask,
    coalesce(sum(length(x)) FILTER (n > k AND role = 'assistant'), 0)::BIGINT AS chosen_trained_chars
  FROM a JOIN p USING (conv_id) GROUP BY conv_id, k),
cb AS (
  SELECT conv_id, coalesce(string_agg(x, '' ORDER BY n) FILTER (n > k), '') AS rejected,
    coalesce(string_agg((role = 'assistant')::INT::VARCHAR, '' ORDER BY n) FILTER (n > k), '') AS rejected_mask,
    coalesce(sum(length(x)) FILTER (n > k AND role = 'assistant'), 0)::BIGINT AS rejected_trained_chars
  FROM b JOIN p USING (conv_id) GROUP BY conv_id)
SELECT conv_id, k::BIGINT AS n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, chosen_trained_chars, rejected_trained_chars
FROM ca JOIN cb USING (conv_id)"""
