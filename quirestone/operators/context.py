"""Token-budgeted context, citations and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirestone.functions.text import first_tokens, is_blank, token_count, trim_ws
from quirestone.session import written

#: Fixed value: the system prompt, with a place for the output format.
SYSTEM_PROMPT = (
    "You are an enterprise knowledge assistant. Answer only from the provided context and cite sources by citation id. "
    "If the answer is not contained in the context, say you do not know. Respond in {output_format} format."
)


def budgeted(candidates: DataFrame, *, query: str, rank: str, text: str, budget: int) -> DataFrame:
    """Candidates in rank order until the budget of tokens is used, the last one cut.

    Blank ones are skipped. Adds ``citation_id`` (c and the rank, gaps stay), ``tokens_before``,
    ``tokens`` (taken) and ``truncated``; ``text`` is cut to what is taken.
    """
    order = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    rows = candidates.filter(~is_blank(F.col(text))).withColumn("__n", token_count(F.col(text)))
    rows = rows.withColumn("tokens_before", F.coalesce(F.sum("__n").over(order), F.lit(0))).filter(F.col("tokens_before") < budget)
    room = F.lit(budget) - F.col("tokens_before")
    return (
        rows.withColumn("truncated", F.col("__n") > room)
        .withColumn("tokens", F.least(F.col("__n").cast("long"), room))
        .withColumn(text, F.when(F.col("truncated"), first_tokens(F.col(text), room.cast("int"))).otherwise(F.col(text)))
        .withColumn("citation_id", F.concat(F.lit("c"), F.col(rank).cast("string")))
        .drop("__n")
    )


def context_statistics(context: DataFrame, query: str) -> DataFrame:
    """``citations``, ``used_tokens`` and ``truncated`` of each query's context."""
    return context.groupBy(query).agg(F.count(F.lit(1)).alias("citations"), F.sum("tokens").alias("used_tokens"), F.max("truncated").alias("truncated"))


def citation_line(citation: Column, document: Column, page: Column, path: Column) -> Column:
    """``[c1] document page 3 Heading > Heading``; what is missing is left out."""
    trail = F.nullif(F.array_join(path, " > "), F.lit(""))
    return F.concat_ws(" ", F.concat(F.lit("["), citation, F.lit("]")), document, F.concat(F.lit("page "), page.cast("string")), trail)


def history_line(role: Column, content: Column) -> Column:
    """``Role: content``, the role with a capital first letter."""
    return F.concat(F.upper(F.left(role, F.lit(1))), F.lower(F.substr(role, F.lit(2))), F.lit(": "), content)


def prompts(context: DataFrame, questions: DataFrame, *, query: str, output_format: str = "markdown") -> DataFrame:
    """System prompt, history, context block and user prompt of each question, with their token counts.

    ``context`` has ``rank``, ``citation_id``, ``document_id``, ``page``, ``header_path`` and ``text``; ``questions``
    has ``question`` and may have ``history``, an array of ``role`` and ``content``. The context of a query is bounded by its
    token budget. ``context_tokens`` are those of the texts alone, without labels and citations.
    """
    row = F.struct("rank", F.col("text").alias("text"), citation_line(F.col("citation_id"), F.col("document_id"), F.col("page"), F.col("header_path")).alias("line"))
    blocks = context.groupBy(query).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    joined = questions.join(blocks, query, "left")
    texts, lines = F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n"), F.transform("rows", lambda r: r["line"])
    block = F.coalesce(F.concat(F.lit("Context:\n"), texts, F.lit("\n\nCitations:\n"), F.array_join(lines, "\n")), F.lit(""))
    said = F.lit("")
    if "history" in questions.columns:
        said = F.coalesce(F.array_join(F.transform("history", lambda h: history_line(F.coalesce(F.nullif(trim_ws(h["role"]), F.lit("")), F.lit("user")), trim_ws(F.coalesce(h["content"], F.lit(""))))), "\n"), F.lit(""))
    out = joined.select(
        query,
        F.lit(SYSTEM_PROMPT.format(output_format=output_format)).alias("system_prompt"),
        said.alias("history_block"),
        block.alias("context_block"),
        F.concat(F.lit("Question: "), F.col("question")).alias("user_prompt"),
        token_count(texts).alias("context_tokens"),
    )
    out = out.withColumns({f"{p}_tokens": token_count(F.col(c)) for p, c in (("system", "system_prompt"), ("history", "history_block"), ("user", "user_prompt"))})
    return out.withColumn("prompt_tokens", F.col("system_tokens") + F.col("history_tokens") + F.col("context_tokens") + F.col("user_tokens"))


def routed(providers: DataFrame, *, preferred: str | None = None, security: str | None = None) -> DataFrame:
    """Healthy providers in the order in which they are tried, as ``attempt`` from 1.

    By preference, priority (100 if none), cost and latency tier (low 0, medium 1, high 2, else a number
    or 1), and name. Sorted in ranges; each range is numbered on from the sizes of those before it.
    """
    tier = lambda c: F.when(c == "low", 0).when(c == "medium", 1).when(c == "high", 2).otherwise(F.coalesce(F.try_to_number(c, F.lit("999")).cast("int"), F.lit(1)))
    usable = providers.filter("healthy")
    if security is not None:
        usable = usable.filter(F.col("security") == security)
    keys = [F.when(F.col("name") == preferred, 0).otherwise(1) if preferred else F.lit(0), F.coalesce("priority", F.lit(100)), tier(F.col("cost_tier")), tier(F.col("latency_tier")), F.col("name")]
    names = [f"__{i}" for i in range(len(keys))]
    ranges = written(usable.withColumns(dict(zip(names, keys))).repartitionByRange(*names).withColumn("__range", F.spark_partition_id()), "providers")
    # as many rows as there are ranges
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*names))
    return ranges.join(F.broadcast(before), "__range").withColumn("attempt", F.col("__before") + place).drop(*names, "__range", "__before")
