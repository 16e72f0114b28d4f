"""Plans of sections: the searches they need, the contents they get, and what is wrong with these."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirestone.functions.text import is_blank

TYPES = ("authoring", "technical", "blueprint")


def section_queries(plan: DataFrame, *, key: str, limit: int = 3) -> DataFrame:
    """One search for each reference type that a section needs, in order.

    ``plan`` has ``key``, ``ord``, ``section_id``, ``title``, ``kind`` (of the whole), ``requirements``
    (array) and a boolean column for each type. The text is title, type and kind, and for technical
    searches the requirements, blanks left out.
    """
    needs = F.array(*[F.when(F.col(t), F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"))) for i, t in enumerate(TYPES)])
    rows = plan.select("*", F.explode(F.filter(needs, lambda x: x.isNotNull())).alias("need"))
    parts = F.concat(F.array("title", "need.t", "kind"), F.when(F.col("need.t") == "technical", F.coalesce("requirements", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    text = F.array_join(F.filter(parts, lambda p: ~is_blank(p)), " | ")
    order = Window.partitionBy(key).orderBy("ord", "need.i")
    return rows.select(key, F.row_number().over(order).alias("query_ord"), "section_id", F.col("need.t").alias("reference_type"), text.alias("query"), F.lit(limit).alias("max_results"))


def generation_strategy(authoring, technical, blueprint):
    """How a section is written, by how many references of each type it has."""
    return F.when((authoring > 0) & (technical > 0), "combined").when(technical > 0, "technical").when((authoring > 0) | (blueprint > 0), "reference_based").otherwise("user_input_only")


def assembly_errors(plan: DataFrame, contents: DataFrame, *, key: str, part: str) -> DataFrame:
    """Where contents don't fit a plan: ``key``, ``part`` and ``error``.

    ``duplicate_plan``, ``duplicate_content``, ``missing_content``, ``unplanned_content``.
    """
    count = lambda df, n: df.groupBy(key, part).agg(F.count(F.lit(1)).alias(n))
    both = count(plan, "planned").join(count(contents, "given"), [key, part], "full").na.fill(0, ["planned", "given"])
    rules = {"duplicate_plan": F.col("planned") > 1, "duplicate_content": F.col("given") > 1, "missing_content": F.col("given") == 0, "unplanned_content": F.col("planned") == 0}
    errors = F.filter(F.array(*[F.when(r, F.lit(e)) for e, r in rules.items()]), lambda e: e.isNotNull())
    return both.select(key, part, F.explode(errors).alias("error"))


def assembled(plan: DataFrame, contents: DataFrame, *, key: str, part: str, order: str) -> DataFrame:
    """Contents in the order of the plan; only of wholes without an error."""
    bad = assembly_errors(plan, contents, key=key, part=part).select(key).distinct()
    return contents.join(plan.select(key, part, order), [key, part]).join(bad, key, "left_anti")


def reference_findings(references: DataFrame, *, key: str, part: str, metadata: str | None = None) -> DataFrame:
    """What is wrong with retrieved references: ``key``, ``part``, ``finding`` and ``detail``, each once a part and reference.

    ``invalid_reference`` with the field: a blank text field, or a score that is null, not finite or negative. With ``metadata``, a
    column of maps to numbers, ``invalid_metadata`` with the key: a blank key (detail ``key``) or a number that isn't finite.
    """
    fields = ("reference_id", "reference_type", "chunk_id", "source_document", "content")
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    score = F.col("score").cast("double")
    wrong = F.array(*[F.when(is_blank(F.col(c)), F.lit(c)) for c in fields], F.when(~F.coalesce(finite(score) & (score >= 0), F.lit(False)), F.lit("score")))
    found = F.transform(F.filter(wrong, lambda x: x.isNotNull()), lambda x: F.struct(F.lit("invalid_reference").alias("finding"), x.alias("detail")))
    if metadata:
        entries = F.filter(F.map_entries(metadata), lambda e: is_blank(e["key"]) | (e["value"].isNotNull() & ~finite(e["value"].cast("double"))))
        more = F.transform(entries, lambda e: F.struct(F.lit("invalid_metadata").alias("finding"), F.when(is_blank(e["key"]), "key").otherwise(e["key"]).alias("detail")))
        found = F.concat(found, F.coalesce(more, F.array().cast("array<struct<finding:string,detail:string>>")))
    return references.select(key, part, "reference_id", F.explode(found).alias("f")).select(key, part, "reference_id", "f.*").distinct().drop("reference_id")


def review_findings(plan: DataFrame, contents: DataFrame, references: DataFrame, *, key: str, part: str, retrieved: DataFrame | None = None, metadata: str | None = None) -> DataFrame:
    """What a review finds: ``key``, ``part``, ``finding``, ``detail``.

    ``plan`` has ``ord``, ``contents`` have ``ord`` (the part's place in the whole), ``text`` and ``reference_ids``,
    ``references`` have ``reference_id``. Findings: those of ``assembly_errors``, ``empty_content``, ``unknown_reference``,
    ``out_of_order``, once a part, if its first content's place among the planned ones isn't the plan's (equal
    ``ord``: by part), and those of ``reference_findings`` on ``retrieved``.
    """
    found = assembly_errors(plan, contents, key=key, part=part).select(key, part, F.col("error").alias("finding"), F.lit(None).cast("string").alias("detail"))
    empty = contents.filter(is_blank(F.col("text"))).select(key, part, F.lit("empty_content").alias("finding"), F.lit(None).cast("string").alias("detail"))
    cited = contents.select(key, part, F.explode("reference_ids").alias("reference_id")).distinct()
    unknown = cited.join(references.select(key, "reference_id").distinct(), [key, "reference_id"], "left_anti").select(key, part, F.lit("unknown_reference").alias("finding"), F.col("reference_id").alias("detail"))
    first = lambda df, n: df.groupBy(key, part).agg(F.min("ord").alias(n))
    both = first(contents, "__has").join(first(plan, "__plan"), [key, part])
    places = both.withColumns({n: F.row_number().over(Window.partitionBy(key).orderBy(c, part)) for n, c in (("__a", "__has"), ("__b", "__plan"))})
    moved = places.filter("__a <> __b").select(key, part, F.lit("out_of_order").alias("finding"), F.col("__a").cast("string").alias("detail"))
    more = [] if retrieved is None else [reference_findings(retrieved, key=key, part=part, metadata=metadata)]
    return reduce(DataFrame.unionByName, [found, empty, unknown, moved, *more])


# The blocks of a proposal's prompt.
PROMPT_RULES = "\n".join(
    (
        "Generate only a JSON object conforming to the supplied ProposalResponse schema.",
        "Do not generate Markdown, HTML, DOCX, styling, layout, or explanatory text outside the JSON object.",
        "Use user-supplied project facts as the highest-priority source of truth.",
        "Fact priority is: User Input > Technical References > Authoring References > Blueprint References.",
        "Authoring and blueprint references may guide structure and tone only; never copy their client names, project names, budgets, dates, quantities, or specifications.",
        "Never invent specifications. Omit unsupported content rather than guessing.",
        "Use the required section identifiers exactly once and preserve their order.",
    )
)
SECTION_RULES = "\n".join(
    (
        "Rules:",
        "- section_id values are immutable identifiers. Copy each one exactly.",
        "- Do not rename, add, omit, duplicate, nest, or reorder sections.",
        "- Do not add child sections; the canonical plan contains only the sections listed above.",
        "- Every planned section must appear exactly once.",
        "- If factual information is limited, return a valid minimal section rather than omitting it.",
        "- Do not fabricate unsupported project facts.",
    )
)
REFERENCE_BLOCKS = (("technical", "TECHNICAL_REFERENCES"), ("authoring", "AUTHORING_REFERENCES"), ("blueprint", "BLUEPRINT_REFERENCES"))


def response_schema(key: Column, sections: Column) -> Column:
    """The JSON schema that a proposal's answer has to keep: its id, and exactly the planned sections, none below another."""
    text = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    n = F.size(sections).cast("string")
    ids = F.concat(F.lit("["), F.array_join(F.transform(sections, text), ","), F.lit("]"))
    block = '{"properties":{"type":{"enum":["' + '","'.join(("paragraph", "callout", "requirement_matrix", "bullet_list", "table", "visual_placeholder")) + '"]}},"required":["type"],"type":"object"}'
    return F.concat(
        F.lit('{"properties":{"proposal_id":{"const":'), text(key), F.lit('},"sections":{"items":{"properties":{"blocks":{"items":' + block + ',"type":"array"},"children":{"maxItems":0,"type":"array"},"section_id":{"enum":'), ids,
        F.lit('}},"required":["section_id","blocks"],"type":"object"},"maxItems":'), n, F.lit(',"minItems":'), n, F.lit(',"type":"array"}},"required":["proposal_id","sections"],"type":"object"}'),
    )


def proposal_prompts(projects: DataFrame, plan: DataFrame, references: DataFrame, *, key: str, limit: int = 3) -> DataFrame:
    """The prompt of each proposal: ``system_prompt``, ``user_prompt``, ``schema``, ``strategy`` and the numbers of ``sections`` and ``references``.

    ``projects`` has ``client``, ``title``, ``data`` (map of strings), ``requirements`` and ``constraints`` (arrays), ``plan`` ``ord``, ``section_id`` and
    ``title``, ``references`` ``section_id``, ``reference_type``, ``reference_id``, ``source_document``, ``content`` and ``score``. Of each section and type the
    ``limit`` best references are used (equal scores: the smaller id; a score that isn't a number counts least), so a prompt grows with its plan only.
    Blocks stand in order of priority, keys of ``data`` sorted. References of sections that aren't planned, or of unknown type, are left out.
    """
    last = F.col("score").isNull() | F.isnan("score")
    each = references.groupBy(key, "section_id", "reference_type", "reference_id").agg(F.max_by(F.struct("source_document", "content"), F.when(~last, F.col("score"))).alias("best"), F.min(F.struct("source_document", "content")).alias("any"), F.max(F.when(~last, F.col("score"))).alias("score"))
    place = F.row_number().over(Window.partitionBy(key, "section_id", "reference_type").orderBy(F.desc_nulls_last("score"), "reference_id"))
    used = each.withColumn("place", place).filter(F.col("place") <= limit).join(plan.select(key, "section_id", "ord"), [key, "section_id"])
    row = F.struct("ord", "section_id", "place", "reference_type", "reference_id", F.coalesce("best", "any").alias("r"))
    grouped = used.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("refs"))
    planned = plan.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "section_id", "title"))).alias("plan"))
    rows = projects.join(planned, key).join(grouped, key, "left")
    of_type = lambda t: F.filter(F.coalesce("refs", F.array().cast(grouped.schema["refs"].dataType)), lambda r: r["reference_type"] == t)
    lines = lambda r: F.concat_ws("\n", F.concat(F.lit("Section: "), r["section_id"]), F.concat(F.lit("Reference ID: "), r["reference_id"]), F.concat(F.lit("Source: "), F.coalesce(r["r"]["source_document"], F.lit("None"))), F.concat(F.lit("Content: "), F.coalesce(r["r"]["content"], F.lit("None"))))

    def block(kind: str, name: str) -> Column:
        mine = of_type(kind)
        return F.concat(F.lit(f"[{name}]\nLower priority than user ground truth.\n"), F.when(F.size(mine) == 0, "None retrieved").otherwise(F.array_join(F.transform(mine, lines), "\n")))

    bullets = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, "- None supplied").otherwise(F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n"))
    data = F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("data")))), F.lit("{}"))
    truth = F.concat_ws(
        "\n", F.lit("[USER_GROUND_TRUTH]"), F.lit("Highest priority. Project-specific facts supplied by the user."), F.concat(F.lit("Client: "), F.coalesce("client", F.lit(""))), F.concat(F.lit("Proposal Title: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("Project Data: "), data), F.lit("Requirements:"), bullets("requirements"), F.lit("Constraints:"), bullets("constraints"),
    )
    numbered = F.transform("plan", lambda p, i: F.concat((i + 1).cast("string"), F.lit(". section_id: "), p["section_id"], F.lit("\n   title: "), p["title"]))
    structure = F.concat(F.lit("[PLANNED_SECTION_CONTRACT]\nReturn exactly these top-level sections, exactly once, in exactly this order:\n"), F.array_join(numbered, "\n"), F.lit("\n" + SECTION_RULES))
    schema = response_schema(F.col(key), F.transform("plan", lambda p: p["section_id"]))
    contract = F.concat(F.lit("[OUTPUT_CONTRACT]\nReturn exactly one ProposalResponse JSON object.\n"), schema)
    count = lambda t: F.size(of_type(t))
    facts = [truth, *[block(*b) for b in REFERENCE_BLOCKS], structure]
    return rows.select(
        key,
        F.lit(PROMPT_RULES).alias("system_prompt"),
        F.concat_ws("\n\n", *facts, contract).alias("user_prompt"),
        F.concat_ws("\n\n", *facts).alias("facts"),
        schema.alias("schema"),
        generation_strategy(count("authoring"), count("technical"), count("blueprint")).alias("strategy"),
        F.size("plan").alias("sections"),
        sum((count(t) for t, _ in REFERENCE_BLOCKS[1:]), count(REFERENCE_BLOCKS[0][0])).alias("references"),
    )


def context_errors(queries: DataFrame, references: DataFrame, *, key: str) -> DataFrame:
    """Retrieved references that no search of their section and type asked for, and sections without a search: ``key``, ``section_id``, ``error``, ``reference_id``.

    ``queries`` and ``references`` have ``section_id`` and ``reference_type``. Errors: ``no_queries``, ``incompatible_reference``.
    """
    asked = queries.select(key, "section_id", "reference_type").distinct()
    other = references.select(key, "section_id", "reference_type", "reference_id").distinct().join(asked, [key, "section_id", "reference_type"], "left_anti")
    known = asked.select(key, "section_id").distinct()
    none = other.select(key, "section_id").distinct().join(known, [key, "section_id"], "left_anti").select(key, "section_id", F.lit("no_queries").alias("error"), F.lit(None).cast("string").alias("reference_id"))
    return other.join(known, [key, "section_id"], "left_semi").select(key, "section_id", F.lit("incompatible_reference").alias("error"), "reference_id").unionByName(none)


def answers(responses: DataFrame, context: DataFrame, *, query: str) -> DataFrame:
    """Answers with the documents they cite: ``citations`` (array of id, document, heading) and ``unsupported``.

    ``responses`` has ``text`` and ``cited`` (array of citation ids), ``context`` ``citation_id``, ``document_id``
    and ``header_path``. ``unsupported`` are cited ids that the context doesn't have.
    """
    row = F.struct("citation_id", "document_id", F.try_element_at("header_path", F.lit(-1)).alias("heading"))
    given = context.groupBy(query).agg(F.array_sort(F.collect_list(row)).alias("__given"))
    none = F.array().cast("array<string>")
    joined = responses.join(given, query, "left").withColumn("cited", F.coalesce("cited", none))
    known = F.coalesce(F.transform("__given", lambda g: g["citation_id"]), none)
    return joined.select(query, "text", F.filter("__given", lambda g: F.array_contains("cited", g["citation_id"])).alias("citations"), F.array_sort(F.array_except("cited", known)).alias("unsupported"))
