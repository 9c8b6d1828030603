"""Layouts of pages: cell lists, fields, and the block of lines that a prompt has of them.

A layout is page_number, analyzed, tables (headers and rows of cells) and fields (label and value); a page has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions.text import first_image_caption
from pagegraph.functions.wording import strip
from pagegraph.operators.inference import with_routing
from pagegraph.sources.files import CELL_CHARS, FIELD_COUNT, TABLE_ROWS

TABLES = "array<struct<headers:array<string>,rows:array<array<string>>>>"
FIELDS = "array<struct<label:string,value:string>>"
#: Headings of the block; own words, given as parameters.
HEADINGS = {"page": "Layout of page %d", "tables": "Tables (rows are entries of a list, not documents):", "routing": "Fields of routing (never the author):", "fields": "Fields:"}

# The share of dark pixels from which a page without evidence is an image, the grey below which a pixel is dark, and what such a page says.
INK, DARK = 0.15, 200
NO_TEXT = "Medical image on page; no report text captured."


def cell_tables(cells: DataFrame) -> DataFrame:
    """headers and rows of each table from cells (page_number, table_id, row_index, column_index, content, kind).

    Rows are closed up where cells are missing; headers are the cells of the first row that are marked as such, in the
    order given (cell_seq). Of two cells at one place the later counts.
    """
    place = ["page_number", "table_id", "row_index", "column_index"]
    head = F.when((F.col("kind") == "columnHeader") & (F.col("row_index") == 0), F.struct("cell_seq", F.coalesce("content", F.lit("")).alias("c")))
    headers = cells.groupBy("page_number", "table_id").agg(F.transform(F.array_sort(F.collect_list(head)), lambda x: x["c"]).alias("headers"))
    last = cells.groupBy(*place).agg(F.max_by(F.coalesce("content", F.lit("")), "cell_seq").alias("cell"))
    rows = last.groupBy("page_number", "table_id", "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "cell"))), lambda x: x["cell"]).alias("cells"))
    tables = rows.groupBy("page_number", "table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "cells"))), lambda x: x["cells"]).alias("rows"))
    return tables.join(headers, ["page_number", "table_id"]).select("page_number", "table_id", "headers", "rows")


def pair_fields(pairs: DataFrame) -> DataFrame:
    """Fields of each page in order, from pairs (page_number, pair_seq, label, value) that have both sides."""
    whole = pairs.where((F.coalesce("label", F.lit("")) != "") & (F.coalesce("value", F.lit("")) != ""))
    return whole.groupBy("page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("pair_seq", "label", "value"))), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))).alias("fields"))


def block_texts(blocks: DataFrame) -> DataFrame:
    """page_number, parent and text: what the words and ticked boxes below each block say, in order.

    blocks: page_number, id, block_type, text, selected, entity_types, children and values (ids).
    """
    below = blocks.select("page_number", F.col("id").alias("parent"), F.posexplode("children").alias("pos", "id"))
    said = F.when(F.col("block_type") == "WORD", F.coalesce("text", F.lit(""))).when((F.col("block_type") == "SELECTION_ELEMENT") & F.col("selected"), "[X]")
    words = below.join(blocks.select("page_number", "id", said.alias("said")), ["page_number", "id"]).where("said is not null")
    return words.groupBy("page_number", "parent").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), " ")).alias("text"))


def block_fields(blocks: DataFrame) -> DataFrame:
    """page_number, id, label and value of each key block that has both; of several values the last counts."""
    texts = block_texts(blocks)
    keys = blocks.where((F.col("block_type") == "KEY_VALUE_SET") & F.array_contains("entity_types", "KEY"))
    last = keys.select("page_number", "id", F.try_element_at("values", F.lit(-1)).alias("value_id"))
    labels, values = (texts.select("page_number", F.col("parent").alias(key), F.col("text").alias(name)) for key, name in (("id", "label"), ("value_id", "value")))
    return last.join(labels, ["page_number", "id"]).join(values, ["page_number", "value_id"]).where("label <> '' and value <> ''").select("page_number", "id", "label", "value")


def analysed(answers: DataFrame) -> DataFrame:
    """Layouts of answers (page_number, answer, error); a page whose call failed is there, not analyzed and empty."""
    told = F.from_json("answer", f"tables {TABLES}, fields {FIELDS}")
    ok = F.col("error").isNull() & told.isNotNull()
    return answers.select("page_number", ok.alias("analyzed"), F.coalesce(F.when(ok, told["tables"]), F.array().cast(TABLES)).alias("tables"), F.coalesce(F.when(ok, told["fields"]), F.array().cast(FIELDS)).alias("fields"))


def table_filled(table: Column) -> Column:
    """Some cell says something."""
    return F.exists(F.flatten(table["rows"]), lambda c: strip(c) != "")


def field_usable(field: Column) -> Column:
    """Label and value both say something."""
    return (strip(field["label"]) != "") & (strip(field["value"]) != "")


def is_informative(tables: Column, fields: Column) -> Column:
    """The layout has a table with text, or a usable field."""
    return F.exists(tables, table_filled) | F.exists(fields, field_usable)


def _cell(text: Column) -> Column:
    return F.left(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit(CELL_CHARS))


def _row(cells: Column) -> Column:
    return F.array_join(F.transform(cells, _cell), " | ")


def shown_table(table: Column, number: Column) -> Column:
    """Lines of a table: its size, its headers, its first rows without blank ones, and how many more there are."""
    rows, named = table["rows"], F.filter(table["headers"], lambda h: strip(h) != "")
    head = F.array(F.format_string("TABLE %d (%d row(s)):", number, F.size(rows)))
    columns = F.when(F.size(table["headers"]) > 0, F.array(F.concat(F.lit("  columns: "), _row(named)))).otherwise(F.array().cast("array<string>"))
    shown = F.transform(F.filter(F.slice(rows, 1, TABLE_ROWS), lambda r: F.exists(r, lambda c: strip(c) != "")), lambda r: F.concat(F.lit("  row: "), _row(r)))
    more = F.size(rows) - TABLE_ROWS
    rest = F.when(more > 0, F.array(F.format_string("  ... %d further row(s) not shown", more))).otherwise(F.array().cast("array<string>"))
    return F.concat(head, columns, shown, rest)


def layout_blocks(layouts: DataFrame, headings: dict[str, str] | None = None) -> DataFrame:
    """page_number and block, the lines of each page's layout, blank where there is nothing to say.

    Tables come first, then fields of routing, then the first of the others.
    """
    said = {**HEADINGS, **(headings or {})}
    fields = with_routing(layouts.select("page_number", F.posexplode("fields").alias("at", "f")).where(field_usable(F.col("f"))).select("page_number", "at", "f.label", "f.value"))
    line = F.concat(F.lit('  "'), _cell(F.col("label")), F.lit('": '), _cell(F.col("value")))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("routing"), F.struct("at", line.alias("l"))))), lambda x: x["l"]).alias("routed")
    plain = F.transform(F.array_sort(F.collect_list(F.when(~F.col("routing"), F.struct("at", line.alias("l"))))), lambda x: x["l"]).alias("plain")
    joined = layouts.join(fields.groupBy("page_number").agg(lines, plain), "page_number", "left")
    filled = F.filter("tables", table_filled)
    none = F.array().cast("array<string>")

    def part(heading: str, body: Column) -> Column:
        return F.when(F.size(body) > 0, F.concat(F.array(F.lit(""), F.lit(heading)), body)).otherwise(none)

    tables = F.flatten(F.transform(filled, lambda t, k: shown_table(t, k + 1)))
    block = F.concat(F.array(F.format_string(said["page"], "page_number")), part(said["tables"], tables), part(said["routing"], F.coalesce("routed", none)), part(said["fields"], F.slice(F.coalesce("plain", none), 1, FIELD_COUNT)))
    return joined.select("page_number", F.when(F.col("analyzed") & is_informative(F.col("tables"), F.col("fields")), F.array_join(block, "\n")).otherwise("").alias("block"))


def ink_ratio(histogram: Column) -> Column:
    """The share of dark pixels from a histogram of 256 greys; 0 for none."""
    total = F.aggregate(histogram, F.lit(0).cast("bigint"), lambda a, x: a + x)
    dark = F.aggregate(F.slice(histogram, 1, DARK), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.coalesce(F.when(total > 0, dark / total), F.lit(0.0))


def rescued_images(entries: DataFrame) -> DataFrame:
    """entries, of which those without evidence whose page is dark are images with one item of evidence.

    entries: kind, include, markdown, evidence (kind, text) and histogram of the page's greys.
    """
    image = (F.size("evidence") == 0) & (ink_ratio(F.col("histogram")) >= INK)
    caption = F.coalesce(F.nullif(first_image_caption(F.col("markdown")), F.lit("")), F.lit(NO_TEXT))
    item = F.array(F.struct(F.lit("imaging_finding").alias("kind"), caption.alias("text")))
    return entries.withColumns({"kind": F.when(image, "imaging").otherwise(F.col("kind")), "include": image | F.col("include"), "evidence": F.when(image, item).otherwise(F.col("evidence"))})
