"""Arrays, maps and JSON texts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank, clean_cell, filled


def table_rows(tables: Column) -> Column:
    """Rows of all tables of array<struct(table_index, rows array<array<string>>)>, in the order of their index."""
    return F.flatten(F.transform(F.array_sort(F.transform(tables, lambda t: F.struct(t["table_index"].alias("i"), t["rows"].alias("rows")))), lambda t: t["rows"]))


def row_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.filter(F.transform(r, clean_cell), lambda c: c != ""), " ")), "\n")


def document_text(title: Column, pages: Column, rows: Column) -> Column:
    """Title, page texts and row texts, those that have something, one a line."""
    parts = F.concat(F.array(blank(title)), F.transform(pages, blank), F.array(row_text(rows)))
    return F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), "\n")


def json_or_null(c: Column) -> Column:
    """The text if it is a JSON object or array, else null."""
    t = F.trim(blank(c))
    return F.when(t.rlike("^[\\[{]") & F.try_parse_json(t).isNotNull(), t)


@F.pandas_udf(T.StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The first balanced object of a text that parses; quotes and escapes are followed, so it is read in order."""

    def find(text):
        start = (text or "").find("{")
        while start >= 0:
            try:
                value, end = json.JSONDecoder().raw_decode(text[start:])
                if isinstance(value, dict):
                    return text[start : start + end]
            except ValueError:
                pass
            start = text.find("{", start + 1)
        return None

    return texts.map(find)


@F.pandas_udf(T.StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """JSON of a message body that may be JSON, a Python literal or lack quotes; null if none of them."""
    import ast
    import re

    def quoted(text):
        token = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[{}\[\],]|:(?=\s|["'{\[])|[^\s{}\[\],"'][^{}\[\],:]*(?::[^{}\[\],\s:][^{}\[\],]*)*|:)""")
        out = []
        for m in token.finditer(text):
            t = m[1].strip()
            if t in "{}[],:":
                out.append(t)
            elif t[0] in "\"'":
                out.append(json.dumps(t[1:-1]))
            elif re.fullmatch(r"-?\d+(\.\d+)?", t) or t.lower() in ("true", "false", "null"):
                out.append(t.lower())
            else:
                out.append(json.dumps(t))
        return "".join(out)

    def unquoted(text):
        # keys and values without quotes: a key ends at its first colon, a value at a comma or brace
        return quoted(re.sub(r"([{,]\s*)([A-Za-z_][\w-]*)\s*:", r'\1"\2":', text))

    def repair(text):
        text = (text or "").strip()
        for read in (json.loads, ast.literal_eval, lambda t: json.loads(unquoted(t))):
            try:
                value = read(text)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
            if isinstance(value, dict):
                return json.dumps(value, sort_keys=True, default=str)
        return None

    return texts.map(repair)


def argument_after(command: Column, flag: str) -> Column:
    """What follows a flag in an array of arguments; null if nothing does."""
    at = F.array_position(command, flag)
    return F.when(at > 0, F.get(command, at.cast("int")))


def run_id(source: Column, detail: Column) -> Column:
    """Run of an event: its input, the end of its execution's name, or its --run-id argument."""
    pick = lambda p: filled(F.get_json_object(detail, p))
    nested = filled(F.get_json_object(F.get_json_object(detail, "$.input"), "$.run_id"))
    arn = F.coalesce(pick("$.executionArn"), pick("$.execution_arn"))
    commands = lambda p: F.from_json(F.get_json_object(detail, p), "array<struct<command:array<string>>>")
    from_commands = lambda p: F.get(F.filter(F.transform(commands(p), lambda c: argument_after(c["command"], "--run-id")), lambda x: x.isNotNull()), 0)
    return F.when(source == "aws.states", F.coalesce(nested, filled(F.element_at(F.split(arn, ":"), -1)))).when(source == "aws.ecs", F.coalesce(from_commands("$.containers"), from_commands("$.overrides.containerOverrides")))


def without_blanks(record: Column) -> Column:
    return F.map_filter(record, lambda k, v: F.trim(blank(v)) != "")


def with_provenance(record: Column, event_type: Column, event_date: Column, action: Column) -> Column:
    """Record as JSON text, its blanks removed and where its inferred fields come from added."""
    made = F.to_json(F.struct(event_type.alias("event_type_source"), event_date.alias("event_date_source"), action.alias("action_source")))
    return F.to_json(F.map_concat(without_blanks(record), F.create_map(F.lit("_pipeline"), made)))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cols])


def flat_lines(pages: Column) -> Column:
    """Lines of nested pages(blocks(lines(spans(text, size, flags)))): text, largest size, any flag."""
    line = lambda ln: F.struct(F.array_join(F.transform(ln["spans"], lambda s: s["text"]), "").alias("text"), F.array_max(F.transform(ln["spans"], lambda s: s["size"])).alias("size"), F.aggregate(ln["spans"], F.lit(0), lambda a, s: a.bitwiseOR(s["flags"])).alias("flags"))
    return F.flatten(F.transform(pages, lambda p: F.flatten(F.transform(p["blocks"], lambda b: F.transform(b["lines"], line)))))
