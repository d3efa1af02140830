"""Schemas from templates: Spark types, strict validation, dotted names, instructions and prompts."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark types of template types; dates and links stay strings, whatever is unknown too.
TYPES = {
    "string": T.StringType(), "integer": T.LongType(), "decimal": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.StringType(), "datetime": T.StringType(), "time": T.StringType(), "link": T.StringType(),
}


def field_of(child: dict) -> T.StructField:
    """Always nullable; elements nest, multivalued ones are arrays."""
    kind = element_of(child) if child.get("type") == "element" else TYPES.get(child.get("type", "string"), T.StringType())
    return T.StructField(child["name"], T.ArrayType(kind) if child.get("multivalued") else kind, True)


def element_of(element: dict) -> T.StructType:
    return T.StructType([field_of(c) for c in element.get("children") or []])


def schema_of(template: dict) -> T.StructType:
    return element_of(template)


def sanitised(name: str) -> str:
    plain = re.sub(r"[^a-zA-Z0-9_]", "_", name)
    return "unnamed" if not plain else f"f_{plain}" if plain[0].isdigit() else plain


def flattened(children: list[dict], before: str = "") -> list[tuple[str, dict]]:
    """(dotted name, child) of all leaves in order; an element without a list of children is a leaf."""
    out = []
    for child in children:
        name = before + child.get("name", "")
        out += flattened(child["children"], f"{name}.") if child.get("type") == "element" and "children" in child else [(name, child)]
    return out


def field_names(template: dict) -> list[str]:
    return [name for name, _ in flattened(template["children"])]


def instructions(template: dict) -> list[str]:
    """A line for each branch that a leaf's values are bound to."""
    bound = [(name, p.get("ontology_acronym", "")) for name, child in flattened(template["children"]) for p in child.get("permissible_values") or [] if p.get("type") == "branch"]
    return [f"- {name}: value should be one of the {acronym} ontology concepts" for name, acronym in bound]


def problems(raw: Column, template: dict) -> Column:
    """What keeps a JSON record from being strict: array of missing and unknown keys; null for what isn't an object.

    Every field must be there, null or not; others are forbidden. Keys of nested elements are looked at too.
    """

    def of(value: Column, element: dict, path: str) -> Column:
        names = [c["name"] for c in element.get("children") or []]
        keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
        want = F.array(*[F.lit(n) for n in names]).cast("array<string>")
        label = lambda word: lambda k: F.concat(F.lit(f"{word} {path}"), k)
        out = F.concat(F.transform(F.array_except(want, keys), label("missing")), F.transform(F.array_except(keys, want), label("unknown")))
        for child in element.get("children") or []:
            if child.get("type") == "element" and not child.get("multivalued"):
                inner = F.get_json_object(value, "$." + child["name"])
                out = F.concat(out, F.when(inner.isNull(), F.array().cast("array<string>")).otherwise(of(inner, child, f"{path}{child['name']}.")))
        return out

    return F.when(F.json_object_keys(raw).isNotNull(), of(raw, template, ""))


def validated(records: DataFrame, template: dict, column: str = "value") -> DataFrame:
    """Adds `parsed`, null where the record isn't strict or its types don't fit, and `problems`."""
    found = records.withColumn("problems", problems(F.col(column), template))
    parsed = F.from_json(column, schema_of(template), {"mode": "PERMISSIVE"})
    return found.withColumn("parsed", F.when(F.size("problems") == 0, parsed))


#: Fixed text of the two prompts; kind names the system that templates come from.
MIGRATE = "Migrate the following legacy metadata record to the {kind} template.\n\n{kind} Template IRI: {iri}\n\nLegacy metadata:\n```json\n{record}\n```"
CORRECT = (
    "Given the following legacy metadata: {record}.\nReport a new and corrected metadata sample where the following template is as complete as possible:\n{fields}.\n"
    "Check if the field values and field names make sense. If no match is found for a field name, match it to an ontology. "
    "As far as possible, make field values adhere to ontology restrictions.\n{lines}- Missing values: use null\n\n"
    "Do not provide any explanation. Output only the corrected record in Python dict format"
)


def agent_prompt(record: dict, iri: str, kind: str) -> str:
    """kind: the name of the system that the template comes from."""
    return MIGRATE.format(kind=kind, iri=iri, record=json.dumps(record, indent=2))


def baseline_prompt(record: dict, template: dict) -> str:
    lines = "".join(f"{x}\n" for x in instructions(template))
    return CORRECT.format(record=json.dumps(record, indent=2), fields=", ".join(field_names(template)), lines=lines)
