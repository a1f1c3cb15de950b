"""Prompt nodes: flattening, expansion per document, slots and composition.

A prompt tree is configuration, a handful of nodes, so it enters plans as a
literal array that is exploded in each document's row. Nothing is joined.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierglass.functions.pages import detect_content_type
from tierglass.functions.text import is_blank, strip
from tierglass.lexicon import LABELS, NO_TEXT_PLACEHOLDER, PROMPT_TEXT_CHARS

ANY_TYPE = ("text", "image", "mixed")


class Node(NamedTuple):
    """One prompt; ``content_types`` tells which documents it applies to."""

    name: str
    prompt: str
    depth: int = 0
    node_ord: int = 0
    parent: str | None = None
    content_types: tuple[str, ...] = ANY_TYPE


NODE_SCHEMA = (
    "name string, prompt string, depth int, node_ord int, parent string, "
    "content_types array<string>"
)

# Own wording for the prompts; callers pass their own texts.
SINGLE_PROMPT = (
    Node(
        "single",
        "Classify the document by sensitivity and safety. Decide whether it holds personal, "
        "financial or corporate data and whether it holds malicious content, then answer in "
        'JSON with the keys "contains_sensitive_data", "contains_unsafe_content", "risk_level" '
        f"({', '.join(LABELS)}) and \"reasoning_summary\".",
    ),
)
INSTRUCTION = (
    "You review documents for sensitive, confidential and unsafe content. Choose the most "
    f"severe label that applies, one of: {', '.join(LABELS)}. Answer in JSON with the keys "
    "'label', 'confidence' (0 to 1) and 'reasoning', and name the evidence in the reasoning."
)
# Names and slots of the nodes that depend on the content type.
CONDITIONAL_NODES = (
    Node(
        "tc2_pii_review",
        "TC2: title {{ doc.title | default('Unknown document') }}, file "
        "{{ doc.filename | default('unavailable') }}. List all regulated and confidential data.",
        1, 0, "root", ("text", "mixed"),
    ),
    Node(
        "tc4_image_classification",
        "TC4: {{ doc.image_count | default(0) }} images on pages "
        "{{ doc.pages_with_images | default('unknown') }}. Describe what each image reveals.",
        1, 1, "root", ("image", "mixed"),
    ),
)


def flatten_tree(tree: Mapping, depth: int = 0, parent: str | None = None) -> list[Node]:
    """Nested ``name, prompt, children`` configuration as nodes in pre-order."""
    nodes = [Node(tree["name"], tree["prompt"], depth, 0, parent)]
    for child in tree.get("children", ()):
        nodes.extend(flatten_tree(child, depth + 1, tree["name"]))
    return [n._replace(node_ord=i) for i, n in enumerate(nodes)]


def add_nodes(nodes: Sequence[Node], extra: Sequence[Node]) -> list[Node]:
    """Nodes with further ones appended at the end."""
    return [n._replace(node_ord=i) for i, n in enumerate([*nodes, *extra])]


def prompt_nodes(spark: SparkSession, nodes: Sequence[Node]) -> DataFrame:
    """The nodes as a small table."""
    return spark.createDataFrame([tuple(n[:5]) + (list(n[5]),) for n in nodes], NODE_SCHEMA)


def node_array(nodes: Sequence[Node], slots: Mapping[str, Column] | None = None) -> Column:
    """The nodes as an array of structs; with ``slots`` their prompts are rendered."""
    return F.array(
        *[
            F.struct(
                F.lit(n.name).alias("name"),
                (F.lit(n.prompt) if slots is None else render(n.prompt, slots)).alias("prompt"),
                F.lit(n.depth).alias("depth"),
                F.lit(n.node_ord).alias("node_ord"),
                F.lit(n.parent).cast("string").alias("parent"),
                F.array(*[F.lit(t) for t in n.content_types]).alias("content_types"),
            )
            for n in nodes
        ]
    )


def expand_prompts(
    docs: DataFrame, nodes: Sequence[Node], slots: Mapping[str, Column] | None = None
) -> DataFrame:
    """Every document with every node. Pass documents without their text."""
    expanded = docs.withColumn("_n", F.explode(node_array(nodes, slots)))
    return expanded.select(*docs.columns, "_n.*").drop("content_types")


def conditional_nodes(
    docs: DataFrame,
    nodes: Sequence[Node] = CONDITIONAL_NODES,
    content_type: str = "content_type",
    slots: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Every document with the nodes meant for its content type."""
    wanted = F.filter(
        node_array(nodes, slots), lambda n: F.array_contains(n["content_types"], F.col(content_type))
    )
    return (
        docs.withColumn("_n", F.explode(wanted)).select(*docs.columns, "_n.*").drop("content_types")
    )


_SLOT = re.compile(r"\{\{\s*([\w.]+)\s*(?:\|\s*default\(\s*('[^']*'|[\d.]+)\s*\)\s*)?\}\}")


def render(template: str, slots: Mapping[str, Column]) -> Column:
    """Fill ``{{ slot }}`` and ``{{ slot | default(..) }}`` from columns.

    A ``doc.`` prefix is optional. A slot without value and without default
    fails the job, as does a slot that no column is given for.
    """
    pieces: list[Column] = []
    position = 0
    for match in _SLOT.finditer(template):
        pieces.append(F.lit(template[position : match.start()]))
        name, default = match.group(1).removeprefix("doc."), match.group(2)
        value = slots[name].cast("string") if name in slots else F.lit(None).cast("string")
        if default is None:
            other = F.raise_error(F.lit(f"'{name}' is undefined")).cast("string")
        else:
            other = F.lit(default.strip("'"))
        pieces.append(F.coalesce(value, other))
        position = match.end()
    rest = template[position:]
    if "{{" in rest:
        raise ValueError(f"unreadable slot in prompt: {rest}")
    return F.concat(*pieces, F.lit(rest))


def metadata_slots() -> dict[str, Column]:
    """Slots from document metadata columns."""
    pages = F.concat(F.lit("["), F.array_join("pages_with_images", ", "), F.lit("]"))
    return {
        "title": F.col("title"),
        "filename": F.col("filename"),
        "image_count": F.col("image_count"),
        "pages_with_images": pages,
    }


def prompt_text(
    docs: DataFrame,
    nodes: Sequence[Node],
    conditional: Sequence[Node] = CONDITIONAL_NODES,
    slots: Mapping[str, Column] | None = None,
    content_type: str = "content_type",
) -> DataFrame:
    """Add ``prompt_text``: the tree of a document as indented lines.

    Conditional nodes are children of the root and follow the tree. Lines are
    concatenated in the row, without a shuffle.
    """
    slots = slots or {}

    def line(node: Node) -> Column:
        head = "  " * node.depth + f"- ({node.name}) "
        return F.concat(F.lit(head), render(node.prompt, slots))

    lines = [line(n) for n in nodes]
    for node in conditional:
        applies = F.col(content_type).isin(*node.content_types)
        lines.append(F.when(applies, line(node)))
    return docs.withColumn("prompt_text", F.concat_ws("\n", *lines))


def with_content_type(docs: DataFrame) -> DataFrame:
    """Replace ``content_type`` by the type prompts are chosen for."""
    detected = detect_content_type(
        F.col("content_type"),
        [F.col("has_text"), F.col("text_length"), F.col("word_count"), F.col("character_count")],
        [F.col("has_images"), F.col("image_count"), F.size("pages_with_images") > 0],
    )
    return docs.withColumn("content_type", detected)


def prompt_opening(text: Column, max_chars: int | None = PROMPT_TEXT_CHARS) -> Column:
    """The part of a text that a prompt carries; all of it where ``max_chars`` is None."""
    whole = strip(F.coalesce(text, F.lit("")))
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def compose_prompt(
    prompt: Column,
    text: Column,
    metadata_json: Column,
    image_summary: Column,
    instruction: str = INSTRUCTION,
    max_chars: int | None = PROMPT_TEXT_CHARS,
) -> Column:
    """Full prompt: sections in order, the metadata section only where there is any."""
    body = prompt_opening(text, max_chars)
    shown = F.when(is_blank(text), F.lit(NO_TEXT_PLACEHOLDER)).otherwise(body)
    return F.concat_ws(
        "\n\n",
        F.lit(instruction),
        strip(F.concat(F.lit("Task Prompt:\n"), strip(prompt))),
        F.concat(F.lit("Metadata:\n"), metadata_json),
        F.concat(F.lit("Image Summary:\n"), image_summary),
        F.concat(F.lit("Document Text:\n"), shown),
    )
