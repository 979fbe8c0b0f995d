"""Task prompts over a label space, answer-format instructions, and prompt specifications of recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from plumbline.taxonomy import RESOURCES, Taxonomy

# The instructions that follow a prompt in each response format, and the text of a task prompt with its layout.
SUFFIXES = {
    "think_answer": " Output the thinking process in <think> </think> and final answer in <answer> </answer> tags.",
    "triple_newline": " You first think about the reasoning process as an internal monologue and then provide the user with the answer. Respond in the following format: ...\\n\\n\\n...",
    "plain": "",
}
INTRO = "You are a video classification model. Your task is to analyze the video and decide which of the following categories it contains."
ONLY_TRUE = "**Set the value to true ONLY for the categories present in the video. If none of them is present, set all values to false.**"
TASK_PROMPT = """\
{intro}

**Analyze the video for the presence of the following {subject}:**

<BEGIN {title}>
{listing}
<END {title}>

**Refer to the detailed explanations of each category below:**

<BEGIN {title} EXPLANATIONS>
{boxes}
<END {title} EXPLANATIONS>

**Provide the result in the following JSON format:**

{block} = {{
{keys}
}}

{rule}

**The result must be the JSON format of "{block}", beginning with "{block}:"**"""
#: The lists of a task prompt: how each shows a category, and what stands between two of them.
LISTS = {"listing": ("{id}: {name};", " "), "boxes": ("<box>\n{id}: {name}:\n{text}\n</box>", "\n"), "keys": ('"{key}": boolean', ",\n")}


class PromptError(ValueError):
    """A prompt specification that names nothing, or text that isn't the pinned one."""


def render_task_prompt(taxonomy: Taxonomy, intro: str | None = None, subject: str = "categories", positive_rule: str | None = None) -> str:
    """A prompt that lists and explains the categories and asks for one JSON boolean each."""
    shown = [{"id": c.id, "name": c.name, "text": (c.description or c.name).strip(), "key": taxonomy.output_key(c)} for c in taxonomy.categories]
    lists = {part: between.join(layout.format_map(c) for c in shown) for part, (layout, between) in LISTS.items()}
    told = {"intro": (intro or taxonomy.description or INTRO).strip(), "rule": positive_rule or ONLY_TRUE}
    return TASK_PROMPT.format(subject=subject, title=subject.upper(), block=taxonomy.block_name, **told, **lists)


def apply_format_template(content: str, response_format: str) -> str:
    """The prompt with the instruction of its response format."""
    if response_format not in SUFFIXES:
        raise PromptError(f"no instruction for response format {response_format!r}")
    return content if response_format == "plain" else content.strip() + SUFFIXES[response_format]


def resolve_prompt(spec: Mapping[str, Any], taxonomy: Taxonomy, base: Path) -> tuple[str, dict[str, Any]]:
    """Text and provenance of a prompt that is rendered, read from a file, or given; its hash may be pinned."""
    if spec.get("render"):
        text, source = render_task_prompt(taxonomy, spec.get("intro"), spec.get("subject", "categories")), {"render": True, "intro": spec.get("intro")}
    elif "path" in spec or "file" in spec:
        path = base / spec.get("path", spec.get("file"))  # an absolute path stays one
        text = path.read_bytes().decode("utf-8")
        text, source = text.strip() if spec.get("strip") else text, {"path": str(path), "strip": bool(spec.get("strip"))}
    elif "text" in spec:
        text, source = spec["text"], {"text": True}
    else:
        raise PromptError("a prompt needs one of render, path, file or text")
    digest = hashlib.sha256(text.encode()).hexdigest()
    if spec.get("sha256", digest) != digest:
        raise PromptError(f"the prompt's SHA-256 is {digest}, not {spec['sha256']}")
    return text, source | {"sha256": digest}


def read_resource(name: str, root: Path = RESOURCES / "prompts") -> str:
    """A bundled text, byte by byte as it is; ``name`` is its path below the bundled ones."""
    path = (root / name).resolve()
    if not path.is_relative_to(root.resolve()) or not path.is_file():
        raise PromptError(f"no bundled prompt {name!r}")
    return path.read_bytes().decode("utf-8")


def format_template_path(response_format: str) -> Path:
    """File of the template that puts a response format's instruction after a prompt, as trainers read it."""
    path = RESOURCES / "prompts" / "formats" / f"{response_format}.jinja"
    if not path.is_file():
        raise PromptError(f"no template for response format {response_format!r}")
    return path
