"""Instruction, message and task templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.functions.text import separated, tag_text


@dataclass(frozen=True)
class Wording:
    """The fixed text of a template; ``style`` and ``content`` come before their values."""

    # The wording that trained models expect.
    style: str = "Font design requirements: "
    content: str = "Text content: "
    system: str = (
        "You are a specialized vector glyph designer creating SVG path elements.\n\nCRITICAL REQUIREMENTS:\n"
        "- Each glyph must be a complete, self-contained <path> element, in reading order of the given text.\n"
        "- Terminate each <path> element with a newline character\n- Output ONLY valid SVG <path> elements\n"
    )
    older_system: str = (
        "Design SVG code for the given text content, follow the given the font design requirements. "
        "Do not use <text> element in generated SVG, use <path> instead."
    )
    ocr_system: str = "You are an OCR engine. Read the image precisely."
    ocr_prompt: str = (
        "Recognize the text in the image. Output exactly the recognized text once. Preserve case and accents as seen. "
        "Do not guess missing characters. If nothing readable is present, output exactly: No text recognized."
    )
    image: str = "<image>"


WORDING = Wording()


def _known(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda v: v.isNotNull())


def style_tags(category: Column, classifications: Column, stroke: Column, style: Column, weight: Column, tags: Column, *, groups: bool = True, described: bool = True, compat: bool = False) -> Column:
    """All tags of a font, each once: style, weight, category, classifications, stroke and, with ``groups``, free tags.

    Missing style and weight give no tag; with ``compat`` they are written out as ``None style`` and ``None weight``.
    """
    empty = F.array().cast("array<string>")
    missing = (lambda c: F.coalesce(c.cast("string"), F.lit("None"))) if compat else (lambda c: c.cast("string"))
    named = _known(F.concat(missing(style), F.lit(" style")), F.concat(missing(weight), F.lit(" weight")))
    kinds = F.transform(F.concat(F.coalesce(category, empty), F.coalesce(classifications, empty), _known(stroke)), tag_text)
    parts = [named, kinds] if described else []
    return F.array_distinct(F.concat(*parts, F.coalesce(tags, empty))) if groups else F.array_distinct(F.concat(*parts, empty))


def shuffled(values: Column, seed: int, *row: Column) -> Column:
    """The array in an order given by seed, row and value: the same every time, another for each row."""
    keyed = F.transform(values, lambda v: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in row], v)).alias("h"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def instruction(tags: Column, content: Column, *, apart: bool = True, wording: Wording = WORDING) -> Column:
    """Style line (left out without tags), an empty line, content line; ``apart`` parts the characters of the content."""
    line = F.concat(F.lit(wording.content), separated(content) if apart else content, F.lit("\n"))
    styled = F.concat(F.lit(wording.style), F.array_join(tags, ", "), F.lit("\n\n"), line)
    return F.when(F.size(tags) > 0, styled).otherwise(line)


def titled(text: Column) -> Column:
    """Every run of letters with its first one in upper case, the others in lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}]+|[^\p{L}]+)")), F.initcap), "")


def prefixed_tags(category: Column, classifications: Column, stroke: Column, style: Column, weight: Column, groups: Column, *, compat: bool = False) -> Column:
    """The older tags: each named by its kind, ``_`` as a blank; paths of free tags as their parts. Missing style and weight give no tag, with
    ``compat`` they are written out as ``None``."""
    empty = F.array().cast("array<string>")
    missing = (lambda c: F.coalesce(c.cast("string"), F.lit("None"))) if compat else (lambda c: c.cast("string"))
    kind = lambda name, tag: F.concat(F.lit(f"{name} "), F.translate(tag, "_", " "))
    kinds = F.concat(F.transform(F.coalesce(category, empty), lambda t: kind("Category", t)), F.transform(F.coalesce(classifications, empty), lambda t: kind("Classification", t)))
    single = _known(kind("Stroke", stroke), F.concat(F.lit("Style "), missing(style)), F.concat(F.lit("Weight "), missing(weight)))
    free = F.transform(F.coalesce(groups, empty), lambda t: F.replace(F.regexp_replace(t, "^/+|/+$", ""), F.lit("/"), F.lit(" ")))
    return F.concat(F.array_distinct(kinds), single, free)


def titled_instruction(tags: Column, content: Column, wording: Wording = WORDING) -> Column:
    """The older instruction: all tags in title case on the style line (left out without tags), an empty line, the content as it is."""
    line = F.concat(F.lit(wording.content), content)
    return F.when(F.size(tags) > 0, F.concat(F.lit(wording.style), titled(F.array_join(tags, ", ")), F.lit("\n\n"), line)).otherwise(line)


def image_instruction(text: Column, images: Column, wording: Wording = WORDING) -> Column:
    """The instruction with a placeholder for each reference image behind it."""
    return F.concat(text, F.repeat(F.lit(wording.image), F.size(images)))


def sft_record(instruction_: Column, output: Column, metadata: list[Column], content: Column, wording: Wording = WORDING) -> Column:
    """``<instruction, system, output, metadata>``: metadata is a JSON object of the font's fields, of what was asked and answered
    (``sft_instruction``, ``sft_system``, ``sft_output``) and of the content as it was asked for. Null fields are left out."""
    system = F.lit(wording.system)
    named = F.to_json(F.struct(*metadata, instruction_.alias("sft_instruction"), system.alias("sft_system"), output.alias("sft_output"), content.alias("content_str")))
    return F.struct(instruction_.alias("instruction"), system.alias("system"), output.alias("output"), named.alias("metadata"))


def ocr_task(image: Column, metadata: Column, wording: Wording = WORDING) -> Column:
    """A task to read one image; the target is ``content_str`` of the metadata."""
    return F.struct(F.lit(wording.ocr_system).alias("system"), F.lit(wording.ocr_prompt).alias("instruction"), F.get_json_object(metadata, "$.content_str").alias("output"), F.array(image).alias("images"), metadata.alias("metadata"))


def data_url(image: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(image), r"[\r\n]", ""))


def messages(instruction_: Column, system: Column, given: Column | None = None) -> Column:
    """Array of ``<role, content>``: given messages as they are; else the system text, if it isn't empty, and the instruction.

    Raises where neither is there.
    """
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    head = F.when(F.coalesce(system, F.lit("")) != "", F.array(turn("system", system))).otherwise(F.array().cast("array<struct<role: string, content: string>>"))
    asked = F.when(instruction_.isNotNull(), F.concat(head, F.array(turn("user", instruction_))))
    made = asked if given is None else F.coalesce(given, asked)
    return F.coalesce(made, F.raise_error(F.lit("a sample needs messages or an instruction")).cast("array<struct<role: string, content: string>>"))
