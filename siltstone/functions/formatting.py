"""Snippets, source labels, context listings and prompts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.schemas import LABEL_FLAGS, SNIPPET_CHARS

#: Blanks as Python's str.split() sees them.
BLANK_RUN = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def snippet(text: Column, width: int = SNIPPET_CHARS) -> Column:
    """Blanks collapsed; beyond ``width`` cut before a word, or after a hyphen inside one, so that the text and ' [...]' fit."""
    flat = F.trim(F.regexp_replace(text, BLANK_RUN, " "))
    room = width - len(" [...]")
    letter = r"[^\d\W]"
    hyphen = rf"(?<={letter}{{2}}-|{letter}-{letter}-)(?={letter}-?{letter})"
    head = F.regexp_extract(F.substring(flat, 1, room + 3), rf"(?U)^(.{{1,{room}}})(?:(?= )|{hyphen})", 1)
    return F.when(F.length(flat) <= width, flat).otherwise(F.ltrim(F.concat(head, F.lit(" [...]"))))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def _set(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def source_label(metadata: Column, number: Column) -> Column:
    """'Source 3: name (image) (flag/flag)'; a name of 'unknown' where no path is known."""
    image, source = metadata["image_path"], metadata["source"]
    name = F.when(_set(image) & F.coalesce(metadata["caption"], F.lit(False)), F.concat(basename(image), F.lit(" (image)"))).otherwise(
        basename(F.coalesce(source, image, F.lit("unknown")))
    )
    flags = F.concat_ws("/", *(F.when(metadata[f], F.lit(f)) for f in LABEL_FLAGS))
    tail = F.when(flags != "", F.concat(F.lit(" ("), flags, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("Source "), number.cast("string"), F.lit(": "), name, tail)


def listing_line(document: Column, metadata: Column, number: Column) -> Column:
    shown = F.when(_set(metadata["image_path"]), F.lit("<image>")).otherwise(snippet(F.coalesce(document, F.lit(""))))
    return F.concat(F.lit("  "), number.cast("string"), F.lit(". "), source_label(metadata, number), F.lit(" — "), shown)


def prompt_block(document: Column, metadata: Column, number: Column) -> Column:
    """The label over the content; an image stands as its path, whatever text was read from it."""
    image = metadata["image_path"]
    content = F.when(_set(image), F.concat(F.lit("<image at "), image, F.lit(">"))).otherwise(F.coalesce(document, F.lit("")))
    return F.concat(source_label(metadata, number), F.lit("\n"), content)


def in_order(rank: Column, text: Column, separator: str) -> Column:
    """The texts of a group joined by rank; groups are the few results of one question."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), text.alias("t")))), lambda x: x["t"]), separator)


def prompt(question: Column, blocks: Column) -> Column:
    # The wording of the prompt.
    return F.concat(
        F.lit("You are a helpful assistant. Use ONLY the sources below.\n\nUser question: "), question, F.lit("\n\n"), blocks,
        F.lit("\n\nCite facts like (Source 2)."),
    )


def file_kind(path: Column) -> Column:
    """image, pdf, text or null (dropped), by the suffix in any case."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    # Suffixes whose MIME type is an image.
    images = ("png", "jpg", "jpeg", "jpe", "gif", "bmp", "tif", "tiff", "webp", "svg", "ico", "heic", "heif", "avif", "ppm", "pgm", "pbm", "pnm", "xbm", "xpm", "xwd", "ras", "rgb", "ief")
    return F.when(suffix.isin(*images), "image").when(suffix == "pdf", "pdf").when(suffix.isin("txt", "md"), "text")
