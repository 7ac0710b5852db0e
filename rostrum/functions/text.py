"""Text expressions: whitespace, slide markers, tokens, rerank and context blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum.functions.vectors import let

# The marker that starts a line of slide text, and the stand-in for no text.
SLIDE_TOKEN = "[SLIDE]"
BLANK = "<blank>"

# Letters, digits and underscore in any script; the same text splits alike in Java and RE2.
WORD_PATTERN = r"[\p{L}\p{N}_]+"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

# Every character that separates words, and every line end.
SPACE_CLASS = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = f"[{SPACE_CLASS}]+"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B))


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered_text(value: str, sep: str, *order: str) -> Column:
    """Aggregate: the values joined by ``sep`` in the given order."""
    by = ", ".join(f"`{o}`" for o in order)
    sep = sep.replace("\n", "\\n")
    return F.expr(f"listagg(`{value}`, '{sep}') within group (order by {by})")


def clean_text(x: str | Column) -> Column:
    """Runs of whitespace to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_col(x), F.lit("")), SPACES, " "))


def strip(x: str | Column) -> Column:
    """Cut whitespace of any kind from both ends."""
    return F.trim(_col(x), F.lit(SPACE_CHARS))


def lines_of(x: str | Column) -> Column:
    """Non-blank lines, each trimmed."""
    parts = F.split(F.coalesce(_col(x), F.lit("")), LINE_ENDS)
    return F.filter(F.transform(parts, strip), lambda line: line != "")


def format_slide_block(ocr: str | Column) -> Column:
    """Every non-blank line of slide text, whitespace-clean, with the slide marker in front."""
    marked = F.transform(lines_of(ocr), lambda line: F.concat(F.lit(SLIDE_TOKEN + " "), clean_text(line)))
    return F.array_join(marked, "\n")


def compose_chunk_text(spoken: str | Column, ocr: str | Column) -> Column:
    """Spoken text above the marked slide lines; the blank stand-in if both are empty."""
    parts = F.filter(F.array(clean_text(spoken), format_slide_block(ocr)), lambda p: p != "")
    return or_blank(F.array_join(parts, "\n"))


def compose_entry(spoken: str | Column, ocr: str | Column, *, include_ocr: bool = True) -> Column:
    """Entry text: the utterance, with its slide text on a marked line below."""
    said = strip(F.coalesce(_col(spoken), F.lit("")))
    seen = strip(F.coalesce(_col(ocr), F.lit("")))
    if not include_ocr:
        seen = F.lit("")
    marked = F.when(seen != "", F.concat(F.lit(SLIDE_TOKEN + " "), seen))
    return or_blank(F.concat_ws("\n", F.when(said != "", said), marked))


def _is_slide_line(line: Column) -> Column:
    return line.startswith(SLIDE_TOKEN)


def spoken_part(text: str | Column) -> Column:
    """The lines of a segment that are speech."""
    return F.array_join(F.filter(lines_of(text), lambda line: ~_is_slide_line(line)), "\n")


def slide_part(text: str | Column) -> Column:
    """The slide lines of a segment without their marker."""
    marked = F.filter(lines_of(text), _is_slide_line)
    bare = F.transform(
        marked, lambda line: F.regexp_replace(F.substring(line, F.lit(len(SLIDE_TOKEN) + 1), F.length(line)), r"^[ :\t]+", "")
    )
    return F.array_join(F.filter(bare, lambda line: line != ""), "\n")


def or_blank(x: Column) -> Column:
    return let(x, lambda v: F.coalesce(F.nullif(v, F.lit("")), F.lit(BLANK)))


def rerank_text(text: str | Column) -> Column:
    """Reranker input of a segment: its speech, then its slide lines, under fixed titles."""

    def block(seen: Column) -> Column:
        marked = F.array_join(F.transform(lines_of(seen), lambda line: F.concat(F.lit(SLIDE_TOKEN + " "), line)), "\n")
        return F.when(seen == "", F.lit("Slide OCR:\n" + BLANK)).otherwise(
            F.concat(F.lit(SLIDE_TOKEN + "\nSlide OCR:\n"), marked))

    return F.concat(F.lit("Segment:\n"), or_blank(spoken_part(text)), F.lit("\n\n"), let(slide_part(text), block))


def rerank_text_ocr(text: str | Column) -> Column:
    """Reranker input of a slide."""
    return F.concat(F.lit("Slide OCR:\n"), or_blank(strip(F.coalesce(_col(text), F.lit("")))))


def rerank_text_node(is_leaf: Column, text: Column, summary: Column, leaves: Column) -> Column:
    """Reranker input of a tree node: leaves as segments, inner nodes with their evidence."""
    body = or_blank(strip(F.coalesce(F.when(summary != "", summary), text, F.lit(""))))
    label = lambda x: F.coalesce(
        F.concat(F.lit("Leaf "), x["segment_id"].cast("string")), F.when(x["tree_path"] != "", x["tree_path"]), F.lit("Leaf"))
    blocks = F.transform(leaves, lambda x: F.concat(label(x), F.lit("\n"), rerank_text(x["text"])))
    evidence = F.when(F.size(leaves) > 0, F.array_join(blocks, "\n\n")).otherwise(F.lit(BLANK))
    node = F.concat(F.lit("Summary Node:\n"), body, F.lit("\n\nSupporting Leaf Evidence:\n"), evidence)
    return F.when(F.coalesce(is_leaf, F.lit(True)), rerank_text(text)).otherwise(node)


def word_tokens(x: str | Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def text_tokens(x: str | Column) -> Column:
    """Words and single marks, case kept: the unit in which chunk sizes are counted."""
    return F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(x: str | Column) -> Column:
    return F.size(text_tokens(x)).cast("long")


def ocr_terms(x: str | Column, *, min_len: int = 2) -> Column:
    """Set of lower-case ASCII terms of slide text, short ones dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= min_len))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two term sets; two empty sets are equal, one empty set is unlike."""

    def score(x: Column, y: Column) -> Column:
        both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
        return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))

    return let(a, lambda x: let(b, lambda y: score(x, y)))


def slugify(x: str | Column) -> Column:
    """File-name form: other characters to underscores, none at the ends."""
    slug = F.regexp_replace(F.trim(_col(x)), r"[^A-Za-z0-9._-]+", "_")
    slug = F.regexp_replace(slug, r"^_+|_+$", "")
    return F.when(slug == "", F.lit("unknown")).otherwise(slug)


def shorten(x: str | Column, limit: int | None) -> Column:
    """Stripped text, or the blank stand-in; beyond ``limit`` characters cut with an ellipsis."""
    c = or_blank(strip(F.coalesce(_col(x), F.lit(""))))
    if not limit or limit <= 0:
        return c
    cut = F.concat(F.regexp_replace(F.substring(c, 1, max(limit - 3, 0)), f"{SPACES}$", ""), F.lit("..."))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def model_short_name(x: str | Column) -> Column:
    """The part of a model path after its owner."""
    c = _col(x)
    return F.when(c.contains("/"), F.split_part(c, F.lit("/"), F.lit(2))).otherwise(c)
