"""Column expressions over text: tags, templates, cleaning, names, hashes. All run inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The payload tags, the answer tags, the markers of list items and the emphasis that are stripped from the
# start of lines, and what counts as white space at the ends of a text.
OPEN, CLOSE = "<explanation>", "</explanation>"
ANSWER = r"<analysis>\s*(.*?)\s*</analysis>"
LIST_PREFIX = r"^\s*(?:[-*•+–—]|\d+[.)]|\(\d+\)|[a-zA-Z][.)]|\([a-zA-Z]\)|[ivxIVX]+[.)])\s+"
EMPHASIS = r"^\*\*([^\n]+?)\*\*"
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(text: Column) -> Column:
    """White space off both ends, Unicode's too (where ``trim`` takes spaces only)."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def wrapped(text: Column) -> Column:
    return F.concat(F.lit(f"{OPEN}\n"), text, F.lit(f"\n{CLOSE}"))


def payload(text: Column) -> Column:
    """The first tagged payload, stripped; null without one; an empty payload is ''."""
    pattern = f"(?s){re.escape(OPEN)}(.*?){re.escape(CLOSE)}"
    return F.when(text.rlike(pattern), stripped(F.regexp_extract(text, pattern, 1)))


def payload_or_text(text: Column) -> Column:
    """The payload, or the whole text on a miss."""
    return F.coalesce(payload(text), text)


def body(text: Column) -> Column:
    """Between the first opening and the first closing tag anywhere; the whole text, stripped, on a miss."""
    start, end = F.locate(OPEN, text), F.locate(CLOSE, text)
    inside = F.substring(text, start + len(OPEN), F.greatest(end - start - len(OPEN), F.lit(0)))
    return stripped(F.when((start > 0) & (end > 0), inside).otherwise(text))


def cleaned(raw: Column, pattern: str = ANSWER) -> Column:
    """The answer's lines without list markers, each line's leading emphasis unwrapped and emphasis marks off both ends,
    blank lines dropped, as paragraphs; null without answer. Emphasis within a line stays."""
    whole = f"(?s){pattern}"

    def line(x: Column) -> Column:
        bare = F.regexp_replace(x, LIST_PREFIX.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}"), "")
        return F.regexp_replace(stripped(F.regexp_replace(bare, f"{EMPHASIS}{SPACE}*", "$1 ")), r"^[*_]+|[*_]+$", "")

    lines = F.split(F.regexp_extract(raw, whole, 1), "\n")
    return F.when(raw.rlike(whole), F.array_join(F.filter(F.transform(lines, line), lambda x: x != ""), "\n\n"))


def paragraphs(text: Column) -> Column:
    return F.size(F.split(text, "\n\n")).cast("long")


def worth_keeping(text: Column, least: int = 2) -> Column:
    """Whether a cleaned answer is there and has enough paragraphs."""
    return F.coalesce(paragraphs(text) >= least, F.lit(False))


class Template:
    """A template with one placeholder, split where the value goes; braces in values are inert."""

    def __init__(self, template: str, name: str) -> None:
        parts = template.split("{" + name + "}")
        if len(parts) != 2:
            raise ValueError(f"the template must hold {{{name}}} exactly once")
        self.prefix, self.suffix = (p.replace("{{", "{").replace("}}", "}") for p in parts)

    def fill(self, value: Column) -> Column:
        return F.concat(F.lit(self.prefix), value, F.lit(self.suffix))

    def unfill(self, text: Column) -> Column:
        """The value that was filled in; an error where the text isn't of the template."""
        fits = text.startswith(self.prefix) & text.endswith(self.suffix) & (F.length(text) >= len(self.prefix) + len(self.suffix))
        middle = F.substring(text, F.lit(len(self.prefix) + 1), F.length(text) - len(self.prefix) - len(self.suffix))
        return F.when(fits, middle).otherwise(F.raise_error(F.concat(F.lit("text does not fit the template: "), F.coalesce(F.substring(text, 1, 80), F.lit("null")))).cast("string"))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def count_in_messages(messages: Column, part: str) -> Column:
    return F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + occurrences(m["content"], part))


def replace_in_messages(messages: Column, part: str, by: str) -> Column:
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.replace(m["content"], F.lit(part), F.lit(by)).alias("content")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def document_id(corpus: str, split: str, index: Column) -> Column:
    return F.concat_ws(":", F.lit(corpus), F.lit(split), index.cast("string"))


def checkpoint_name(depth: Column) -> Column:
    return F.when(depth == 0, F.lit("embedding")).otherwise(F.format_string("block_%02d", depth.cast("int")))


def checkpoint_layer(depth: Column) -> Column:
    return F.when(depth > 0, depth - 1).cast("long")


def source_label(doc_id: Column, labels: list[tuple[str, str]]) -> Column:
    """The label of the first substring found, else ``other``."""
    out = F.lit("other")
    for part, label in reversed(labels):
        out = F.when(doc_id.contains(part), F.lit(label)).otherwise(out)
    return out


def without_base(dataset_id: Column) -> Column:
    return F.regexp_replace(dataset_id, "^base_", "")


def shortened(text: Column, most: int) -> Column:
    """The first ``most`` characters and how many more there are."""
    more = F.length(text) - most
    return F.when(more > 0, F.concat(F.substring(text, 1, most), F.lit(" … ["), more.cast("string"), F.lit(" more chars]"))).otherwise(text)


def wrapped_lines(text: Column, width: int) -> Column:
    """The text broken into lines of at most ``width`` characters, at white space where there is any; words longer than
    a line are cut. An array, empty for an empty text."""
    pieces = F.regexp_extract_all(F.concat(stripped(text), F.lit("\n")), F.lit(rf"(\S.{{0,{width - 1}}}(?=\s)|\S{{{width}}})"), F.lit(1))
    return F.transform(pieces, lambda x: F.rtrim(x))


def sliced_path(path: str) -> tuple[str, tuple[int, int | None] | None]:
    """``data.parquet@[3:9]`` as the path and its slice [3, 9); an open end is None; without a slice None."""
    m = re.fullmatch(r"(.*)@\[(\d*):(\d*)\]", path)
    return (path, None) if m is None else (m[1], (int(m[2] or 0), int(m[3]) if m[3] else None))
