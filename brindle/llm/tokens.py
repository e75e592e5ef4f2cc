"""Token counts and ids by the whole-token shortcut.

A vocabulary string is *whole* if the merges, run on it alone, give one token; that is proved for every string when
a vocabulary is loaded. Texts are cut into pre-tokens by the vocabulary's own pattern; a pre-token that is a whole
string costs one lookup, and only the others are merged, once each while they stay in a bounded memo.

Texts of characters below U+0180 are cut by the pattern with its classes spelt out, which is proved equal there. Other
texts are taken in runs that end before a space that follows something else, where no pre-token can go on; runs with
characters beyond are normalised and cut by the library's own pre-tokenizer, and only their pre-tokens are looked up and
merged here. A text that holds a special string is given to the library whole.

Defined results: a null text counts as empty (0 tokens, 0 bytes); empty texts have 0 tokens; very long texts are counted
whole, run by run; repeated rows give repeated results; an empty table gives an empty table; columns other than the id
and the text are never read.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pattern of byte-level pre-tokenizers that have use_regex set (fixed value of the public library).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: From U+0180 on the library cuts; below, character classes and lower case are proved equal.
BEYOND = re.compile("[^\x00-ſ]")
#: Where a run may end, and its least length.
CUT, RUN = re.compile(r"(?<=\S)(?=[ \n\t])"), 256
#: Pre-tokens that are merged rather than looked up stay in the memo up to this many; then it starts anew.
MEMO = 200_000
#: Texts longer than this are scanned pre-token by pre-token, not as one list.
LONG = 2_000_000


def byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def ranges(kind: str) -> str:
    """Characters below U+0250 of a general category, or White_Space for ``s``, as the inside of a character class."""
    has = [c for c in range(0x250) if (c in (*range(9, 14), 0x20, 0x85, 0xA0) if kind == "s" else unicodedata.category(chr(c))[0] == kind)]
    runs: list[list[int]] = []
    for c in has:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def below(pattern: str) -> re.Pattern:
    """The pattern with its character properties spelt out for texts in the proved range."""
    out, inside = "", False
    for part in re.split(r"(\\p\{[LN]\}|\\[sS]|[\[\]])", pattern):
        if part in "[]" and part:
            inside = part == "["
        if part.startswith("\\"):
            body = ranges(part[3] if part[1] == "p" else "s")
            if inside and part == "\\S":
                raise ValueError("a negated class inside a class is not supported")
            part = body if inside else f"[^{body}]" if part == "\\S" else f"[{body}]"
        out += part
    return re.compile(out)


class Memo(dict):
    """Value of a pre-token: whole strings for good, others worked out once and kept while there is room."""

    def __init__(self, whole: dict, work) -> None:
        super().__init__(whole)
        self.whole, self.work, self.most = whole, work, len(whole) + MEMO

    def __missing__(self, piece: str):
        if len(self) >= self.most:
            self.clear()
            self.update(self.whole)
        value = self[piece] = self.work(piece)
        return value


class Vocabulary:
    """A byte-level BPE vocabulary of the ``tokenizers`` library, with the proof of its whole strings."""

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(source)
        before = spec["pre_tokenizer"]
        parts = before["pretokenizers"] if before["type"] == "Sequence" else [before]
        normal = spec["normalizer"] or {"normalizers": []}
        self.lower = any(n["type"] == "Lowercase" for n in normal["normalizers"])
        kinds = {n["type"] for n in normal["normalizers"]} - {"NFC", "Replace", "Lowercase"}
        if kinds or parts[-1]["type"] != "ByteLevel" or parts[-1].get("add_prefix_space"):
            raise ValueError("only byte-level BPE vocabularies are supported")
        self.pattern = below(BYTE_LEVEL if parts[-1]["use_regex"] else parts[0]["pattern"]["Regex"])
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.letters = byte_letters()
        bytes_of = {c: b for b, c in enumerate(self.letters)}
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self.whole: dict[str, int] = {}
        self.whole_letters: dict[str, int] = {}
        for token, at in spec["model"]["vocab"].items():
            body = token[: len(token) - len(suffix)] if suffix and token.endswith(suffix) else token if not suffix else ""
            if not body or [t.id for t in self.library.model.tokenize(body)] != [at]:
                continue
            self.whole_letters[body] = at
            try:
                self.whole[bytes(bytes_of[c] for c in body).decode()] = at
            except (KeyError, UnicodeDecodeError):
                continue

    # value of a pre-token, as text and in the letters of bytes: how many tokens, and their ids

    @functools.cached_property
    def counts(self) -> tuple[Memo, Memo]:
        return Memo(dict.fromkeys(self.whole, 1), lambda p: len(self.merged(self.lettered(p)))), Memo(dict.fromkeys(self.whole_letters, 1), lambda p: len(self.merged(p)))

    @functools.cached_property
    def packed(self) -> tuple[Memo, Memo]:
        four = lambda ids: b"".join([t.to_bytes(4, "little") for t in ids])
        of = lambda whole: {k: v.to_bytes(4, "little") for k, v in whole.items()}
        return Memo(of(self.whole), lambda p: four(self.merged(self.lettered(p)))), Memo(of(self.whole_letters), lambda p: four(self.merged(p)))

    def lettered(self, piece: str) -> str:
        return "".join([self.letters[b] for b in piece.encode()])

    def merged(self, letters: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(letters)]

    def pieces(self, text: str) -> Iterable[str]:
        """Pre-tokens of a text in the proved range."""
        text = text.lower() if self.lower else text
        return self.pattern.findall(text) if len(text) <= LONG else (m[0] for m in self.pattern.finditer(text))

    def library_pieces(self, run: str) -> list[str]:
        """Pre-tokens of a run as the library cuts it, in the letters of bytes."""
        normal = self.library.normalizer
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal.normalize_str(run) if normal else run)]

    def values(self, text: str, memos: tuple[Memo, Memo]) -> Iterator:
        plain, letters = memos
        if BEYOND.search(text) is None:
            return map(plain.__getitem__, self.pieces(text))
        return itertools.chain.from_iterable(
            map(plain.__getitem__, self.pieces(run)) if BEYOND.search(run) is None else map(letters.__getitem__, self.library_pieces(run)) for run in runs(text)
        )

    def is_special(self, text: str) -> bool:
        """Whether the library must take the whole text."""
        return self.specials.search(text) is not None

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return len(self.library.encode(text, add_special_tokens=False).ids) if self.is_special(text) else sum(self.values(text, self.counts))

    def ids(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.is_special(text):
            return b"".join([t.to_bytes(4, "little") for t in self.library.encode(text, add_special_tokens=False).ids])
        return b"".join(self.values(text, self.packed))


def runs(text: str) -> Iterator[str]:
    """A text in runs that no pre-token spans."""
    at = 0
    while at < len(text):
        m = CUT.search(text, at + RUN)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


_LOADED: dict[int, Vocabulary] = {}


def loaded(source: str) -> Vocabulary:
    """The vocabulary of this worker process, loaded once."""
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(source)
    return _LOADED[key]


def shipped(df: DataFrame, path: str):
    """The vocabulary file (a few MB, whatever the data) as a broadcast, so that executors need no local file."""
    source = Path(path).read_text(encoding="utf-8")
    if len(source) > 64_000_000:
        raise ValueError(f"{path}: vocabulary files of over 64 MB are not broadcast")
    return df.sparkSession.sparkContext.broadcast(source)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > limit). One pass, no shuffle."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from brindle.llm.common import arrow_rows

    source = shipped(docs, vocabulary)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        count = loaded(source.value).count
        for part in arrow_rows(batches):
            text = part.column(1)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array([count(t.as_py()) for t in text], pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    out = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
