"""Personal data: patterns propose, checksums confirm, context words adjust.

Base kinds are email, ip, card and phone: the leftmost, non-overlapping matches of a kind's pattern, those that fail
its test dropped without retries. The method adds kinds that need more than a pattern: ``iban`` (mod-97), ``ssn`` (number
rules, and a context word nearby) and ``secret`` (a long run of letters and digits of many kinds, and a context word
nearby: access tokens, keys, passwords). Every span carries a score: the kind's prior, raised by a passed checksum
and by each context word within ``REACH`` code points before it. Added kinds stay where their score reaches
``LEAST``; base spans always stay.

Offsets are code points, ends exclusive. Patterns run in time linear in the text: emails are found from their at
signs, digit runs are entered at their start only, which gives the same matches.

Defined results: a null text counts as empty and has no spans; whole texts are scanned, whatever their length; spans
of different kinds may overlap; repeated rows get repeated results; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import arrow_rows

BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "ssn", "secret")
#: The prior score of a kind, what a passed checksum and a context word add, and the least score of an added span.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.5, "iban": 0.4, "ssn": 0.3, "secret": 0.3}
CHECKED, NEARBY, LEAST, REACH = 0.3, 0.25, 0.5, 48
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social"),
    "secret": ("token", "secret", "key", "api_key", "apikey", "access_key", "password", "passwd", "passwort", "bearer", "contraseña"),
}
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])")
#: A secret has so many different characters at least, letters and digits among them.
KINDS_OF = 10
DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d += d if i % 2 else 0
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str):
    """As the pattern with its local part in front finds them: the local part reaches back as far as its characters do,
    but not into the last match."""
    done = 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passed a checksum) in the order of the kinds, then of the text."""
    found = [("email", s, e, False) for s, e in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                found.append(("ip", *m.span(), False))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span(), True))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                found.append(("phone", *m.span(), False))
    return found


def mixed(run: str) -> bool:
    """Whether letters and digits change places in a run as they do by chance, rather than a word, a path or a number."""
    kinds = set(run)
    return len(kinds) >= KINDS_OF and any(c.isdigit() for c in kinds) and any(c.isalpha() for c in kinds) and len(re.findall(r"[0-9]+", run)) >= 3


def added_spans(text: str) -> list[tuple[str, int, int, bool]]:
    if not DIGITS.search(text):
        return []
    found = []
    for m in IBAN.finditer(text):
        body = m[0].replace(" ", "")
        # the words after a number can look like its groups: the longest start that passes, at a group's end
        for end in [i for i in range(len(m[0]), 14, -1) if i == len(m[0]) or m[0][i] == " "]:
            body = m[0][:end].replace(" ", "")
            if 15 <= len(body) <= 34 and mod97(body):
                found.append(("iban", m.start(), m.start() + end, True))
                break
    found += [("ssn", *m.span(), False) for m in SSN.finditer(text)]
    return found + [("secret", *m.span(), False) for m in SECRET.finditer(text) if mixed(m[0])]


def scored(text: str, kind: str, start: int, checked: bool) -> float:
    before = text[max(0, start - REACH) : start].lower()
    return min(1.0, PRIOR[kind] + CHECKED * checked + NEARBY * sum(bool(re.search(rf"(?<!\w){re.escape(w)}", before)) for w in CONTEXT[kind]))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed, then start."""
    if not text:
        return []
    base = [(k, s, e, scored(text, k, s, c)) for k, s, e, c in base_spans(text)]
    return base + [x for k, s, e, c in added_spans(text) if (x := (k, s, e, scored(text, k, s, c)))[3] >= LEAST]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``found``, an array of spans (kind, start, end, score)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([docs.schema[id_col], T.StructField("found", T.ArrayType(SPAN))])
    kind = to_arrow_type(schema["found"].dataType)
    names = [f.name for f in SPAN]

    def run(batches):
        for part in arrow_rows(batches):
            rows = [[dict(zip(names, x, strict=True)) for x in spans(t.as_py())] for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text with every span replaced by its kind in angle brackets; where spans overlap, the first start wins."""

    def mask(text: str | None) -> str | None:
        out, done = [], 0
        for kind, start, end, _ in sorted(spans(text), key=lambda x: (x[1], -x[2])):
            if start >= done:
                out += [text[done:start], f"<{kind}>"]
                done = end
        return text if text is None else "".join(out) + text[done:]

    import pyarrow as pa

    schema = T.StructType([docs.schema[id_col], T.StructField(text_col, T.StringType())])

    def run(batches):
        for part in arrow_rows(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([mask(t.as_py()) for t in part.column(1)], pa.string())], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the checksum of their spans, and all spans as text and counted."""
    told = lambda kinds: F.array_join(F.transform(F.filter("found", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in BASE]
    return found.select(id_col, *counts, F.sha2(told(BASE).cast("binary"), 256).alias("base_sha256"), told(BASE + ADDED).alias("spans"), F.size("found").cast("long").alias("n_spans"))
