"""Personal data by anchor expansion.

One Aho-Corasick pass over a text in lower case finds anchors: at-signs, plus signs, digits, URL schemes and words that
announce an identifier, so all of these count in any case. At each anchor a deterministic local parser expands to the left
or right over the text itself and validates: e-mail addresses, IPv4 addresses, payment cards (Luhn), phone numbers, and
beyond these the user part of a URL and secrets assigned to a name such as token or password (``credential``) and announced
account numbers (``account``: IBAN with its check digits, US social security numbers). No parser has a window.

A parser keeps the place where its last match ended, and tries each possible start in order, so its spans are
those of a leftmost non-overlapping search. A run of digits is tried once per kind, so long runs take
linear time.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; rows are
independent, so repeated rows give equal results and an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "credential", "account")
CUES = ("iban", "ssn", "account", "acct", "social security")
SECRETS = ("token", "secret", "password", "passwd", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "accesskey", "private_key")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_USER = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]++:[^\s/@]++(?=@)")
_NAME = re.compile("[A-Za-z0-9_]*+")
_SECRET = re.compile(r"""["']?\s*+[:=]\s*+["']?(?P<id>[A-Za-z0-9_\-.~+/=$%!*#&^]{8,})""")
_ACCOUNT = re.compile(r"[\s:#=]*+(?i:number|no\.?)?[\s:#=]*+(?P<id>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})")


@cache
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for c in CUES:
        found.add_word(c, ("cue", len(c)))
    for c in SECRETS:
        found.add_word(c, ("secret", len(c)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def lowered(text: str) -> str:
    """Lower case with a character for each character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    email = ip = card = phone = account = secret = name = 0
    for end, (anchor, length) in _anchors().iter(lowered(text)):
        at = end - length + 1
        if anchor == "digit":
            if at >= ip:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                        out["ip"].append(m.span())
                else:
                    ip = _DIGITS.match(text, at).end()
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                if card - at < 64 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif anchor == "at":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out["email"].append((start, email))
        elif anchor == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif anchor == "scheme":
            if text[max(0, at - 5) : end + 1].lower().endswith(SCHEMES) and (m := _USER.match(text, end + 1)):
                out["credential"].append(m.span())
        elif anchor == "secret":
            # a secret has a digit, and a letter or a sign, so that plain words and plain numbers stay
            if at < secret or at < name:
                continue
            name = _NAME.match(text, end + 1).end()
            if m := _SECRET.match(text, name):
                secret = m.end()
                if (s := m["id"]).isascii() and any(c.isdigit() for c in s) and not s.isdigit():
                    out["credential"].append(m.span("id"))
        elif at >= account and (m := _ACCOUNT.match(text, end + 1)):
            s = m["id"]
            while "-" not in s and not iban(s) and " " in s:  # capitals may follow the number
                s = s.rpartition(" ")[0]
            if "-" in s or iban(s):
                account = m.start("id") + len(s)
                out["account"].append((m.start("id"), account))
    out["credential"].sort()
    return out


def listed(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def masked(text: str | None) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the first is kept, and extended."""
    spans = sorted((a, b, k) for k, v in find(text).items() for a, b in v)
    if not spans:
        return text
    out, at = [], 0
    for i, (a, b, k) in enumerate(spans):
        if i and a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_<kind> for the base kinds, base_sha256, spans, n_spans) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t.as_py()) for t in b.column(1)]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE]
            sha = pa.array([hashlib.sha256(listed(f, BASE).encode()).hexdigest() for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array(map(listed, found), pa.string()), pa.array([sum(map(len, f.values())) for f in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in text masked, and n_chars, where there is one, counted anew."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(masked, na_action="ignore")

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
