"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors (at-signs, plus signs, digits, ``://`` and
identifier cues such as ``iban``); small local parsers expand each anchor to its left and
right and validate the result. Text without anchors costs one automaton pass.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``; the method adds ``url``, ``iban``
(check digits modulo 97) and ``account`` (6 to 20 digits right after an account cue).
Offsets are code points, ends exclusive; kinds in this order, then by start.

Defined results: NULL and empty texts have no span; every row gives one row, repeated rows
too; other columns are ignored whatever their names; an empty table gives no rows; a text of any length is read
whole, in linear time. Only one text is in memory beyond its Arrow batch.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from tapeline.llm.common import map_texts
from tapeline.llm.spans import Span, joined, sha256

# Kinds in their order, and the cues before identifiers.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")
CUES = ("iban", "IBAN", "Iban", "account", "Account", "ACCOUNT", "acct", "Acct", "konto", "Konto", "compte", "cuenta")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"://[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"'`]*)?")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_IBAN = re.compile(r"[ :#=.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: ?(?:number|no|nr|num)\.?)?[ :#=.]{1,4}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")


def _anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for kind, words in (("@", ["@"]), ("+", ["+"]), ("u", ["://"]), ("c", CUES), ("d", "0123456789")):
        for word in words:
            machine.add_word(word, kind)
    machine.make_automaton()
    return machine


_MACHINE = _anchors()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    turned = code[4:] + code[:4]
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def find(text: str | None) -> list[Span]:
    """All spans of a text, by kind and start."""
    if not text:
        return []
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    mail_end = dotted_end = grouped_end = url_end = 0
    for end, anchor in _MACHINE.iter(text):
        if anchor == "d":
            if end >= dotted_end:
                # A maximal chain of dotted numbers starts here; each four parts are a candidate.
                chain = _DOTTED.match(text, end)
                dotted_end = chain.end()
                parts, at = chain[0].split("."), end
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    size = len(".".join(four))
                    if all(int(p) <= 255 if len(p) < 10 else not p.lstrip("0")[3:] and int(p.lstrip("0") or 0) <= 255 for p in four):
                        found["ip"].append(("ip", at, at + size))
                    at += size + 1
            if end >= grouped_end:
                group = _GROUPED.match(text, end)
                grouped_end = group.end() if group else end + 1
                if group:
                    digits = group[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(("card", end, grouped_end))
        elif anchor == "@":
            start = end
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (domain := _DOMAIN.match(text, end + 1)):
                mail_end = domain.end()
                found["email"].append(("email", start, mail_end))
        elif anchor == "+":
            if (number := _DIALLED.match(text, end)) and 8 <= sum(map(str.isdigit, number[0])) <= 15:
                found["phone"].append(("phone", end, number.end()))
        elif anchor == "u" and end - 2 >= url_end:
            colon = start = end - 2
            while start and text[start - 1] in _SCHEME:
                start -= 1
            if start < colon and (rest := _URL.match(text, colon)):
                url_end = rest.end()  # a scheme inside is part of this address
                stop = colon + len(rest[0].rstrip(".,;:!?)]}"))
                if stop > colon + 3:
                    found["url"].append(("url", start, stop))
        elif anchor == "c":
            if m := _IBAN.match(text, end + 1):
                if iban_valid(m[1].replace(" ", "")):
                    found["iban"].append(("iban", m.start(1), m.end(1)))
            elif m := _ACCOUNT.match(text, end + 1):
                found["account"].append(("account", m.start(1), m.end(1)))
    return [span for kind in KINDS for span in found[kind]]


def _scan(texts: list[str | None]) -> dict:
    found = [find(t) for t in texts]
    out = {f"n_{kind}": [sum(s[0] == kind for s in spans) for spans in found] for kind in BASE}
    out["base_sha256"] = [sha256(joined(s for s in spans if s[0] in BASE)) for spans in found]
    out["spans"] = [joined(spans) for spans in found]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row; a narrow map without a shuffle."""
    return map_texts(docs, _scan, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
