"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes and identifier cues) in one pass over a text; at each
anchor a deterministic local parser expands to the left and right and validates what it has: e-mail
addresses, IPv4 addresses, payment cards (Luhn), telephone numbers, URLs, account numbers (IBANs by their check digits), and
secrets: values named as tokens, keys or passwords, keys with a known beginning, private-key blocks.

Matches of one kind do not overlap and are taken leftmost first; one that fails its check is dropped
without another try. Offsets count code points. Null texts count as empty and have no spans; repeated
rows and null doc_ids are kept; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe, tables

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
#: Words before an account number
CUES = ("account", "acct", "iban", "passport", "ssn", "user id", "userid", "customer id", "licence", "license no", "konto", "cuenta", "compte")

#: Words before the value of a secret, and how secrets without such a word begin
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key", "auth_key", "bearer")
SECRET_STARTS = ("-----BEGIN ", "AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "AIza", "eyJ")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
ACCOUNT = re.compile(r"(?: (?:no|number|nr))?\.?[ ]?[:#=]?[ ]?([A-Z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?|[A-Za-z]{0,3}[0-9][0-9-]{4,20}[0-9])(?![A-Za-z0-9])")


SECRET_VALUE = re.compile(r"""["']?[ \t]{0,3}(?:[:=]|=>|[ ])[ \t]{0,3}["']?([A-Za-z0-9_./+=-]{16,})""")
SECRET_FORM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?|A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pos]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[bp]-[0-9A-Za-z-]{20,}|sk_live_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban(code: str) -> bool:
    code = code.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


class Finder:
    def __init__(self):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        self.auto.add_word("@", "@")
        self.auto.add_word("+", "+")
        self.auto.add_word("://", "url")
        for d in "0123456789":
            self.auto.add_word(d, "0")
        for cue in CUES:
            for form in {cue, cue.capitalize(), cue.upper()}:
                self.auto.add_word(form, "account")
        for cue in SECRET_CUES:
            for form in {cue, cue.capitalize(), cue.upper()}:
                self.auto.add_word(form, "secret cue")
        for form in SECRET_STARTS:
            self.auto.add_word(form, f"secret {len(form)}")
        self.auto.make_automaton()

    def find(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Spans of each kind in order."""
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys(KINDS, 0)
        for at, cue in self.auto.iter(text):
            if cue == "0":
                if at >= done["card"]:
                    m = CARD.match(text, at)
                    done["card"] = m.end() if m else at + 1
                    if m and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                        out["card"].append(m.span())
                if at >= done["ip"]:
                    m = IP.match(text, at)
                    done["ip"] = m.end() if m else DIGITS.match(text, at).end()
                    if m and all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.groups())):
                        out["ip"].append(m.span())
            elif cue == "@":
                start, least = at, done["email"]
                while start > least and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    done["email"] = m.end()
                    out["email"].append((start, m.end()))
            elif cue == "+":
                if at >= done["phone"] and (m := PHONE.match(text, at)):
                    done["phone"] = m.end()
                    if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                        out["phone"].append(m.span())
            elif cue == "url":
                start, least = at - 2, max(done["url"], at - 14)
                while start > least and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start < at - 2 and (m := HOST.match(text, at + 1)):
                    done["url"] = m.end()
                    out["url"].append((start, m.end()))
            elif cue == "secret cue":
                if at >= done["secret"] and (m := SECRET_VALUE.match(text, at + 1)) and any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                    done["secret"] = m.end(1)
                    out["secret"].append(m.span(1))
            elif cue.startswith("secret"):
                start = at + 1 - int(cue[7:])
                if start >= done["secret"] and (m := SECRET_FORM.match(text, start)):
                    done["secret"] = m.end()
                    out["secret"].append(m.span())
            elif at >= done["account"] and (m := ACCOUNT.match(text, at + 1)) and (m[1][:2].isdigit() or not m[1][:2].isupper() or iban(m[1]) or len(DIGITS.findall(m[1])) == 1 and m[1][2:].isdigit() and len(m[1]) <= 12):
                done["account"] = m.end(1)
                out["account"].append(m.span(1))
        return out


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind:start:end), base_sha256 over the base kinds, a count of each kind and of all spans (n_spans). A map over rows."""
    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = bpe.encoder(Finder)
        for batch in batches:
            found = [finder.find(x) if x else dict.fromkeys(KINDS, ()) for x in batch.column(1).to_pylist()]
            out = {"doc_id": batch.column(0)} | {f"n_{k}": pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS}
            out["n_spans"] = pa.array([sum(map(len, f.values())) for f in found], pa.int64())
            out["base_sha256"] = pa.array([hashlib.sha256(joined(f, BASE_KINDS).encode()).hexdigest() for f in found], pa.string())
            out["spans"] = pa.array([joined(f, KINDS) for f in found], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_spans long, base_sha256 string, spans string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
