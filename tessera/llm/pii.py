"""Personal data: base rules, then boosted trees over spans from high-recall generators.

The base rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers; their spans always stay. The
generators propose further, overlapping spans. Trees judge each proposal by its format and the words around it; a
threshold calibrated for precision selects, and among overlapping spans the likeliest wins.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import each, empty_if_null, slices

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the trees add.
ADDED = ("secret", "ssn", "iban", "mail", "tel", "mac")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match of the rule can begin only where a run of digits does, and takes whole runs, so no text is read more than four times.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
GENERATORS = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}={0,2}(?![A-Za-z0-9_/+-])"), "digit"),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])"), "digit"),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), "digit"),
    ("mail", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT|@)[\])] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]+)+"), "bracket"),
    ("tel", re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9.-])"), "digit"),
    ("mac", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"), "digit"),
)
#: Words before a span that speak for personal data, and words that speak against, in the corpus's languages.
FOR = (
    "token", "secret", "key", "password", "passwd", "pwd", "api", "apikey", "auth", "bearer", "ssn", "social", "iban", "account", "mail", "email", "contact", "tel", "phone", "call", "fax", "mobile", "mac", "device",
    "konto", "passwort", "telefon", "handy", "anruf", "kontakt", "gerät", "compte", "courriel", "téléphone", "passe", "appelez", "cuenta", "clave", "contraseña", "teléfono", "correo", "móvil", "llame",
)
AGAINST = (
    "commit", "sha", "sha256", "md5", "checksum", "isbn", "order", "version", "invoice", "id", "page", "part", "serial", "rev", "hash", "item", "ref", "lot",
    "bestellung", "rechnung", "seite", "teil", "commande", "facture", "pièce", "pedido", "factura", "página", "artículo",
)
#: Endings of mail domains.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl")


def iban_valid(s: str) -> bool:
    """The check digits of an IBAN (ISO 13616)."""
    s = s.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ssn_valid(s: str) -> bool:
    """No area 000, 666 or from 900, no group 00, no serial 0000."""
    d = [c for c in s if "0" <= c <= "9"]
    area, group, serial = "".join(d[:3]), "".join(d[3:5]), "".join(d[5:])
    return len(d) == 9 and area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the mail rule, found from their @ outwards: the run before it, no further than the last match or @."""
    found, start, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            begin = start + len(text[start:at].rstrip(_LOCAL))
            if begin < at:
                found.append((begin, m.end()))
                start = m.end()
        start = max(start, at + 1)
        at = text.find("@", start)
    return found


def _byte_sized(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of BASE, then of start; leftmost matches per kind, failing ones dropped. Time grows in
    proportion to the text, whatever it holds."""
    found = []
    if "@" in text:
        found += [("email", *span) for span in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte_sized, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Spans of every generator, overlapping ones included."""
    digit, bracket = bool(_DIGIT.search(text)), "[" in text or "(" in text
    found = []
    for kind, pattern, needs in GENERATORS:
        if digit if needs == "digit" else bracket:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and the words up to 40 characters before and 20 after it."""
    s = text[start:end]
    n = len(s)
    digits, upper, lower = sum(c.isdigit() for c in s), sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    words = re.findall(r"[^\W_]+", before.lower())[-4:]
    lead = before.rstrip(" \"'")[-1:]
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    return [
        *(float(kind == k) for k in ADDED), n, digits / n, upper / n, lower / n, entropy, switches / n,
        float(all(c in "0123456789abcdefABCDEF" for c in s)), n - digits - upper - lower,
        float(kind == "iban" and iban_valid(s)), float(kind == "ssn" and ssn_valid(s)),
        float(kind == "mail" and re.split(r"[^A-Za-z0-9-]+", s)[-1].lower() in ENDINGS), float(lead in ("=", ":")), float(before[-1:] in "\"'" and before[-1:] != ""), float(after[:1] in "\"'" and after[:1] != ""),
        float(any(w in FOR for w in words)), float(any(w in AGAINST for w in words)), float(bool(words) and words[-1] in FOR), float(bool(words) and words[-1] in AGAINST),
    ]


def _iban(r: random.Random, valid: bool) -> str:
    bank = "".join(r.choice("0123456789") for _ in range(r.choice([11, 14, 16, 18, 20])))
    land = r.choice(["DE", "FR", "ES", "GB", "NL", "IT"])
    check = 98 - int("".join(str(int(c, 36)) for c in bank + land + "00")) % 97
    s = f"{land}{check if valid else (check + r.randint(1, 95)) % 97:02d}{bank}"
    return s if r.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))


def printed(kind: str, r: random.Random, personal: bool) -> list[str]:
    """One string of each printed form of a kind. What is no personal data has the same forms; it differs by its context, by
    check digits or impossible numbers where the kind has them, and by forms that only look alike (behind the others)."""
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, alnum, low, num = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: pick(low, r.randint(2, 9))
    if kind == "secret":
        forms = [pick(hexa, 32), pick(hexa, 40), pick(hexa, 64), pick(alnum, r.randint(20, 64)), f"{pick(low, 2)}_{word()}_{pick(alnum, 24)}"]
        return forms if personal else [*forms, "-".join(word() for _ in range(5)) + pick(num, 2), pick(num, r.randint(20, 30)), "/".join(word() for _ in range(5)) + pick(num, 1), pick(low, 30) + pick(num, 1)]
    if kind == "ssn":
        area = f"{r.randint(1, 665):03d}" if personal or r.random() < 0.5 else r.choice(["000", "666", f"9{pick(num, 2)}"])
        return [f"{area}{c}{r.randint(1, 99):02d}{c}{r.randint(1, 9999):04d}" for c in "- "]
    if kind == "iban":
        return [_iban(r, personal), _iban(r, personal)]
    if kind == "mail":
        end = r.choice(ENDINGS) if personal else word() + "x"
        return [f"{word()}.{word()} [at] {word()} [dot] {end}", f"{word()} (at) {word()}.{end}", f"{word()}[at]{word()}.{word()}.{end}"]
    if kind == "tel":
        forms = [f"({pick(num, 3)}) {pick(num, 3)}-{pick(num, 4)}", f"{pick(num, 3)}-{pick(num, 3)}-{pick(num, 4)}", f"{pick(num, 3)} {pick(num, 4)} {pick(num, 4)}", f"{pick(num, 4)}/{pick(num, 3)} {pick(num, 4)}"]
        return forms if personal else [*forms, f"{pick(num, 2)}/{pick(num, 3)}/{pick(num, 4)}"]
    return [":".join(pick(hexa if personal else num, 2) for _ in range(6)), ":".join(pick((hexa if personal else num).upper(), 2) for _ in range(6))]


def in_context(s: str, r: random.Random, personal: bool) -> tuple[str, int]:
    """A text around s, and the place of s. Words that speak for or against come before it more often than not."""
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    if personal:
        lead = f"{r.choice(FOR)} {r.choice(['= ', ': ', '', 'is ', 'ist ', 'est '])}" if r.random() < 0.85 else ""
    else:
        lead = f"{r.choice(AGAINST)} {r.choice(['', ': ', '#', '= '])}" if r.random() < 0.6 else ""
    quote = r.choice(['"', "", ""])
    before = f"{word()} {word()}, {lead}{quote}"
    return f"{before}{s}{quote} {word()}", len(before)


def training_set(rounds: int = 120, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Labelled proposals: each printed form of each kind once a round, by a fixed seed. They are made, not taken from a
    corpus, so no personal data has to be kept to train."""
    r = random.Random(seed)
    x, y = [], []
    for _ in range(rounds):
        for kind in ADDED:
            for personal in (True, False):
                for s in printed(kind, r, personal):
                    text, at = in_context(s, r, personal)
                    x.append(features(text, kind, at, at + len(s)))
                    y.append(personal)
    return np.array(x), np.array(y, dtype=float)


@functools.lru_cache(maxsize=1)
def default_model(precision: float = 0.95) -> tuple[gbt.Boosted, tuple[float, ...]]:
    """The trees, and a threshold for each added kind, calibrated on a held-out third."""
    x, y = training_set()
    held = np.arange(len(y)) * 3 // len(y) == 1  # rounds: every kind, form and label is in both parts
    model = gbt.fit(x[~held], y[~held], n_trees=60)
    p = model.proba(x[held])
    return model, tuple(gbt.calibrated_threshold(p[rows], y[held][rows], precision) for k in range(len(ADDED)) for rows in [x[held][:, k] == 1])


def added_spans(text: str, base: list[tuple[str, int, int]], model: tuple[gbt.Boosted, tuple[float, ...]]) -> list[tuple[str, int, int]]:
    """The proposals that the trees accept and that overlap neither a base span nor a likelier accepted one."""
    found = proposals(text)
    if not found:
        return []
    trees, limits = model
    p = trees.proba(np.array([features(text, *s) for s in found]))
    taken = sorted(s[1:] for s in base)  # base spans of several kinds may overlap
    free, out = [], []
    for a, b in taken:
        if free and a < free[-1][1]:
            free[-1] = (free[-1][0], max(free[-1][1], b))
        else:
            free.append((a, b))
    for score, span in sorted(zip(p.tolist(), found), key=lambda z: (-z[0], z[1][1], z[1][2], z[1][0])):
        k = bisect.bisect_left(free, (span[2],))  # spans before k begin before this one ends; they do not overlap each other
        if score >= limits[ADDED.index(span[0])] and (not k or free[k - 1][1] <= span[1]):
            free.insert(k, span[1:])
            out.append(span)
    return sorted(out, key=lambda s: (ADDED.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first in order counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[gbt.Boosted, tuple[float, ...]] | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and redacted, if with_text).

    spans lists base spans, then added ones, as kind:start:end in code points, comma-joined; base_sha256 is the digest of
    the base spans in that form. Null texts count as empty: no spans, and the digest of the empty string. Repeated rows
    give repeated rows; an empty table gives an empty result. Other columns are not read.
    """
    model = model or default_model()
    rows = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted")}
            for text in each(batch.column(1)):
                base = base_spans(text)
                spans = base + added_spans(text, base, model)
                n = Counter(s[0] for s in base)
                for k in BASE:
                    out[f"n_{k}"].append(n[k])
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
                if with_text:
                    out["redacted"].append(redact(text, spans))
            columns = {"doc_id": batch.column(0), **{k: pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items() if with_text or k != "redacted"}}
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * with_text
    return rows.mapInArrow(run, schema)
