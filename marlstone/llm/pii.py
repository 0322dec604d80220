"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Base kinds in the order of the digest, then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "vat", "tax_id", "bic", "secret")

#: Whole words, or runs of them, that make a kind likelier when they stand within WINDOW characters of a span, and such that speak against it.
CONTEXT = {
    "email": ("mail", "mails", "email", "emails", "contact", "write to", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "login"),
    "card": ("card", "cards", "visa", "mastercard", "credit", "payment", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "fax", "telefon", "telefonnummer", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "bic", "swift"),
    "ssn": ("ssn", "social security", "sécurité sociale", "seguridad social"),
    "vat": ("vat", "tva", "ust", "ustid", "iva", "tax"),
    "tax_id": ("tax id", "tax number", "steuer", "steuernummer", "fiscal", "nif", "dni"),
    "bic": ("bic", "swift", "bank", "iban"),
    "secret": ("key", "keys", "token", "secret", "password", "api", "credential", "credentials", "passwort", "clé", "clave"),
}
AGAINST = {
    "ip": ("version", "release", "chapter", "section"),
    "card": ("order", "invoice", "isbn", "serial", "tracking"),
    "phone": ("order", "invoice", "isbn", "version"),
    "ssn": ("part", "serial", "model", "order"),
    "vat": ("serial", "model", "order"),
    "tax_id": ("isbn", "serial", "model", "order"),
    "secret": ("hash", "sha256", "sha1", "md5", "checksum", "digest", "commit"),
}
WINDOW = 48
#: Score of a confirmed span without context words, what a context word adds or takes, and the least score of an added span.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.4, "ssn": 0.2, "vat": 0.35, "tax_id": 0.4, "bic": 0.2, "secret": 0.4}
#: An added span needs context: only a checksum of two digits or more, or a key's known beginning, stands by itself (SURE).
GAIN = 0.15
LEAST = 0.5
SURE = {"iban": 22, "secret": 36}

# A greedy run of a class is matched from the run's first character, so the look-behinds change no match; they keep long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_VAT = re.compile(r"(?<![A-Za-z0-9])(?:DE[0-9]{9}|FR[0-9]{11}|ES[A-Z][0-9]{7}[A-Z0-9])(?![A-Za-z0-9])")
_TAX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{8}[A-Z]|[0-9]{11})(?![A-Za-z0-9])")
_BIC = re.compile(r"(?<![A-Za-z0-9])[A-Z]{4}(?:DE|FR|ES|GB|US|IT|NL|BE|AT|CH)[A-Z0-9]{2}(?:[A-Z0-9]{3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk[-_][A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|[A-Za-z0-9_/+-]{32,})(?![A-Za-z0-9_-])")
_KNOWN = re.compile(r"AKIA|gh[pousr]_|sk[-_]|xox[abprs]-")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        packed = m[0].replace(" ", "")
        if 15 <= len(packed) <= 34 and mod97(packed):
            yield m.span()


def _ssns(text: str):
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


def mod11_10(digits: str) -> bool:
    """ISO 7064 MOD 11,10, as in German tax and VAT numbers."""
    p = 10
    for c in digits[:-1]:
        s = (int(c) + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


#: The control letters of Spanish identity numbers, by the number mod 23.
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _bics(text: str):
    for m in _BIC.finditer(text):
        yield m.span()


def _vats(text: str):
    for m in _VAT.finditer(text):
        own = m[0][2:]
        if m[0].startswith("DE") and mod11_10(own):
            yield m.span()
        elif m[0].startswith("FR") and (12 + 3 * (int(own[2:]) % 97)) % 97 == int(own[:2]):
            yield m.span()
        elif m[0].startswith("ES"):
            digits = own[1:8]
            odd = sum(sum(divmod(2 * int(c), 10)) for c in digits[::2])
            check = -(odd + sum(map(int, digits[1::2]))) % 10
            if own[8] in (str(check), "JABCDEFGHI"[check]):
                yield m.span()


def _tax_ids(text: str):
    for m in _TAX.finditer(text):
        if m[0].isdigit():
            if m[0][0] != "0" and 2 <= max(m[0][:10].count(c) for c in m[0][:10]) <= 3 and mod11_10(m[0]):
                yield m.span()
        elif _LETTERS[int(m[0][:-1]) % 23] == m[0][-1]:
            yield m.span()


def _secrets(text: str):
    for m in _SECRET.finditer(text):
        own = m[0]
        kinds = any(c.isdigit() for c in own) + any(c.islower() for c in own) + any(c.isupper() for c in own)
        # a long run counts if it looks drawn at random: digits and letters, and many different ones
        if _KNOWN.match(own) or (kinds >= 2 and any(c.isdigit() for c in own) and len(set(own)) >= 12):
            yield m.span()


_WORD = re.compile(r"\w+")


def _words_near(text: str, start: int, end: int) -> str:
    """The words within WINDOW characters on both sides, a blank around each; those that the window cuts are left out."""
    a, b = max(0, start - WINDOW), min(len(text), end + WINDOW)
    while 0 < a < start and text[a - 1].isalnum() and text[a].isalnum():
        a += 1
    while end < b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b -= 1
    return f" {' '.join(_WORD.findall(text[a:start].lower()))} | {' '.join(_WORD.findall(text[end:b].lower()))} "


def score(kind: str, text: str, start: int, end: int) -> float:
    """PRIOR plus GAIN for each word of CONTEXT nearby and less GAIN for each of AGAINST, between 0 and 1; a span that stands by itself (SURE characters, or a key's known beginning) starts from LEAST at least."""
    near = _words_near(text, start, end)
    base = PRIOR[kind]
    if kind in SURE and (end - start >= SURE[kind] or kind == "secret" and _KNOWN.match(text, start)):
        base = max(base, LEAST)
    held = lambda words: sum(f" {w} " in near for w in words)
    return max(0.0, min(1.0, base + GAIN * (held(CONTEXT[kind]) - held(AGAINST.get(kind, ())))))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text's spans in code points, by kind and start; base spans whatever their score."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *x) for x in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *x) for x in _ips(text)]
        found += [("card", *x) for x in _cards(text)]
        found += [("phone", *x) for x in _phones(text)] if "+" in text else []
        found += [("iban", *x) for x in _ibans(text)]
        found += [("ssn", *x) for x in _ssns(text)]
        found += [("vat", *x) for x in _vats(text)]
        found += [("tax_id", *x) for x in _tax_ids(text)]
        found += [("secret", *x) for x in _secrets(text)]
    found += [("bic", *x) for x in _bics(text)]
    scored = [(k, a, b, score(k, text, a, b)) for k, a, b in found]
    return [x for x in scored if x[0] in BASE or x[3] >= LEAST]


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by <kind>; of overlapping spans the one that starts first (then the longest)."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])


SCHEMA = "id {id}, spans array<struct<kind string, start int, end int, score double>>, redacted string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True) -> DataFrame:
    """One row per input row: id, spans (kind, start, end, score), redacted (null unless asked for).

    Positions are code points, the end exclusive. A null or empty text has no spans. One pass, no shuffle;
    memory is that of an Arrow batch, and texts of any length are read whole. Base spans stay whatever their score; added ones need LEAST, which context words
    decide for most. Spans of different kinds may overlap; of one kind they don't. Rows that repeat get the same spans. Other columns are not read. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [find(t) for t in texts]
            rows = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in x] for x in spans]
            span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
            clean = [redact(t or "", x) for t, x in zip(texts, spans)] if redacted else [None] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span)), pa.array(clean, pa.string())], ["id", "spans", "redacted"])

    from pyspark.sql import functions as F

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, SCHEMA.format(id=kind)).withColumnRenamed("id", id_col)


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans, all spans as text, how many were added, and the scores of all in the same order, three digits."""
    from pyspark.sql import functions as F

    def of(kind):
        return F.filter("spans", lambda x: x.kind == kind)

    def joined(kinds):
        return F.array_join(F.flatten(F.array(*[F.transform(of(k), lambda x: F.concat_ws(":", x.kind, x.start, x.end)) for k in kinds])), ",")

    scores = F.array_join(F.flatten(F.array(*[F.transform(of(k), lambda x: F.round(x.score, 3).cast("string")) for k in BASE + ADDED])), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select(id_col, *counts, F.sha2(joined(BASE).cast("binary"), 256).alias("base_sha256"), joined(BASE + ADDED).alias("spans"), F.size(F.filter("spans", lambda x: x.kind.isin(*ADDED))).cast("long").alias("n_added"), scores.alias("scores"))
