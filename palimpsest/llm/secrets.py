"""Secret scans with structural confirmation.

Base spans come from three patterns: assignments, access key ids and long hexadecimal runs. The method adds spans
only where a candidate decodes into something that parses: base64 or hex that is a DER sequence whose nested
lengths fill it exactly and that has the layout of a private key (PKCS#1, PKCS#8, SEC 1, DSA), an OpenSSH key
container with consistent length fields, or a signed token whose header is a JSON object naming an algorithm.
Every long run of base64 is tried, joined over line breaks, escaped ones too, also for a PEM block encoded in it.

Spans are code points, end exclusive. Null texts are empty. Rows are independent: repeated rows repeat, a null
doc_id stays null, other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A keyword of an assignment, as cheap tests of the lower-cased text.
KEYWORDS = ("passw", "secret", "token", "api")
#: A header is a brace after any blanks: e, or C, D, I for the blanks.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([eCDI][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{8,}))")
#: What may stand between lines of base64: line breaks, also escaped ones, and the escape of a slash.
JOIN = r"(?:(?:\\+r)?\\+n[\x20\t]*|\\+r|\r?\n[\x20\t]*|\\+(?=/))"
JOINS = re.compile(JOIN)
#: First line of a PEM block; headers that name the cipher of an encrypted one, and bytes in a block of it.
PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,24}PRIVATE KEY)-----")
PEM_CIPHER = re.compile(r"(?m)^DEK-Info: ?([A-Z0-9-]+), ?([0-9A-Fa-f]+)\s*$")
CIPHER_BLOCKS = {"DES": 8, "AES": 16, "CAM": 16, "IDE": 8, "RC2": 8, "BF-": 8, "CAS": 8, "SEE": 16}
#: Base64 over any number of lines. DER sequences start with M, wherever in it; OpenSSH containers with their magic.
BASE64_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{JOIN}[A-Za-z0-9+/_-]+)*")
OPENSSH = "b3BlbnNzaC1rZXktdjE"
#: The end of a PEM block's first line in base64, at each of three alignments.
ENCODED_PEM = [base64.b64encode(b"\0" * k + b"PRIVATE KEY-----").decode()[k and 4 : 20] for k in range(3)]
#: A DER sequence or an OpenSSH container in hex digits.
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]7373682[Dd])[0-9A-Fa-f]{46,}(?![0-9A-Fa-f])")
KINDS = ("assign", "access", "hex", "der", "openssh", "pem", "jwt")


def decode64(text: str) -> bytes:
    """Either alphabet, padding optional; empty if it isn't base64."""
    text = re.sub(r"\s+", "", text).rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True) if len(text) % 4 != 1 else b""
    except (binascii.Error, ValueError):
        return b""


class Stretch:
    """Bytes from ``start`` to ``end`` of what base64 digits (of the standard alphabet, without blanks and padding) stand
    for from a place on, decoded only where they are read. So a parser that looks at headers reads a few bytes of a long run, wherever in it a header claims to stand."""

    def __init__(self, digits: str, at: int, start: int = 0, end: int | None = None):
        self.digits, self.at, self.start = digits, at, start
        self.end = (len(digits) - at) * 3 // 4 if end is None else end

    def __len__(self) -> int:
        return self.end - self.start

    def __getitem__(self, key: int | slice) -> int | Stretch:
        if isinstance(key, int):
            return bytes(self[key : key + 1])[0]
        a, b, _ = key.indices(len(self))
        return Stretch(self.digits, self.at, self.start + a, self.start + max(a, b))

    def __bytes__(self) -> bytes:
        first = self.start // 3
        block = self.digits[self.at + 4 * first : self.at + 4 * (-(-self.end // 3))]
        if len(block) % 4:
            block = block[:-1] if len(block) % 4 == 1 else block + "=" * (-len(block) % 4)
        return binascii.a2b_base64(block)[self.start - 3 * first : self.end - 3 * first]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, bytes) and len(self) == len(other) and bytes(self) == other

    __hash__ = None

    def startswith(self, head: bytes) -> bool:
        return bytes(self[: len(head)]) == head


#: No kind of key has more elements in a row than this.
ELEMENTS = 16


def der_items(data: bytes | Stretch) -> list[tuple[int, bytes | Stretch]] | None:
    """Tag and value of each element; None unless their lengths fill ``data`` exactly, or if there are more than any key
    has."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or len(items) == ELEMENTS:
            return None
        head = bytes(data[at : at + 6])
        tag, length = head[0], head[1]
        at += 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or head[2] == 0:
                return None
            length, at = int.from_bytes(head[2 : 2 + n], "big"), at + n
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        items.append((tag, data[at : at + length]))
        at += length
    return items


def plausible(head: bytes) -> bool:
    """Whether a DER sequence that begins so can be a private key: a version comes first, or an algorithm's name."""
    behind = lambda at: at + 2 + (head[at + 1] & 0x7F if head[at + 1 : at + 2] >= b"\x80" else 0)
    at = behind(0)
    if head[at : at + 2] == b"\x02\x01":
        return head[at + 2 : at + 3] in (b"\x00", b"\x01")
    return head[at : at + 1] == b"\x30" and len(head) > at + 1 and head[behind(at) : behind(at) + 1] == b"\x06"


def private_key(data: bytes | Stretch) -> str:
    """The layout of a DER private key, or an empty string."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return ""
    parts = der_items(outer[0][1])
    tags = [t for t, _ in parts or ()]
    if len(tags) >= 9 and set(tags[:9]) == {2} and parts[0][1] in (b"\x00", b"\x01"):
        return "pkcs1"
    if tags[:3] == [2, 0x30, 4]:
        algorithm = der_items(parts[1][1])
        return "pkcs8" if algorithm and algorithm[0][0] == 6 else ""
    if tags[:2] == [2, 4] and parts[0][1] == b"\x01" and len(parts[1][1]) in (20, 24, 28, 30, 32, 48, 66):
        return "sec1"
    if tags == [2] * 6 and parts[0][1] == b"\x00":
        return "dsa"
    if tags == [0x30, 4]:
        algorithm = der_items(parts[0][1])
        return "pkcs8-encrypted" if algorithm and [t for t, _ in algorithm] == [6, 0x30] else ""
    return ""


def openssh_key(data: bytes | Stretch) -> bool:
    """Magic, cipher, KDF, options, key count and the public key, each within its length."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at = 15
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + n > len(data):
            return False
        at += 4 + n
    keys = int.from_bytes(data[at : at + 4], "big")
    n = int.from_bytes(data[at + 4 : at + 8], "big")
    return 1 <= keys <= 16 and 0 < n <= len(data) - at - 8


def signed_token(header: str, claims: str) -> bool:
    try:
        head, body = json.loads(decode64(header)), json.loads(decode64(claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def key_kind(data: bytes) -> str:
    return "openssh" if openssh_key(data) else "der" if private_key(data) else ""


def der_size(data: bytes) -> int:
    """Bytes of the DER sequence that starts here, by its header; 0 if none does."""
    if len(data) < 6 or data[0] != 0x30:
        return 0
    n = data[1] & 0x7F
    if data[1] < 0x80:
        return 2 + n
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 else 0


def openssh_size(data: bytes | Stretch) -> int:
    """Bytes of an OpenSSH container up to the end of its private part; all if that is cut off."""
    at = 15
    for k in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(keys + 1):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return min(at, len(data))


def pem_confirmed(body: str) -> bool:
    """Whether what stands between the first and last line of a PEM block decodes to a key. An encrypted body can't be
    parsed; it must be whole blocks of the cipher that its header names, with an initial vector of that size."""
    plain = re.sub(r"\\+(?=/)", "", re.sub(r"\\+[rn]", "\n", body))
    data = decode64(re.sub(r"(?m)^[A-Za-z-]+:.*$", "", plain))
    if "Proc-Type" in plain and (cipher := PEM_CIPHER.search(plain)):
        block = CIPHER_BLOCKS.get(cipher[1][:3], 0)
        return bool(block) and len(cipher[2]) == 2 * block and len(data) >= 64 and len(data) % block == 0
    return bool(key_kind(data))


def pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of confirmed blocks. Each first line is paired with the next last line of its kind, unless another first
    line comes before that; each body is read once."""
    begins = list(PEM_BEGIN.finditer(text))
    for m, after in zip(begins, [*(b.start() for b in begins[1:]), len(text)], strict=True):
        last = f"-----END {m[1]}-----"
        end = text.find(last, m.end(), after)
        if end >= 0 and pem_confirmed(text[m.end() : end]):
            yield m.start(), end + len(last)


#: The other alphabet's two digits.
STANDARD = str.maketrans("-_", "+/")


def whole64(text: str) -> bytes:
    return decode64(text[:-1] if len(text) % 4 == 1 else text)


def run_spans(run: str) -> list[tuple[str, int, int]]:
    """Keys in a run of base64: kind, start, end. Wherever a key may begin, its headers alone are read (their number is
    bounded), so that the time goes with the run's length, whatever stands in it."""
    cuts = [(m.start(), m.end()) for m in JOINS.finditer(run)]
    joined, places = run, None
    if cuts:
        joined = JOINS.sub("", run)
        places, at = [], 0
        for a, b in [*cuts, (len(run), len(run))]:
            places.extend(range(at, a))
            at = b
    place = (lambda i: places[i]) if places is not None else (lambda i: i)
    if len(joined) < 32:
        return []
    if any(x in joined for x in ENCODED_PEM):
        for k in range(4):
            if any(pem_blocks(whole64(joined[k:]).decode("latin-1"))):
                return [("pem", 0, len(run))]
    joined = joined.translate(STANDARD)
    spans, at = [], 0
    while (at := joined.find("M", at)) >= 0:
        head = binascii.a2b_base64(joined[at : at + 24]) if at + 24 <= len(joined) else whole64(joined[at:])
        size = der_size(head)
        chars = -(-size * 4 // 3)
        if size and at + chars <= len(joined) and plausible(head) and private_key(Stretch(joined, at, 0, size)):
            spans.append(("der", place(at), place(at + chars - 1) + 1))
            at += chars
        else:
            at += 1
    at = 0
    while (at := joined.find(OPENSSH, at)) >= 0:
        data = Stretch(joined, at)
        if openssh_key(data):
            chars = -(-openssh_size(data) * 4 // 3)
            spans.append(("openssh", place(at), place(min(at + chars, len(joined)) - 1) + 1))
            at += chars
        else:
            at += 1
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    lowered = text.lower()
    spans = []
    if any(k in lowered for k in KEYWORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    spans += [("jwt", m.start(), m.end(3)) for m in TOKEN.finditer(text) if signed_token(m[1], m[2])]
    if "PRIVATE KEY-----" in text:
        spans += [("pem", a, b) for a, b in pem_blocks(text)]
    blocks = [(a, b) for k, a, b in spans if k == "pem"]
    for m in BASE64_RUN.finditer(text):
        for kind, a, b in run_spans(m[0]):
            a, b = m.start() + a, m.start() + b
            b += len(re.match("={0,2}", text[b : b + 2])[0])
            if not any(x <= a and b <= y for x, y in blocks):
                spans.append((kind, a, b))
    for m in HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            spans.append((kind, m.start(), m.end()))
    return spans


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by start, then kind as listed."""
    order = lambda s: (s[1], KINDS.index(s[0]))
    base = base_spans(text)
    return sorted(base, key=order), sorted(set(base + confirmed_spans(text)), key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = find_spans(text.as_py() or "")
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def redacted(text: str, mask: str = "[secret]") -> str:
    """The text with every span replaced, overlapping ones as one."""
    out, at = [], 0
    for _, a, b in find_spans(text)[1]:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked; n_chars, where there is one, follows the text."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(redacted, na_action="ignore")

    out = docs.withColumn("text", mask(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
