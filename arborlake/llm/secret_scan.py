"""Secret scans with a recursive decoding worklist.

Each text is scanned; encoded stretches in it (percent escapes, Unicode and hex escapes, base64, and compressed data inside
base64) are unwrapped into layers of their own, which are scanned and unwrapped in turn until nothing new comes out. What
was found in a content is replayed wherever it occurs again; a content that recurs within itself is not followed, so cycles end. What is found in a layer is mapped
back to the stretch of the original text that it came from.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

KINDS = ("assign", "access", "hex")
#: The patterns of the kinds and the least lengths of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA and more, 20 in all
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

#: Runs without space in which escapes are looked for; matching whole runs first keeps the search linear.
URL_RUN, VISIBLE_RUN = re.compile(r"[A-Za-z0-9_.~+%-]+"), re.compile(r"[\x21-\x7e]+")
PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
#: Base64 in each alphabet: a line of it, and a shorter last line.
BASE64 = [(re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"([A-Za-z0-9+/]{1,15}={0,2})")), (re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"), re.compile(r"([A-Za-z0-9_-]{1,15}={0,2})"))]
BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
#: A compressed layer is unpacked and scanned about so many bytes at a time, cut where no match and no encoded stretch can cross: at a
#: single space between characters that can't belong to an assignment around it. What has no such place is carried on whole.
PIECE, CUT = 16 << 20, re.compile(r"""(?<=[^\s:="'])\x20(?=[^\s:="'])""")
#: Decoded bytes are read as UTF-8, and where at least a quarter of them are zero, in both orders of UTF-16 too; what can't be read is
#: replaced, never dropped.
CODECS, WIDE = ("utf-8", "utf-16-le", "utf-16-be"), 4
REDACTED = "[REDACTED]"

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers int"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all matches, leftmost and non-overlapping for each kind, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0)


def _unpacked(raw: bytes) -> Iterator[bytes]:
    """The pieces of all members of compressed data, as far as they can be read."""
    try:
        while _packed(raw):
            member = zlib.decompressobj(47)
            while not member.eof:
                piece = member.decompress(raw, PIECE)
                raw = member.unconsumed_tail
                if not piece:
                    break
                yield piece
            raw = member.unused_data if member.eof else b""
    except zlib.error:
        return


def _readings(raw: bytes) -> tuple[str, ...]:
    return CODECS if raw.count(0) * WIDE >= len(raw) > 0 else CODECS[:1]


def _cut(text: str) -> int:
    """The last place where nothing that is looked for can cross; 0 if there is none."""
    for back in (1 << 12, 1 << 16, 1 << 20, len(text)):
        found = list(CUT.finditer(text, max(0, len(text) - back)))
        if found:
            return found[-1].start()
    return 0


def _texts(raw: bytes) -> Iterator[str]:
    """The texts that decoded bytes may be: whole, or the parts of a large compressed one, cut where nothing crosses."""
    plain, held, readers = True, dict.fromkeys(CODECS, ""), {c: codecs.getincrementaldecoder(c)("replace") for c in CODECS}
    for piece in _unpacked(raw) if _packed(raw) else ():
        plain = False
        for codec in _readings(piece):
            text = held[codec] + readers[codec].decode(piece)
            k = _cut(text)
            held[codec] = text[k:]
            if k:
                yield text[:k]
    yield from filter(None, held.values())
    if plain:  # it isn't compressed, or only looked so
        for codec in _readings(raw):
            yield raw.decode(codec, "replace")


def _percent(part: str) -> tuple[str, list[int]]:
    """The decoded text and, for each of its characters, the place in part where it began."""
    raw, at, k = bytearray(), [], 0
    while k < len(part):
        if part[k] == "%" and PERCENT.match(part, k):
            raw.append(int(part[k + 1 : k + 3], 16))
            at.append(k)
            k += 3
        else:
            raw += part[k].encode()
            at.append(k)
            k += 1
    text = raw.decode("utf-8", "replace")
    places, b = [], 0
    for c in text:
        places.append(at[min(b, len(at) - 1)])
        b += len(c.encode()) if c != "�" else 1
    return text, places


def _escapes(part: str) -> tuple[str, list[int]]:
    out, places, k = [], [], 0
    for m in ESCAPE.finditer(part):
        places += range(k, m.start())
        out.append(part[k : m.start()])
        code = int(m[1] or m[2] or m[3], 16)
        out.append(chr(code) if code < 0x110000 else "�")
        places.append(m.start())
        k = m.end()
    out.append(part[k:])
    places += range(k, len(part))
    return "".join(out), places


def unwrap(text: str) -> Iterator[tuple[int, int, str, list[int] | None]]:
    """(start, end, decoded text, places) of the encoded stretches of a text; places is None where only the whole stretch can be told."""
    if "%" in text:
        for m in URL_RUN.finditer(text):
            if "%" in m[0] and PERCENT.search(m[0]):
                yield m.start(), m.end(), *_percent(m[0])
    if "\\" in text:
        for m in VISIBLE_RUN.finditer(text):
            if "\\" in m[0] and ESCAPE.search(m[0]):
                yield m.start(), m.end(), *_escapes(m[0])
    for k, (line, last) in enumerate(BASE64):
        if k == 0 or "-" in text or "_" in text:
            for start, end, part in _runs(text, line, last):
                if k and "-" not in part and "_" not in part:
                    continue  # the same in either alphabet
                for decoded in _decoded(part):
                    yield start, end, decoded, None


def _runs(text: str, line: re.Pattern, last: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of each line of base64, and of lines that follow each other as one, with and without the last."""
    held: list[tuple[int, int, str]] = []

    def whole() -> Iterator[tuple[int, int, str]]:
        if held:
            lines = list(held)
            gap = BREAK.match(text, lines[-1][1])
            short = last.match(text, gap.end()) if gap and not lines[-1][2].endswith("=") else None
            if short:
                lines.append((short.start(), short.end(), short[0]))
            for n in {len(lines), len(lines) - 1} - {0, 1}:
                yield lines[0][0], lines[n - 1][1], "".join(x for _, _, x in lines[:n])

    for m in line.finditer(text):
        yield m.start(), m.end(), m[0]
        gap = BREAK.match(text, held[-1][1]) if held else None
        if not gap or gap.end() != m.start() or held[-1][2].endswith("="):
            yield from whole()
            held.clear()
        held.append((m.start(), m.end(), m[0]))
    yield from whole()


def _decoded(part: str) -> Iterator[str]:
    part = part.rstrip("=")
    if part.isalpha() and (part.islower() or part.isupper() or part.istitle()):
        return  # a word
    part = part.replace("-", "+").replace("_", "/")
    try:
        raw = base64.b64decode(part[: len(part) - (len(part) % 4 == 1)] + "=" * (-len(part) % 4 if len(part) % 4 != 1 else 0))
    except (binascii.Error, ValueError):
        return
    yield from _texts(raw)


def _onto(found: Iterable[tuple[int, int, int]], start: int, end: int, places: list[int] | None) -> set[tuple[int, int, int]]:
    """Spans of a decoded text as spans of the text around its stretch."""
    if places is None:
        return {(start, kind, end) for _, kind, _ in found}
    return {(start + places[s], kind, start + places[e] if e < len(places) else end) for s, kind, e in found}


def scan_layers(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(base matches, all matches mapped onto the text, number of different layers)."""
    digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    base = scan(text)
    done: dict[bytes, set[tuple[int, int, int]]] = {}
    # The layers from the text down to the one being read: key, spans found so far, the stretches left, and the one below.
    path: list[list] = [[digest(text), set(base), unwrap(text), None]]
    within = {path[0][0]}
    while True:
        key, found, parts, _ = path[-1]
        for start, end, decoded, places in parts:
            inner = digest(decoded)
            if inner in done:
                found |= _onto(done[inner], start, end, places)
            elif inner in within:
                found |= _onto(scan(decoded), start, end, places)
            else:
                path[-1][3] = start, end, places
                path.append([inner, set(scan(decoded)), unwrap(decoded), None])
                within.add(inner)
                break
        else:
            path.pop()
            within.discard(key)
            done[key] = found
            if not path:
                return base, sorted(found), len(done)
            path[-1][1].update(_onto(found, *path[-1][3]))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def report(text: str | None) -> tuple:
    base, spans, layers = scan_layers(text or "")
    n = [sum(kind == k for _, kind, _ in base) for k in range(3)]
    return (*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), layers)


def redact(text: str | None) -> str | None:
    """The text with every found span, overlapping ones as one, replaced by REDACTED; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in scan_layers(text)[1]:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the digest columns of SCHEMA and no others, for every row; a null text counts as an empty one.

    Base spans are those in the text itself; spans holds these and the ones found in decoded layers, on the original text.
    Texts are independent of each other, so there is no shuffle; repeated rows each get their row. An empty table gives no rows. A very
    long text is one row's work in one task; nothing bounds how far compressed data inside it unfolds, but it is held a piece at a time.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([report(t) for t in texts], columns=names)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, SCHEMA)
    return in_small_batches(docs).select(F.col(id_col), found(F.col(text_col)).alias("_found")).select(id_col, "_found.*")


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All documents with all their columns; secrets in the text are replaced, and chars_col, if there, counts anew.

    Null and empty texts stay, repeated rows are each kept, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(redact)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    clean = in_small_batches(docs).withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col)))
    return clean.withColumn(chars_col, F.length(text_col).cast(dict(docs.dtypes)[chars_col])) if chars_col in docs.columns else clean
