"""Secret scan by dictionary-primed zstandard novelty.

A candidate is a string without blanks, quotes, brackets, commas or semicolons that stands
within WINDOW characters of a sensitive name (token = "...", <password>...</password>, API key: ..., and so on, in several
languages) and has at least SHORTEST characters, or SHORT ones if it is assigned to the name by = or in quotes; so is a password in a
URL, a string that begins as issued keys do (AKIA, ghp_ and others), and the body of a private key block.  Its novelty is what it adds, in bytes for
each of its own, to the compressed size of the text around it, with a compressor primed by
identifiers: common code words, and the words that stand around sensitive names in
the corpus (all documents count; the most frequent fill 32 KB, the size of a dictionary, whatever the corpus).  Words of the dictionary,
placeholders and repeats compress away; random strings of any kind of characters don't, and are reported.

Defined cases: null, empty and blank texts hold no secret; very long texts are searched whole; repeated
rows, and a secret that stands several times in a text, are each reported; of words of equal frequency the dictionary
takes the first in order of letters; a string that ties with the threshold is reported.  Offsets count characters.
Columns other than doc_id (of any type), text and n_chars have no influence, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

PARTED = [f"{kind}{by}key" for kind in ("api", "access", "private") for by in ("", "_", "-", " ")]
OTHER = ("contrase", "kennwort", "mot de passe", "senha", "\u043f\u0430\u0440\u043e\u043b\u044c", "\u041f\u0430\u0440\u043e\u043b\u044c", "\u5bc6\u7801", "\u30d1\u30b9\u30ef\u30fc\u30c9")
ISSUED_NAMES = ("akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "sk_test_", "aiza")
NAMES = ("token", "secret", "passw", "passphrase", "pwd", *PARTED, "auth", "credential", "bearer", *OTHER, *ISSUED_NAMES)
NAME = re.compile(
    r"(?i)token|secret|passw(?:or)?[dt]|passphrase|pwd|(?:api|access|private)[ _-]?key|auth|credential|bearer"
    r"|contrase\u00f1a|contrasena|kennwort|mot de passe|\bsenha\b|\u043f\u0430\u0440\u043e\u043b\u044c|\u5bc6\u7801|\u30d1\u30b9\u30ef\u30fc\u30c9"
)
STRING = re.compile(r"""[^\s"'`<>(){}\[\],;]{8,}""")
ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[\w-]{10,}|sk_(?:live|test)_\w{10,}|AIza[\w-]{30,})(?![A-Za-z0-9])")
LOGIN, LOGIN_BYTES = re.compile(r"://[^\s/:@]{0,80}:(?P<value>[^\s/@]{6,})@"), re.compile(rb"://[^\s/:@]{0,320}:[^\s/@]{6,}@")
#: author and authentic, which name a secret only where one is assigned to them
WEAK = re.compile(r"(?i)auth(?:or(?!i[sz])|enti[cf](?!at))")
DIRECT = re.compile(r"""[\w.-]{0,30}["']?\s{0,4}(?:=>|:=|=|:|\s)\s{0,4}["']?""")
SURE = re.compile(r"""=|[:\s]\s*["']$""")
PARTS, OPEN_PARTS, URL_PARTS = re.compile(r"[?&](?=[\w.-]+=)"), re.compile(r"[?&](?=[\w.-]+=)|#"), re.compile(r"[?&/#:@]+")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----\s*(?P<value>[^-]{16,})")
ASSIGNED = re.compile(r"(?P<name>[\w.$-]{0,80}?)(?P<by>=>|:=|=(?!=*$)|:(?!//))")
TARGET = re.compile(r"""["'\])}]{0,3}\s{0,20}(?:=|:)""")
BUILT_IN = (
    "function return import export const public static private class def self this null true false none undefined string number boolean "
    "config settings environment process getenv os.environ example placeholder changeme your_token_here your_api_key_here insert_token_here "
    "username password secret token access_token refresh_token client_secret client_id api_key authorization bearer header request response "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000000000000000 xxxxxxxxxxxxxxxxxxxxxxxx ************************"
)
CONTEXT, WINDOW, SHORTEST, SHORT, DICTIONARY_BYTES, NOVELTY = 256, 96, 16, 8, 32_768, 0.6
PART = re.compile(r"[\w.-]+")
WORD = re.compile(r"[A-Za-z_][A-Za-z_.-]{2,39}")


def sensitive_rows(column: pa.Array) -> np.ndarray:
    """Rows whose text has a sensitive name, found by byte search over all texts at once."""
    buf, off = K.text_bytes(column)
    low = buf.tobytes().lower()
    rows: set[int] = set()
    for name in NAMES:
        key, at = name.encode(), 0
        while (at := low.find(key, at)) >= 0:
            row = int(np.searchsorted(off, at, "right")) - 1
            if at + len(key) <= off[row + 1]:
                rows.add(row)
                at = int(off[row + 1])  # one find a row is enough
            else:
                at += 1
    rows.update(int(np.searchsorted(off, m.start(), "right")) - 1 for m in LOGIN_BYTES.finditer(low))
    return np.array(sorted(rows), np.int64)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of the strings that begin within WINDOW characters after a sensitive name, or end within as many before one.

    A name that is assigned to in the string itself is cut off; a string that is itself a name to assign to is none.
    The body of a private key block is one string, however long.
    """
    names = [(m.start(), m.end()) for m in NAME.finditer(text)]
    strong = [x for x in names if not WEAK.match(text, x[0])]
    out = [(m.start("value"), m.start("value") + len(m["value"].rstrip()), "private key") for m in PEM.finditer(text)]
    out += [(*m.span("value"), "login") for m in LOGIN.finditer(text)]
    out += [(*m.span(), "issued key") for m in ISSUED.finditer(text)]
    blocks, out = sorted(out), []
    for x in blocks:
        if not out or out[-1][1] <= x[0]:
            out.append(x)
    blocks = list(out)
    begins = [x for x, *_ in blocks]
    for start, end in _strings(text) if names else ():
        at = bisect.bisect_left(begins, end)
        if any(start < y for _, y, _ in blocks[max(0, at - 2) : at]):
            continue
        own, sure = None, False
        while cut := ASSIGNED.match(text, start, end):
            sensitive = NAME.search(cut["name"])
            if cut["by"] == ":" and not sensitive:
                break
            own, sure = (cut["name"], sure or "=" in cut["by"]) if sensitive else (own, sure)
            start = cut.end()
        end = start + len(text[start:end].rstrip(".!?:"))
        if end - start < (SHORTEST if own is not None and not sure else SHORT):
            continue
        if NAME.search(text, start, end) and (TARGET.match(text, end) or text[start:end].startswith("-----")):
            continue
        if own is None:
            b = bisect.bisect_right(names, (start, start)) - 1
            direct = DIRECT.fullmatch(text, names[b][1], start) if b >= 0 else None
            near = [names[b]] if direct else []
            if end - start < SHORTEST and not (direct and SURE.search(direct[0])):
                continue
            if not near:
                b = bisect.bisect_right(strong, (start, start)) - 1
                near += [x for x in strong[max(b, 0) : b + 1] if start - x[1] <= WINDOW]
                a = bisect.bisect_left(strong, (end, 0))
                near += [x for x in strong[a : a + 1] if x[0] - end <= WINDOW]
            if not near:
                continue
            own = _whole(text, *near[0])
        out.append((start, end, own))
    return sorted(out)


def _strings(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the strings: URLs and queries in their parts; outside of quotes and tags strings are parted at #."""
    for m in STRING.finditer(text):
        run, at = m.group(), m.start()
        quoted = text[max(0, at - 1) : at] in ("\"", "'", "`", ">")
        last = 0
        for cut in (URL_PARTS if "://" in run else PARTS if quoted else OPEN_PARTS).finditer(run):
            if cut.start() - last >= SHORT:
                yield at + last, at + cut.start()
            last = cut.end()
        if len(run) - last >= SHORT:
            yield at + last, at + len(run)


def _whole(text: str, start: int, end: int) -> str:
    """The identifier around a sensitive name, at most 30 characters on each side of it."""
    left, right = PART.findall(text[max(0, start - 30) : start]), PART.match(text, end, end + 30)
    return (left[-1] if left and text[:start].endswith(left[-1]) else "") + text[start:end] + (right[0] if right else "")


def compressor(identifiers: str) -> zstandard.ZstdCompressor:
    data = (BUILT_IN + " " + identifiers).encode()[-DICTIONARY_BYTES - len(BUILT_IN) - 1 :]
    primed = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(z: zstandard.ZstdCompressor, around: str, value: str) -> int:
    """Bytes that the value adds to the compressed text around it."""
    context = around.encode() + b"\n"
    return len(z.compress(context + value.encode())) - len(z.compress(context))


def blanked(text: str, strings: list[tuple[int, int, str]]) -> str:
    parts, last = [], 0
    for start, end, _ in strings:
        parts += [text[last:start], " " * (end - start)]
        last = end
    return "".join(parts) + text[last:]


def found(z: zstandard.ZstdCompressor, text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, name, marginal bytes) of the secrets of a text.

    Candidates' values are blanked in the text around, else a secret that stands there twice would explain itself.
    """
    strings, out = candidates(text), []
    masked = blanked(text, strings)
    for start, end, name in strings:
        value = text[start:end]
        around = masked[max(0, start - CONTEXT) : start] + "\n" + masked[end : end + CONTEXT]
        if (extra := novelty(z, around, value)) >= NOVELTY * len(value.encode()):
            out.append((start, end, name, extra))
    return out


def identifiers(docs: DataFrame) -> str:
    """Words around sensitive names, most frequent last (cheapest to refer to); values themselves are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, 16 << 20):
            seen: Counter = Counter()
            col = b.column(0)
            for row in sensitive_rows(col):
                text = col[int(row)].as_py()
                strings = candidates(text)
                text = blanked(text, strings)
                for start, end, _ in strings:
                    around = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
                    seen.update(set(WORD.findall(around)))
            if seen:
                yield pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    words = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(DICTIONARY_BYTES // 4).collect()
    text, size = [], 0
    for r in top:
        size += len(r["word"]) + 1
        if size > DICTIONARY_BYTES:
            break
        text.append(r["word"])
    return " ".join(reversed(text))


def scan(docs: DataFrame) -> DataFrame:
    """One row a secret: doc_id, start, end, name it is assigned to, marginal bytes, novelty, and a digest in its place."""
    docs = docs.select("doc_id", "text")
    known = identifiers(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = compressor(known)
        for b in K.chunks(batches, 16 << 20):
            col, take, rows = b.column(1), [], []
            for row in sensitive_rows(col):
                text = col[int(row)].as_py()
                for start, end, name, extra in found(z, text):
                    value = text[start:end]
                    take.append(int(row))
                    rows.append((start, end, name, extra, round(extra / len(value.encode()), 6), xxhash.xxh3_128_hexdigest(value)))
            if rows:
                start, end, name, extra, nov, digest = zip(*rows)
                yield pa.record_batch(
                    [b.column(0).take(pa.array(take, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(name), pa.array(extra, pa.int32()), pa.array(nov), pa.array(digest)],
                    ["doc_id", "start", "end", "name", "marginal_bytes", "novelty", "digest"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, start int, end int, name string, marginal_bytes int, novelty double, digest string")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced by the mask; n_chars, where there is one, follows the text."""
    known = identifiers(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = compressor(known)
        for b in K.chunks(batches, 16 << 20):
            at = b.schema.get_field_index("text")
            col, new = b.column(at), {}
            for row in sensitive_rows(col):
                text = col[int(row)].as_py()
                last, parts = 0, []
                for start, end, *_ in found(z, text):
                    parts += [text[last:start], mask]
                    last = end
                if parts:
                    new[int(row)] = "".join(parts) + text[last:]
            if new:
                mask_rows = np.zeros(b.num_rows, bool)
                mask_rows[list(new)] = True
                texts = pa.compute.replace_with_mask(col, pa.array(mask_rows), pa.array([new[r] for r in sorted(new)], col.type))
                b = b.set_column(at, b.schema.field(at), texts)
                n = b.schema.get_field_index("n_chars")
                if n >= 0:
                    lengths = pa.array([len(new[r]) for r in sorted(new)], b.column(n).type)
                    b = b.set_column(n, b.schema.field(n), pa.compute.replace_with_mask(b.column(n), pa.array(mask_rows), lengths))
            yield b

    return docs.mapInArrow(run, docs.schema)
