"""Secrets in texts: fixed patterns, and strings that a primed compressor finds novel."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import BLANKS, text_or_empty

#: Fixed patterns, with the characters that the match, or its second group, needs.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

_SENSITIVE = (
    r"""(?:key|keys|secret|secrets|token|tokens|pass|passwd|password|passphrase|pwd|auth"""
    r"""|authorization|bearer|basic|credential|credentials|cred|creds|private|access|session"""
    r"""|cookie|signature|sig|salt|seed|webhook|connection|jwt)"""
)
#: Words that end right before a string and make it sensitive; between a name and its value the name
#: of a type may stand.
CONTEXT = re.compile(
    _SENSITIVE + r"""[\w"'\])}]*"""
    r"""(?:[\s:=>|"'(\[{,-]*|\s*:\s*[\w.&*<>\[\], |?]{1,40}=[\s"'(\[{]*)$""",
    re.IGNORECASE | re.ASCII,
)
#: What may stand between two lines of one block, beside a line break: quotes and marks of joining or comment.
LINE_MARKS = BLANKS + "\"'`,;+|()#*>/\\"
#: Headings between which all strings are sensitive; one without an end runs to the text's end and is left out.
BLOCK = re.compile(
    r"-----?\x20?BEGIN [A-Z0-9 ]{0,64}?(?:KEY|SECRET|TOKEN)[A-Z0-9 ]{0,64}-----?(.*?)(?:-----?\x20?END |\Z)", re.DOTALL
)
#: Strings that may be secrets: long enough, of the letters that keys are written in.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")

#: Identifiers that code is full of; with the text around a candidate they prime the compressor.
IDENTIFIERS = (
    "access_token refresh_token client_secret client_id api_key apikey authorization bearer "
    "password username user_name session_id request_id account_id private_key public_key "
    "certificate signature credentials connection_string database_url localhost example.com "
    "https://www. http:// .json .html .org .com Content-Type application/json charset=utf-8 "
    "import export return function class const static public private protected void string "
    "include require module package version license copyright configuration environment "
    "production development default index length value values parameter parameters argument "
    "get_value set_value to_string from_string get_name create_user update_user delete_user "
    "AbstractFactory BeanFactory ControllerTest ServiceImpl HttpRequest HttpResponse "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 abcdef012345"
)


@dataclass(frozen=True)
class Novelty:
    """When a string is reported: bytes that it adds to its compressed surroundings, for each of its
    characters, and how far the surroundings reach."""

    least: float = 0.62
    around: int = 256
    before: int = 48
    longest: int = 4096


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, in code points."""
    found = []
    # a long enough value cannot be missed by the quick looks before each scan
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 or more is found at its first character, so it is the whole run
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def next_line(text: str, end: int, start: int) -> bool:
    """Whether a string stands on the line after another, in plain text or in a quoted one."""
    gap = text[end:start]
    if gap == "\\":
        return text[start] in "nr"
    if "\\" in gap:
        gap = gap.replace("\\r", "").replace("\\n", "\n")
    return "\n" in gap and not gap.strip(LINE_MARKS)


class NovelStrings:
    """Marginal compressed size of candidates, measured against identifiers and nearby text."""

    def __init__(self, settings: Novelty) -> None:
        self.settings = settings
        self.primer = zstandard.ZstdCompressionDict(
            IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        self.compressor = zstandard.ZstdCompressor(
            level=3, dict_data=self.primer, write_content_size=False, write_checksum=False
        )

    def size(self, data: bytes) -> int:
        return len(self.compressor.compress(data))

    def novelty(self, text: str, start: int, end: int) -> float:
        """Bytes that the string adds to its surroundings, for each of its characters."""
        around = self.settings.around
        near = text[max(0, start - around) : start] + text[end : end + around]
        context = near.encode("utf-8", "replace")
        candidate = text[start:end].encode("utf-8", "replace")
        return (self.size(context + b"\n" + candidate) - self.size(context + b"\n")) / len(candidate)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        blocks = []
        if "BEGIN " in text:
            blocks = [m.span(1) for m in BLOCK.finditer(text) if m.end(1) < len(text)]
        at, carried = 0, -1  # the block that may hold the next string; where a sensitive line ended
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            string = m.group()
            while at < len(blocks) and blocks[at][1] <= start:
                at += 1
            sensitive = (
                (at < len(blocks) and blocks[at][0] <= start)
                or (carried >= 0 and next_line(text, carried, start))
                or CONTEXT.search(text[max(0, start - self.settings.before) : start]) is not None
            )
            carried = end if sensitive else -1
            kinds = (
                any(c.isdigit() for c in string)
                + any(c.isupper() for c in string)
                + any(c.islower() for c in string)
            )
            if kinds < 2 or len(set(string)) < 8:
                continue
            if not sensitive:
                continue
            # a very long string is measured in parts, and reported whole if any part is novel
            step = self.settings.longest
            if any(
                self.novelty(text, a, min(a + step, end)) >= self.settings.least
                for a in range(start, end, step)
            ):
                found.append((start, 3, end))
        return found


def secret_spans(text: str, novel: NovelStrings) -> list[tuple[int, int, int]]:
    """Base spans, and novel ones that do not lie inside a base span."""
    base = base_spans(text)
    added = [
        (s, k, e)
        for s, k, e in novel.spans(text)
        if not any(a <= s and e <= b for a, _, b in base)
    ]
    return sorted(base + added)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Novelty = Novelty(),
) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs``; a span is ``kind, start, end``.

    Places are code points, the end exclusive. Spans are sorted by start, then by the order of
    ``KINDS``. A NULL or empty text has none. Whole texts are read, one row at a time, and
    nothing is shuffled.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novel = NovelStrings(settings)
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in secret_spans(t.as_py(), novel)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, span)], ["doc_id", "spans"]
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    ).mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[dict], mark: str = "[SECRET]") -> str:
    """A text with its spans replaced; overlapping ones become one mark."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: s["start"]):
        if span["end"] <= at:
            continue
        if span["start"] >= at:
            out += [text[at : span["start"]], mark]
        at = span["end"]
    return "".join([*out, text[at:]])
