"""Secret scan: fixed patterns, and zstandard novelty of strings in a sensitive context.

Beside the three fixed kinds, every unbroken string of 16 or more characters
that follows a sensitive word is a candidate: up to the end of its line, over
the lines of a private key's block, and over the lines below a name that ends
its line without a value. What it says that
its surroundings don't is measured by compression: a zstandard compressor is
primed with a dictionary (names that code is full of, then the text around
the candidate without the candidate), and the candidate's marginal size is
what its own bytes add to an empty frame. A name, a word or a path that the
surroundings or the dictionary already hold costs a few bytes; a random
string costs nearly its own information. Candidates whose marginal bits a
character pass the threshold are reported as kind ``novel``. A string of one
kind of letter is too short for a frame of its own to tell a word from random
letters: its marginal size is taken behind common words, names and the
surroundings in one frame, whose statistics of letters it shares.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quillmark.llm.batches import chunks, tidy

# Fixed values of the base contract: kinds in their order, least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_MIN = 8
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_MIN = 16
#: A maximal run of 32 or more: the runs of ``[0-9a-f]+`` that pass.
HEX = re.compile(rb"[0-9a-f]{32,}")

# Fixed values of the method.
SENSITIVE = re.compile(
    rb"(?i:passw(?:or)?d|passwd|pwd|secret|token|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|credential"
    rb"|auth(?:orization)?|bearer|signature|client[\x20_-]?id|connection[\x20_-]?string)")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=~-]{16,}")
#: A string of one kind of letter (one leading capital, joiners allowed), like a name or word.
WORDLIKE = re.compile(rb"[+/_=~-]*(?:[A-Z]?[a-z]+|[A-Z]+)(?:[+/_=~-]+(?:[A-Z]?[a-z]+|[A-Z]+))*[+/_=~-]*")
JOINERS = re.compile(rb"[+/_=~-]+")
#: A line that ends in a name without a value: the characters of a name, and what may open a value below it.
NAME = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-"
OPENERS = b" \t\r|>+\\\"'{[(-"
SPACES = re.compile(rb"[ \t\r]*+")
#: The line that opens a private key's block, and the lines of a block that nothing closes.
BEGIN = re.compile(rb"-----BEGIN [A-Z0-9 ]*\Z")
KEY_BLOCK = re.compile(rb"(?i:private[ _-]?key)(?: BLOCK)?-----")
KEY_LINE = re.compile(rb"[ \t]*+(?:[A-Za-z0-9-]++:[ ][^\n]*+|[A-Za-z0-9+/=]*+)[ \t\r]*+")
#: In lower case, a text without any of these has no match of the pattern: a cheap first look.
ASSIGN_STEMS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
SENSITIVE_STEMS = (b"passw", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer",
                   b"signature", b"client", b"connection")
#: Names that code and configuration are full of; primes every compressor.
IDENTIFIERS = b" ".join([
    b"password passwd secret token api_key apikey access_key private_key client_secret client_id",
    b"authorization bearer credentials username user_name email config configuration settings",
    b"environment variable default example placeholder changeme undefined null none true false",
    b"function return import export const static public private protected class interface string",
    b"integer boolean value values key keys name names path paths file files directory http https",
    b"localhost example.com www index main test tests request response session connection database",
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef"])
#: Names, common words and endings, in parts; primes the letters of strings of one kind.
LANGUAGE = (
    JOINERS.sub(b" ", IDENTIFIERS[:IDENTIFIERS.index(b"abcdefg")]),
    b"the of and to in is that for it as was with be by on not he his but at are this have from or had an "
    b"they which one you were all her she there would their we him been has when who will no more if out "
    b"so up said what its about than into them can only other time new some could these two may first then "
    b"do any like my now over such our man me even most made after also did many off before must well back "
    b"through years where much your way down should because long each just state people those how too",
    b"little good world make very year still see own work men day get here old life both between being "
    b"under three never know same last another while us might great go come since against right came take "
    b"used himself few house use place during without again home around small however found mrs part "
    b"school thought went say general once upon war every does got united left number course until always "
    b"away something fact water though less public put think almost hand enough far took head yet "
    b"government system better set told nothing night end why called find going look asked later knew "
    b"point next program city business group second",
    b"example message account service server client user data name file list item order page view model "
    b"table event option value field index query state local remote cache buffer stream thread process "
    b"worker handler manager factory builder provider controller helper util parser reader writer loader "
    b"module package version number address company tion ation ition ational able ible ing ings ment ness "
    b"less ful ously ous ive ative ity ally ence ance ent ant ist ism ize ized ise er ers ing est ed ly th "
    b"ther erable tional entation ering ingly ifying ification pre pro con com dis un in re sub trans "
    b"inter over under micro auto multi",
)
#: Bytes around a candidate that prime its compressor, on either side.
AROUND = 2048
#: Marginal bits a character from which a string counts as incompressible, and the least bytes.
MIN_BITS, MIN_BYTES = 4.0, 14
#: The same bits for strings of one kind of letter (random ones cost about 5.4, words 3 to 4.5),
#: and the orders of the words before them over which they are averaged: a frame's size is whole bytes.
LETTER_BITS, TURNS = 4.55, 4

FOUND = ("doc_id long, n_assign long, n_access long, n_hex long, n_novel long, "
         "base_sha256 string, spans string")


def marginal_bytes(candidate: bytes, around: bytes) -> int:
    """What ``candidate`` adds to an empty zstandard frame primed with the
    identifier dictionary and ``around``."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around,
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    comp = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False,
                                    write_checksum=False, write_dict_id=False)
    return len(comp.compress(candidate)) - len(comp.compress(b""))


def letter_bytes(candidate: bytes, around: bytes) -> float:
    """What the letters of ``candidate`` add to one frame of common words and
    ``around``, on average over the orders of the words."""
    # Tables for a small source; those of the level alone are 80 MB.
    comp = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(
        19, source_size=1 << 14, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False))
    letters, end = (JOINERS.sub(b" ", x.lower()) for x in (candidate, b"\n" + around + b"\n"))
    total = 0
    for k in range(TURNS):
        before = b"\n".join([*LANGUAGE[k:], *LANGUAGE[:k]]) + end
        total += len(comp.compress(before + letters)) - len(comp.compress(before))
    return total / TURNS


def is_novel(candidate: bytes, around: bytes) -> bool:
    if WORDLIKE.fullmatch(candidate):
        return 8 * letter_bytes(candidate, around) >= LETTER_BITS * len(candidate)
    n = marginal_bytes(candidate, around)
    return n >= MIN_BYTES and 8 * n >= MIN_BITS * len(candidate)


class _Contexts:
    """Where the context of each sensitive word ends, asked in the order of the text."""

    def __init__(self, text: bytes):
        self.text, self.end, self.name, self.close, self.value = text, -1, -1, -1, -1

    def line_end(self, at: int) -> int:
        end = self.text.find(b"\n", at)
        return len(self.text) if end < 0 else end

    def depth(self, start: int, end: int) -> int:
        """Leading spaces of a line; -1 if it is blank."""
        n = SPACES.match(self.text, start, end).end()
        return -1 if n == end else n - start

    def context_end(self, word: int, at: int) -> int:
        """One past the context of the sensitive word at [word, at)."""
        if self.end < at:   # a new line: where its last name begins, if that has no value
            self.end = self.line_end(at)
            rest = self.text[at:self.end].rstrip(OPENERS)
            named = rest.endswith((b":", b"="))
            self.name = at + len(rest.rstrip(b":=").rstrip(b" \t").rstrip(b"\"'])").rstrip(NAME)) if named else self.end + 1
        if KEY_BLOCK.match(self.text, word) and BEGIN.search(self.text, max(0, word - 48), word):
            return self.block_end(at)
        return self.value_end(word) if at >= self.name else self.end

    def block_end(self, at: int) -> int:
        """The block's closing line; without one, past the lines that look like a key's."""
        if self.close < at:
            close = self.text.find(b"-----END", at)
            self.close = len(self.text) + 1 if close < 0 else close
        if self.close < len(self.text) and self.text.find(b"-----BEGIN", at, self.close) < 0:
            return self.close
        end = self.end
        while end < len(self.text):
            after = self.line_end(end + 1)
            if not KEY_LINE.fullmatch(self.text, end + 1, after):
                break
            end = after
        return end

    def value_end(self, word: int) -> int:
        """Past the next line that isn't blank and the lines below it that are deeper than the name's."""
        if self.end < self.value:   # inside the lines of a value already
            return self.value
        depth, end, found = self.depth(self.text.rfind(b"\n", 0, word) + 1, self.end), self.end, False
        while end < len(self.text):
            after = self.line_end(end + 1)
            deep = self.depth(end + 1, after)
            if found and deep <= depth:
                break
            found, end = found or deep >= 0, after
        self.value = end
        return end


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns."""
    out, low = [], text.lower()
    if any(x in low for x in ASSIGN_STEMS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible strings after a sensitive word that no base span touches."""
    out, done, low = [], 0, text.lower()
    if not any(x in low for x in SENSITIVE_STEMS):
        return out
    contexts, starts, ends = _Contexts(text), [], []
    for s, _, e in base:   # joined where they overlap
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for m in SENSITIVE.finditer(text):
        stop = contexts.context_end(m.start(), m.end())
        start, done = max(m.end(), done), max(stop, done)
        # A context ends at a line's end or before the dashes of a block's: no candidate is cut.
        for c in CANDIDATE.finditer(text, start, max(start, stop)):
            k = bisect.bisect_right(ends, c.start())
            if k < len(ends) and starts[k] < c.end():
                continue
            around = text[max(0, c.start() - AROUND):c.start()] + b" " + text[c.end():c.end() + AROUND]
            around = around.replace(c.group(), b" ")   # a secret written twice doesn't vouch for itself
            if is_novel(c.group(), around):
                out.append((c.start(), 3, c.end()))
    return out


def scan(text: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base and novel spans of a UTF-8 text, in code points: (start, kind, end)."""
    base = base_spans(text)
    novel = novel_spans(text, base)
    if not base and not novel:
        return base, novel
    if text.isascii():
        return base, novel
    # Code points before a byte position, counted once in order.
    marks = sorted({p for s, _, e in (*base, *novel) for p in (s, e)})
    at, before, points = 0, 0, {}
    for p in marks:
        before += len(text[at:p].decode("utf-8", "replace"))
        points[p], at = before, p
    moved = [[(points[s], k, points[e]) for s, k, e in spans] for spans in (base, novel)]
    return moved[0], moved[1]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            counts = [[] for _ in KINDS]
            shas, spans = [], []
            for i in range(part.n):
                base, novel = scan(part.text(i))
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in (*base, *novel)))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined([*base, *novel]))
            ids = batch.column(0).slice(part.row, part.n)
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()),
                 pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): counts by kind, the
    digest of the base spans, and all spans ``kind:start:end`` in code points.

    Spans are ordered by start, then kind. Null and empty texts have no spans
    (empty string, digest of nothing). Equal rows give equal rows; an empty
    table gives none; other columns are not read. A base span is never
    dropped; a novel span never touches a base one. Nothing is shuffled.
    """
    return docs.select("doc_id", "text").mapInArrow(tidy(_scan), FOUND)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without its secrets: every found span is replaced by ``[kind]``
    (``n_chars`` counted anew where a text changed). No row goes."""
    schema = docs.schema
    names = docs.columns

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            counts = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i, text in enumerate(texts):
                if not text:
                    continue
                base, novel = scan(text.encode())
                out, at = [], 0
                for s, k, e in sorted([*base, *novel]):
                    if e <= at:
                        continue
                    out += [text[at:max(at, s)], f"[{KINDS[k]}]" if s >= at else ""]
                    at = e
                if out:
                    texts[i] = "".join(out) + text[at:]
                    if counts is not None:
                        counts[i] = len(texts[i])
            cols = list(batch.columns)
            cols[names.index("text")] = pa.array(texts, pa.string())
            if counts is not None:
                cols[names.index("n_chars")] = pa.array(counts, batch.column(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(tidy(redact), schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    from quillmark.llm.tables import documents
    return find_secrets(documents(spark, sf_dir))
