"""Byte-level BPE encoding and decoding.

A word is the ids of its bytes, and the ranks of its neighbouring pairs. Many
words are folded at once in numpy: each step takes every word's pair of lowest rank
(the first of equals), puts the merged token in its place and looks up the two
pairs it now makes; a word is done when no pair has a rank. Ranks come from a
table of every way to split a token of the vocabulary into two others, hashed into a
flat array so that a lookup reads two places.

Only distinct words are folded. The words of the corpus are counted; the most
frequent ones (at most ``HOT_WORDS``, a bound at any size) are folded once for
all and sent to the tasks. Every other word is folded once in the task that
meets it: a chunk's texts are split and words named by numbers, the words that the
task has not met before are folded, and the ids put in the numbers' places. A task remembers at most ``TASK_WORDS`` words, then it starts
afresh. What is remembered changes no result, and no text is shuffled.

Decoding looks up every id's piece of bytes and concatenates the pieces, in numpy.
"""

from __future__ import annotations

import base64
import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.batches import tidy
from quillmark.llm.tables import documents, staged

#: Words folded once for the whole corpus, at most, and their length in bytes, at most.
HOT_WORDS, HOT_BYTES = 1 << 17, 48
#: Other words that a task remembers.
TASK_WORDS = 1 << 17
#: Characters of text and documents of a chunk, at most (a longer text is a chunk of its own).
CHUNK_CHARS, CHUNK_DOCS = 1 << 20, 1 << 13
#: Bytes of a batch that Spark sends to Python, at most (a chunk or a longer text is a batch of its own).
BATCH_BYTES = 8 << 20
#: Classes of word counts in each doubling, from which the least count of a hot word is chosen.
STEPS = 16
#: Places of the table of pairs; a power of two.
PAIR_PLACES = 1 << 18
#: Two places of a pair are two parts of one product (pairs are under 2**32, so it fits 63 bits).
SPREAD, SHIFTS = 2_654_435_761, (11, 30)
#: No merge: more than any rank. A place of the table of pairs holds ``pair * NONE + rank``.
NONE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (the id) of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def two_choices(entries: dict[int, object], places) -> dict[int, int]:
    """A place for every key, one of its two (``places(key)``): cuckoo hashing,
    so that a lookup reads two places. Keys that find none are left out."""
    at: dict[int, int] = {}
    for key in entries:
        place = places(key)[0]
        for _ in range(500):
            key, at[place] = at.get(place), key
            if key is None:
                break
            one, two = places(key)
            place = two if place == one else one
    return at


class Codec:
    """The tables of one vocabulary and the operators over them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.pattern = pattern
        self.end = max(ranks.values()) + 1      # a token that merges with nothing
        self.size = self.end + 1
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        table = [2 ** 62] * PAIR_PLACES
        at = two_choices(pairs, lambda key: tuple(key * SPREAD >> k & PAIR_PLACES - 1 for k in SHIFTS))
        if len(at) < len(pairs):
            raise ValueError("PAIR_PLACES is too small for this vocabulary")
        for place, key in at.items():
            table[place] = key * NONE + pairs[key]
        self.pieces = [b""] * self.end
        for token, rank in ranks.items():
            self.pieces[rank] = token
        #: Ids of single bytes, and the table of pairs.
        self.tables = np.array([ranks[bytes([b])] for b in range(256)]), np.array(table)

    def hot(self, docs: DataFrame, text: str = "text") -> pa.Table:
        """``word, ids`` of the most frequent words of a corpus (at most HOT_WORDS).

        The least count comes from the numbers of words in classes of counts,
        so no words are sorted.
        """
        counts = staged(
            docs.select(F.col(text).alias("text")).mapInArrow(
                tidy(word_counts(self.pattern, TASK_WORDS)), "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n"))
            .where("n > 1"), "word-counts")
        step = F.floor(F.log2("n") * STEPS)
        least, words = math.inf, 0
        for row in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
            words += row.words
            if words > HOT_WORDS:
                break
            least = row.step
        known = docs.sparkSession.sparkContext.broadcast(self.tables)
        size = self.size

        def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column(0)
                yield pa.RecordBatch.from_arrays([words, folded_words(words.to_pylist(), *known.value, size)], ["word", "ids"])
        return counts.where(step >= F.lit(least)).select("word").mapInArrow(tidy(folded), "word string, ids array<int>").toArrow()

    def encode(self, docs: DataFrame, hot: pa.Table, text: str = "text") -> DataFrame:
        """``doc_id, ids, packed`` of every row; ``hot`` from ``hot``."""
        name = docs.schema["doc_id"].dataType.simpleString()
        context = docs.sparkSession.sparkContext
        known, tables, size = context.broadcast(hot), context.broadcast(self.tables), self.size
        numbered = numbered_words(self.pattern, known, TASK_WORDS, CHUNK_CHARS, lambda words: folded_words(words, *tables.value, size))
        restored = ids_of_numbers(known)
        return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
            tidy(lambda batches: restored(numbered(batches))), f"doc_id {name}, ids array<int>, packed binary")

    def decode(self, rows: DataFrame, ids: str = "ids") -> DataFrame:
        """``rows`` with the bytes of their ids as a binary column ``decoded``: the ids' pieces one after the other."""
        schema = T.StructType([*rows.schema, T.StructField("decoded", T.BinaryType())])
        return rows.mapInArrow(tidy(bytes_of_ids(rows.sparkSession.sparkContext.broadcast(self.pieces), ids)), schema)


def word_counts(pattern: str, most: int):
    """A function for ``mapInArrow``: ``word, n`` of texts, in tables of bounded size."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = regex.compile(pattern).findall, Counter()

        def table() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.string())
            rows = pa.RecordBatch.from_pydict({"word": words, "n": pa.array(list(counts.values()), pa.int64())})
            return rows.filter(pc.less_equal(pc.binary_length(words), HOT_BYTES))
        for batch in batches:
            for text in batch.column(0):
                counts.update(split(text.as_py() or ""))
                if len(counts) > most:
                    yield table()
                    counts.clear()
        yield table()
    return counted


class Numbers(dict):
    """Numbers of words in the order in which they are met; ``new`` has those met since it was emptied."""

    def __init__(self, words: list[str]):
        super().__init__(zip(words, range(len(words))))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def numbered_words(pattern: str, hot, task_words: int, chunk_chars: int, fold):
    """Chunks of documents as numbers of words, with the ids (``fold``) of the words that
    are new to the task. ``afresh``: all but the hot words were forgotten before."""
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, words = regex.compile(pattern).findall, hot.value["word"].to_pylist()
        numbers, afresh = Numbers(words), True
        names, sizes, parts, chars = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([names], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([b"".join(parts)], pa.binary()), one_row(fold(numbers.new)),
                pa.array([afresh])], ["doc_id", "sizes", "numbers", "words", "afresh"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if names and (chars + len(text) > chunk_chars or len(names) == CHUNK_DOCS):
                    yield chunk()
                    numbers.new, afresh = [], False
                    names, sizes, parts, chars = [], [], [], 0
                    if len(numbers) > len(words) + task_words:
                        numbers, afresh = Numbers(words), True
                found = np.array(list(map(numbers.__getitem__, split(text))), "<u4")
                names.append(name)
                sizes.append(len(found))
                parts.append(found.tobytes())
                chars += len(text)
        if names:
            yield chunk()
    return numbered


def one_row(lists: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists)


def pair_ranks(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Ranks of pairs ``a * size + b``; NONE or more for those that don't merge."""
    # A place that holds the pair leaves its rank, every other place more.
    places = [table[keys * SPREAD >> k & PAIR_PLACES - 1] ^ keys * NONE for k in SHIFTS]
    return np.minimum(np.minimum(*places), NONE)


def folded_words(words: list[str], byte_ids: np.ndarray, table: np.ndarray, size: int) -> pa.Array:
    """Ids of each word by ranked merges, all words a step at a time."""
    coded = [w.encode() for w in words]
    sizes = np.array(list(map(len, coded)), np.int64)
    done = np.zeros(len(words), np.int64)
    pieces = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]   # words, ids
    word = np.flatnonzero(sizes)
    sizes = sizes[word]
    p = byte_ids[np.frombuffer(b"".join(coded), np.uint8)].astype(np.int64)
    r = np.full(len(p), NONE)   # r[i] is the rank of tokens i and i + 1, NONE at a word's end
    r[:-1] = pair_ranks(table, p[:-1] * size + p[1:])
    r[np.cumsum(sizes) - 1] = NONE
    while len(word):
        starts = np.cumsum(sizes) - sizes
        least = np.minimum.reduceat(r, starts)
        open_ = least < NONE
        if not open_.all():
            at = np.repeat(open_, sizes)
            pieces.append((np.repeat(word[~open_], sizes[~open_]), p[~at]))
            done[word[~open_]] = sizes[~open_]
            word, sizes, least, p, r = word[open_], sizes[open_], least[open_], p[at], r[at]
            if not len(word):
                break
            starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(word)), sizes)
        at = np.flatnonzero(r == least[owner])
        at = at[np.append(True, owner[at][1:] != owner[at][:-1])]   # the first of equals
        p[at] = least
        keep = np.ones(len(p), bool)
        keep[at + 1] = False
        p, owner = p[keep], owner[keep]
        left = r[keep]
        at = at - np.arange(len(at))
        sizes = sizes - 1
        last = np.cumsum(sizes) - 1
        inner = at < last
        left[at] = NONE
        i = at[inner]
        left[i] = pair_ranks(table, p[i] * size + p[i + 1])
        i = at[at > last - sizes + 1] - 1
        left[i] = pair_ranks(table, p[i] * size + p[i + 1])
        r = left
    of, ids = (np.concatenate(x) for x in zip(*pieces, strict=True))
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(done)).astype(np.int32), pa.array(ids[np.argsort(of, kind="stable")].astype(np.int32)))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of an array of lists."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.diff(lists.offsets.to_numpy())


def ids_of_numbers(hot):
    """Ids of every document of the chunks of ``numbered_words``,
    whose new words are folded. A task's chunks come in their order."""
    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = flat(hot.value["ids"].combine_chunks())
        ids, sizes = first
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                name, counts, numbers, new, afresh = (row.column(i) for i in range(5))
                if afresh[0].as_py():
                    ids, sizes = first
                more = flat(new.flatten())
                ids, sizes = np.concatenate([ids, more[0]]), np.concatenate([sizes, more[1]])
                numbers = np.frombuffer(numbers[0].as_buffer(), "<u4")
                out, ends = taken(ids, sizes, numbers)
                # Where each document's words, and with them its ids, end.
                at = ends[np.concatenate([[0], np.cumsum(counts.flatten().to_numpy())])]
                yield pa.RecordBatch.from_arrays([
                    name.flatten(), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(out.astype(np.int32))),
                    binaries(out, at * 4)], ["doc_id", "ids", "packed"])
    return restored


def taken(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of flat lists, one after the other, and where each ends (0 first)."""
    lengths = sizes[which]
    ends = np.cumsum(lengths)
    starts = (np.cumsum(sizes) - sizes)[which]
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], np.concatenate([[0], ends])


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` between the byte positions ``bounds``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def bytes_of_ids(pieces, column: str):
    """A function for ``mapInArrow``: rows with the concatenated pieces of their ids."""
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.frombuffer(b"".join(pieces.value), np.uint8)
        sizes = np.array([len(piece) for piece in pieces.value])
        for batch in batches:
            # Rows of at most CHUNK_CHARS ids at once, one at least.
            first, lengths = 0, np.diff(batch.column(column).offsets.to_numpy())
            while first < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(lengths[first:]), CHUNK_CHARS)))
                rows = batch.slice(first, n)
                out, ends = taken(values, sizes, rows.column(column).flatten().to_numpy())
                at = ends[np.concatenate([[0], np.cumsum(lengths[first:first + n])])]
                yield rows.append_column("decoded", binaries(out, at))
                first += n
    return decoded


def codec(name: str = "byte_bpe_50k.tiktoken") -> Codec:
    return Codec(read_ranks(public_tokenizers.path(name)))


def encoded(docs: DataFrame, bpe: Codec | None = None) -> DataFrame:
    """``doc_id, ids, packed`` of every row of ``docs``; ``packed`` has the ids as
    little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Equal rows give equal rows; an empty
    table gives none; other columns are not read. One unbroken word is folded
    in one task, in time that grows with the square of its length.
    """
    bpe = bpe or codec()
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return bpe.encode(docs, bpe.hot(docs))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    bpe = codec()
    return bpe.decode(encoded(documents(spark, sf_dir), bpe)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
