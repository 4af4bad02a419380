"""Token ids by the tokenizers library, and files of bit-packed ids.

Encoding: byte-level pre-tokenization never joins what stands on the two sides of a single space or
line feed between other characters, nor letters and the punctuation after them. So a text is the
sum of such parts; each distinct one goes through the library once, and its ids are kept for later
texts of the worker.

File format: a table in which every row is a block of whole documents: the ids of its documents and
their counts, and all token ids at the fewest bits that hold the vocabulary, packed little-endian
one after the other. A document's ids start at `bits * (sum of the counts before it)`, so any range
is read without the rest, and a block is unpacked by one vectorised pass.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulith.llm import _spark

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Ids after which a block of the files is closed; a longer document has a block of its own.
BLOCK_IDS = 1 << 16
#: Bytes up to which the shards' sizes, a row for each file, are broadcast.
BROADCAST_BYTES = 16 << 20
#: Parts that a worker keeps; twice as many at most.
KEPT_CHUNKS = 800_000

#: White space, and the mark of what is irregular.
_ODD = re.compile(r"[\s\0]")
#: ASCII digits and punctuation: what may follow the letters of a part.
_TAIL = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalpha())


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """The public vocabulary file of that name, or the path itself where it is one."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def parts_of(text: str) -> list[str]:
    """The text in parts that encode independently of each other, whatever white space it holds.

    A part is what follows a single space, or a single line feed and what follows it (so begins the
    first part, whose line feed is not of the text), or after a zero byte something irregular.
    """
    out, held = ["\n"], ""
    for k, part in enumerate(text.split(" ")):
        if k and held and not held[-1].isspace() and part and not part[0].isspace():
            out.append(held)
            held = " " + part
        else:
            held += " " * (k > 0) + part
    out.append(held)
    return ["\n", *[c[1:] if c[0] == " " and _ODD.search(c, 1) is None and len(c) > 1 else "\0" + c for c in out[1:] if c]]


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers in bytes.

    What a part encodes to is kept for later texts, also what its letters and the rest of it do; both
    are forgotten by generations. units() encodes what was not there, of many texts in one call.
    """

    most = KEPT_CHUNKS

    def __init__(self) -> None:
        self.parts: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.kept: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.feed = self.units(["\0\n"])[0]

    def units(self, units: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _aged(self, pair: tuple[dict, dict]) -> tuple[dict, dict]:
        return ({}, pair[0]) if len(pair[0]) > self.most else pair

    def _learned(self, parts: Iterable[str]) -> set[str]:
        """Keep what distinct parts encode to; returned are those that are none: empty, or with white space of their own.

        Letters and the punctuation after them are units of their own."""
        (new, old), (kept, before), feed = self.parts, self.kept, self.feed
        odd: set[str] = set()
        whole: list[tuple[str, str]] = []
        cut: list[tuple[str, str, str]] = []
        lacking: dict[str, None] = {}
        for part in parts:
            got = old.get(part)
            if got is not None:
                new[part] = got
                continue
            line = part[:1] == "\n"
            body = part[1:] if line else part
            stem = body.rstrip(_TAIL)
            tail = body[len(stem) :]
            if tail and stem.isalpha():
                own = stem if line else " " + stem
                cut.append((part, own, tail))
                if tail not in kept:
                    lacking[tail] = None
            elif part[:1] == "\0":
                own = part
                whole.append((part, part))
            elif not body or _ODD.search(body):
                odd.add(part)
                continue
            else:
                own = body if line else " " + body
                whole.append((part, own))
            if own not in kept:
                lacking[own] = None
        fresh = []
        for unit in lacking:
            got = before.get(unit)
            if got is None:
                fresh.append(unit)
            else:
                kept[unit] = got
        if fresh:
            kept.update(zip(fresh, self.units(fresh), strict=True))
        for part, own in whole:
            new[part] = feed + kept[own] if part[0] == "\n" else kept[own]
        for part, own, tail in cut:
            got = kept[own] + kept[tail]
            new[part] = feed + got if part[0] == "\n" else got
        return odd

    def _joined(self, split: list[list[str]]) -> tuple[list[bytes], list[int]]:
        """The ids of texts in parts, and the numbers of those that hold a part which is none."""
        new = self.parts[0]
        every = [list(map(new.get, parts)) for parts in split]
        open_ = {k: [i for i, x in enumerate(ids) if x is None] for k, ids in enumerate(every) if not all(ids)}
        fresh = dict.fromkeys(split[k][i] for k, at in open_.items() for i in at)
        odd = self._learned(fresh) if fresh else set()
        for k, at in open_.items():
            for i in at:
                every[k][i] = new.get(split[k][i], b"")
        skip = len(self.feed)
        return [b"".join(ids)[skip:] for ids in every], [k for k, at in open_.items() if odd and any(split[k][i] in odd for i in at)]

    def encode(self, texts: list[str]) -> list[bytes]:
        self.parts, self.kept = self._aged(self.parts), self._aged(self.kept)
        out, again = self._joined([("\n" + t).replace("\n", " \n")[1:].split(" ") if t and "\0" not in t else [] for t in texts])
        again += [k for k, t in enumerate(texts) if "\0" in t]
        if again:  # with other white space than single spaces and line feeds
            self.parts[0]["\n"] = self.feed
            for k, ids in zip(again, self._joined([parts_of(texts[k]) for k in again])[0], strict=True):
                out[k] = ids
            del self.parts[0]["\n"]
        return out


class Known(dict[str, bytes]):
    """What parts encode to: of one generation, from the one before it, or by first() once a part is asked for.

    A part for which first() has None is not kept; it sets odd.
    """

    def __init__(self, first: Callable[[str], bytes | None], before: dict[str, bytes]):
        super().__init__()
        self.first, self.before, self.odd = first, before, False

    def __missing__(self, part: str) -> bytes:
        got = self.before.get(part)
        if got is None:
            got = self.first(part)
            if got is None:
                self.odd = True
                return b""
        self[part] = got
        return got


class LibraryEncoder:
    """The same by the tokenizers library: its model gets words of letters as they are, its whole pipeline all other parts.

    A word, with the space before it, is one piece to the byte-level pre-tokenizer, so the model's tokens are its
    encoding. A part of letters and the punctuation after them is the sum of both.
    """

    most = KEPT_CHUNKS

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        about = json.loads(self.tokenizer.to_str())
        before = about.get("pre_tokenizer") or {}
        self.plain = about.get("normalizer") is not None or (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != ("ByteLevel", False, True)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bits = max(1, max(vocabulary.values()).bit_length())
        # an added token could stand in a word, or reach from it into what follows
        self.by_words = not any(t["content"][:1].isalpha() or t["content"][:1].isspace() for t in about.get("added_tokens") or [])
        self.letters = {c for c in map(chr, range(0x10000)) if c.isalpha() and unicodedata.ucd_3_2_0.category(c)[0] == "L"}
        self.shown = {b: c for c, b in byte_letters().items()}
        self.tokenize = self.tokenizer.model.tokenize
        if not self.plain:
            self.feed = self._ids(["\n"])[0]
            self.known = Known(self._first, {})

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _first(self, part: str) -> bytes | None:
        """What a part encodes to; None if it is none: empty, or with white space of its own."""
        line = part[:1] == "\n"
        body = part[1:] if line else part
        stem = body.rstrip(_TAIL)
        # letters of an old Unicode version, which are letters to the library too
        if self.by_words and stem.isalpha() and (stem.isascii() or self.letters.issuperset(stem)):
            if len(stem) < len(body):
                return self.known[part[: len(stem) - len(body)]] + self.known["\0" + body[len(stem) :]]
            word = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.shown)
            ids = [t.id for t in self.tokenize(word if line else "\u0120" + word)]
            got = struct.pack(f"<{len(ids)}I", *ids)
            return self.feed + got if line else got
        if part[:1] == "\0":
            return self._ids([part[1:]])[0]
        if not body or _ODD.search(body):
            return None
        return self.feed + self._ids([body])[0] if line else self._ids([" " + body])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.plain:
            return self._ids(texts)
        if len(self.known) > self.most:
            self.known.before = {}
            self.known = Known(self._first, self.known)
        known, skip, out = self.known, len(self.feed), []
        ids_of = known.__getitem__
        for text in texts:
            known.odd = "\0" in text
            ids = b"".join(map(ids_of, ("\n" + text).replace("\n", " \n")[1:].split(" "))) if text and not known.odd else b""
            if known.odd:  # with other white space than single spaces and line feeds
                known["\n"] = self.feed
                ids = b"".join(map(ids_of, parts_of(text)))
                del known["\n"]
            out.append(ids[skip:])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def text_groups(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows with about limit characters of text together; null is empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        k = 0
        while k < len(texts):
            end, size = k, 0
            while end < len(texts) and (end == k or size + len(texts[end]) <= limit):
                size += len(texts[end])
                end += 1
            yield batch.slice(k, end - k), texts[k:end]
            k = end


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Unsigned ids at a fixed width, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """count ids from the start-th on, without touching the bytes of the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count, start * bits // 8).astype("<u4")
    low, high = start * bits, (start + count) * bits
    flags = np.unpackbits(np.frombuffer(raw, np.uint8, -(-high // 8) - low // 8, low // 8), bitorder="little")[low % 8 :][: count * bits]
    out = np.zeros(count, np.uint64)
    for k, plane in enumerate(flags.reshape(count, bits).T):
        out |= plane.astype(np.uint64) << np.uint64(k)
    return out.astype("<u4")


FILE_SCHEMA = "shard int, block int, start long, bits int, n_ids long, first_doc long, last_doc long, docs binary, counts binary, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 0) -> None:
    """Write the ids of docs (doc_id, text), each text's ids and then end_id, in ascending doc_id.

    Whole texts are encoded; a null text is empty and has the end id alone. Equal doc_ids stand side
    by side; rows with a null doc_id come first. An empty table makes files without blocks. Shards are
    ranges of doc_id, numbered in order; start is the place of a block's first id in its shard.
    """
    spark = docs.sparkSession
    where = tokenizer_path(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(where)
        bits, end = enc.bits, np.array([end_id], "<u4").tobytes()
        start, block, held, size = 0, 0, [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            doc = pa.array([d for d, _ in held], pa.int64())
            missing = np.asarray(doc.is_null())
            marks = np.asarray(doc.fill_null(0)).astype("<i8").tobytes() + np.packbits(missing).tobytes()
            counts = np.array([len(x) // 4 for _, x in held], "<u8").tobytes()
            known = doc.drop_null()
            ends = (known[0].as_py(), known[-1].as_py()) if len(known) else (None, None)
            row = [shard, block, start, bits, len(ids), *ends, marks, counts, pack_bits(ids, bits)]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 3]
        names = [f.split()[0] for f in FILE_SCHEMA.split(", ")]
        for part, texts in text_groups(batches, "text"):
            for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= BLOCK_IDS:
                    yield close()
                    start, block, held, size = start + size, block + 1, [], 0
        if held:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(_spark.partitions(spark), _spark.plan_bytes(docs) // (32 << 20))
    ordered = ordered.repartitionByRange(int(n), "doc_id").sortWithinPartitions("doc_id")
    _spark.arrow_map(ordered, encode, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def block_documents(docs: bytes, counts: bytes) -> tuple[list[int | None], np.ndarray]:
    """A block's doc_ids and their counts of ids."""
    n = len(counts) // 8
    missing = np.unpackbits(np.frombuffer(docs, np.uint8, offset=8 * n), count=n).astype(bool)
    return pa.array(np.frombuffer(docs, "<i8", n), mask=missing).to_pylist(), np.frombuffer(counts, "<u8").astype(np.int64)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document: ids as little-endian unsigned 32-bit integers.

    start counts the ids of all documents before it. Only one row a shard is summed up for it.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    few = len(files.inputFiles()) < BROADCAST_BYTES // 64
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc, counts = block_documents(row["docs"], row["counts"])
                ids = unpack_bits(row["payload"], row["bits"], 0, row["n_ids"]).tobytes()
                at = np.concatenate(([0], np.cumsum(counts)))
                parts = [ids[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(row["base"] + row["start"] + at[:-1]), pa.array(counts), pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    placed = files.join(F.broadcast(before) if few else before, "shard")  # a row for each file
    return _spark.arrow_map(placed, unpack, "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """Random access: the ids of one document (the first of that id), from its block alone.

    Blocks are in the order of their ids, so that the statistics of first_doc and last_doc prune files and row groups;
    of the blocks left, docs and counts are read, and the payload of the one that holds the document.
    """
    near = spark.read.schema(FILE_SCHEMA).parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    for found in near.select("shard", "block", "docs", "counts").orderBy("shard", "block").toLocalIterator():
        doc, counts = block_documents(bytes(found.docs), bytes(found.counts))
        if doc_id in doc:
            k = doc.index(doc_id)
            row = near.where((F.col("shard") == found.shard) & (F.col("block") == found.block)).select("bits", "payload").first()
            return unpack_bits(bytes(row.payload), row.bits, int(counts[:k].sum()), int(counts[k]))
    return None


def with_crc(files: DataFrame) -> DataFrame:
    """ids_crc32 in place of the ids: unsigned, over their little-endian 32-bit bytes."""
    return files.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
