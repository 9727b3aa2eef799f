"""Token sequences as length-delimited binary records with an offset index.

A record file is a run of frames: unsigned 64-bit length of the payload, masked
CRC-32 of those eight bytes, payload, masked CRC-32 of the payload; all little
endian. A payload is one byte with the width of an id (2 or 4) and the zstd
compressed ids. The index is a Parquet table with one row per sequence: file,
offset and length of its frame, number of tokens. A reader needs no other frame
to read one, so sequences can be read in any order.

Files are written by the tasks of one ordered pass. Each attempt writes files of
its own name and the index names those of the attempts that Spark committed, so
lost executors and repeated tasks leave at most files no one refers to. The
folder must be a location that all executors reach through ``pyarrow.fs``.

Defined results: null and empty texts are just the end id; rows are in ascending
order of id, nulls first, then of text; repeated rows are separate sequences.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from codequarry.llm import kernels

FILE_BYTES = 256 << 20
CACHE_WORDS, CACHE_STEMS = 300_000, 800_000
#: Text whose different words are encoded together.
_ENCODE_SLICE = 4 << 20

_LENGTH, _CHECK = struct.Struct("<Q"), struct.Struct("<I")
#: Marks that end a word and never join letters in the tokenizer's split pattern.
_TAIL = ".,;:!?#$%&*"
#: Letters for which lower case and composition are the same in any order: Latin without the dotted capital I.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-įı-ſ]+"
#: The byte-level alphabet: printable Latin-1 stands for itself, the other bytes are counted on from 256.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = dict.fromkeys(range(256)) | {b: b for b in _PRINTABLE}
_BYTE_CHARS |= {b: 256 + k for k, b in enumerate(b for b in range(256) if _BYTE_CHARS[b] is None)}

#: Fixed values of a tokenizer file: the normalizer and pre-tokenizer that let words be encoded on their own.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted, so that checksums of data that holds checksums stay sound."""
    check = zlib.crc32(data)
    return (((check >> 15) | (check << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CHECK.pack(masked(length)), payload, _CHECK.pack(masked(payload))))


def unframe(data: bytes) -> bytes:
    """Payload of one whole frame; raises if a length or checksum is wrong."""
    payload = data[12:-4]
    good = (
        len(data) >= 16 and _LENGTH.unpack(data[:8])[0] == len(payload)
        and _CHECK.unpack(data[8:12])[0] == masked(data[:8]) and _CHECK.unpack(data[-4:])[0] == masked(payload)
    )
    if not good:
        raise ValueError("damaged record")
    return payload


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and folder.startswith("file:"):
        folder = f"file://{folder[5:]}"
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


class WordEncoder:
    """Ids of texts by the tokenizers library, with the ids of words kept.

    Where the file's normalizer and pre-tokenizer are the known ones, which never
    join across spaces or line feeds, the different words of a list of texts are
    encoded, and a word of letters and closing marks is two pieces to the
    tokenizer. By any other file texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        self.by_word = all(given.get(part) == known for part, known in _BY_WORD.items()) and not any(
            token["lstrip"] or token["rstrip"] or re.search(r"\s", token["content"]) for token in given.get("added_tokens") or [])
        self.width = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of lower-case letters that are one piece each to the tokenizer."""
        if len(self.stems) > CACHE_STEMS:
            self.stems = {}
        known, tokenize, kind = self.stems, self.model.tokenize, self.width.char
        for stem in stems:
            if stem not in known:
                piece = stem if stem.isascii() else stem.encode().decode("latin-1").translate(_BYTE_CHARS)
                known[stem] = array(kind, [t.id for t in tokenize(piece)]).tobytes()
        return [known[stem] for stem in stems]

    def _others(self, words: list[str]) -> list[bytes]:
        """Ids of words of any kind."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        missing = [word for word in words if word not in self.known]
        encoded = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
        self.known.update((word, np.array(e.ids, self.width).tobytes()) for word, e in zip(missing, encoded, strict=True))
        return [self.known[word] for word in words]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one word after the other, and the bounds of the words."""
        stems = pc.utf8_rtrim(words, characters=_TAIL)
        plain = pc.match_substring_regex(stems, f"^{_LETTERS}$")
        stems, places = _encoded(pc.utf8_lower(stems.filter(plain)))
        tails, ends = _encoded(pc.replace_substring_regex(words.filter(plain), f"^{_LETTERS}", "", max_replacements=1))
        others, plain = words.filter(pc.invert(plain)).to_pylist(), plain.to_numpy(zero_copy_only=False)
        data, bounds = self._joined([*self._stems(stems), *self._others(tails), *self._others(others)])
        # Two pieces a word: letters and tail, or the word and nothing.
        pieces = np.zeros((len(words), 2), np.int64)
        pieces[plain, 0], pieces[plain, 1] = places, len(stems) + ends
        pieces[~plain, 0], pieces[~plain, 1] = len(stems) + len(tails) + np.arange(len(others)), len(bounds) - 1
        data, ends = _gathered(data, np.append(bounds, bounds[-1]), pieces.reshape(-1))
        return data, ends[::2]

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.width.itemsize
        return np.frombuffer(b"".join(pieces), self.width), np.concatenate(([0], np.cumsum(sizes)))

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        if not self.by_word:
            texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
            encoded = self.tokenizer.encode_batch_fast([text or "" for text in texts], add_special_tokens=False)
            return [np.array(e.ids, self.width).tobytes() for e in encoded]
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        rows = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        numbered = rows.flatten().dictionary_encode()
        data, bounds = _gathered(*self._words(numbered.dictionary), numbered.indices.to_numpy())
        bounds = bounds[np.concatenate(([0], np.cumsum(pc.list_value_length(rows).to_numpy())))]
        return [data[start:end].tobytes() for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _encoded(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Different values, and the place of each row's among them."""
    column = column.dictionary_encode()
    return column.dictionary.to_pylist(), column.indices.to_numpy().astype(np.int64)


def _gathered(data: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``data`` at ``places``, one after the other, and their bounds."""
    sizes = np.diff(bounds)[places]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return data[np.arange(ends[-1]) + np.repeat(bounds[places] - ends[:-1], sizes)], ends


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_INDEX = "part bigint, id {id}, file string, position bigint, n_bytes bigint, n_tokens bigint, before bigint"


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Write the token sequences of all texts, in ascending order of id, and return the index.

    The index has ``part`` (ascending with id), ``id``, ``file``, ``position``,
    ``n_bytes``, ``n_tokens`` and ``before``, the tokens of the same part before
    this sequence. Equal ids are spread over ranges of their texts' hashes.
    """
    id_type = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, pack = encoder(tokenizer), zstandard.ZstdCompressor(level=3)
        system, root = open_folder(folder)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], encode.width).tobytes()
        width, stream, before, number = encode.width.itemsize, None, 0, 0
        name, at = "", 0
        for batch in kernels.slices(batches, 1, _ENCODE_SLICE):
            index = []
            for ids in encode(batch.column(1)):
                if stream is None or at > FILE_BYTES:
                    if stream is not None:
                        stream.close()
                    name, at, number = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.records", 0, number + 1
                    stream = system.open_output_stream(f"{root}/{name}")
                data, n = frame(bytes([width]) + pack.compress(ids + end)), len(ids) // width + 1
                stream.write(data)
                index.append((part, name, at, len(data), n, before))
                at, before = at + len(data), before + n
            parts, names, at_s, sizes, counts, befores = zip(*index, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int64()), batch.column(0), pa.array(names, pa.string()), pa.array(at_s, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(befores, pa.int64())],
                names=["part", "id", "file", "position", "n_bytes", "n_tokens", "before"],
            )
        if stream is not None:
            stream.close()

    index = ordered.mapInArrow(write, _INDEX.format(id=id_type))
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: tokens of all sequences before this one. One row per part is summed up."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    running = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    return (
        index.join(totals.select("part", running.alias("earlier")), "part")
        .withColumn("start", F.col("earlier") + F.col("before"))
    )


def read_records(index: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """The sequences that ``index`` names, in any order, checked: ``tokens`` (if ``ids``), ``read_tokens``, ``ids_crc32``."""
    at = [index.columns.index(name) for name in ("file", "position", "n_bytes")]
    kinds = [("tokens", "array<int>"), ("read_tokens", "bigint"), ("ids_crc32", "bigint")][0 if ids else 1 :]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema] + [" ".join(k) for k in kinds])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        system, root = open_folder(folder)
        name, source = None, None
        for batch in batches:
            for some in (batch.slice(k, 1000) for k in range(0, len(batch), 1000)):
                tokens, counts, checks = [], [], []
                for file, position, size in zip(*(some.column(k).to_pylist() for k in at), strict=True):
                    if file != name:
                        name, source = file, system.open_input_file(f"{root}/{file}")
                    source.seek(position)
                    payload = unframe(source.read(size))
                    values = np.frombuffer(unpack.decompress(payload[1:]), f"<u{payload[0]}").astype("<u4")
                    counts.append(len(values))
                    checks.append(zlib.crc32(values.tobytes()))
                    if ids:
                        tokens.append(values.astype(np.int32))
                added = [pa.array(tokens, pa.list_(pa.int32()))] if ids else []
                added += [pa.array(counts, pa.int64()), pa.array(checks, pa.int64())]
                yield pa.RecordBatch.from_arrays([*some.columns, *added], names=[*some.schema.names, *(k for k, _ in kinds)])

    return index.mapInArrow(read, fields)


def token_records(docs: DataFrame, folder: str, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all texts and read them back: doc_id, start, n_tokens, ids_crc32."""
    index = write_records(docs, folder, tokenizer, id=id, text=text)
    spread = with_starts(index).repartition("file")
    return read_records(spread.select("id", "file", "position", "n_bytes", "start"), folder, ids=False).select(
        F.col("id").alias("doc_id"), "start", F.col("read_tokens").alias("n_tokens"), "ids_crc32",
    )
