"""Byte-level BPE: texts to ids and back, exactly.

The ranks of a vocabulary are turned into the merges that made it (a token's
two parts are what its bytes become under the lower ranks), and the tokenizers
library applies them over Arrow batches. It works on characters that stand for
bytes, so a token can hold a part of a character: ids are turned into bytes by
the reversed table, and bytes into text only once a text's tokens are joined.
Offsets count code points; a token that holds a part of a character covers the
whole of it, so neighbours that share a character overlap.

No match of the pattern goes on over a space before a character that is none,
so texts are cut there, and each different stretch of a task is encoded once.
The tokenizer is built once on the driver, from a vocabulary of fixed size, and
broadcast. Batches are cut by bytes of text; nothing is shuffled.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import table

#: Bytes of text that are encoded at once, and ids that are decoded at once; a larger text goes alone.
SLICE_BYTES, SLICE_IDS = 1 << 22, 1 << 18
#: Stretches whose ids a task remembers, the first ones that it meets, and their greatest length; stretches that are encoded at once.
KNOWN, KNOWN_LENGTH, NEW = 300_000, 32, 10_000
#: Whether a byte begins a character that is surely no white space; of those that begin one which may be, all characters count as such.
SOLID = np.array([b > 0x20 and b not in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = dict(zip(shown, map(chr, shown))) | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_ranks(lines: Iterator[bytes]) -> dict[bytes, int]:
    """Token to rank, of lines of base64 and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def two_parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """What ``token`` was merged from: its bytes, merged by lower ranks than its own until two parts are left."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            raise ValueError(f"no merges of lower rank make {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers library's tokenizer of these ranks, that encodes each match of ``pattern`` separately."""
    shown = byte_characters()
    text = lambda token: "".join(shown[b] for b in token)
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{len(missing)} single bytes have no rank")
    pairs = [two_parts(token, ranks) for token, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(token) > 1]
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    model |= {"vocab": {text(token): rank for token, rank in ranks.items()}, "merges": [[text(a), text(b)] for a, b in pairs]}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None, "decoder": None, "model": model})


def load(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The tokenizer of a file of ranks, for the executors. The file is read on the driver, once; its size is that of the vocabulary."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(tokenizer_json(read_ranks(file), pattern))


@lru_cache(maxsize=2)
def opened(text: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have a core each
    return Tokenizer.from_str(text)


@lru_cache(maxsize=2)
def token_bytes(text: str) -> pa.Array:
    """Bytes of each id, by the reversed table; null where an id has no token."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = json.loads(text)["model"]["vocab"]
    found: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for token, rank in vocab.items():
        found[rank] = bytes(back[c] for c in token)
    return pa.array(found, pa.binary())


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours that add up to ``most`` at most, or are single."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += int(size)
    if first < len(sizes):
        yield first, len(sizes)


def unused(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def list_array(lengths: list[int] | np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)), pa.array(values))


def stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts, joined and cut before each space that a character other than white space follows, and where each text begins among these.

    A pattern's match holds such a space at its beginning only, and white space
    before it is matched as at the end of a text; so the matches in a stretch
    are those of the text.
    """
    texts = pa.concat_arrays([texts.cast(pa.binary())])  # of a slice, its own bytes
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        cut[: len(data) - 1] = (data[:-1] == 0x20) & SOLID[data[1:]]
        cut[ends[1:][ends[1:] > 0] - 1] = False  # what follows a text's last space is another text
    cut[ends] = True
    at = np.flatnonzero(cut).astype(np.int32)
    if len(at) == 1:  # no bytes
        return pa.array([], pa.string()), np.zeros(len(ends), np.int64)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))), np.searchsorted(at, ends)


class Encoder:
    """Ids of texts by a tokenizer, which gets each different stretch once, as long as that is remembered."""

    def __init__(self, model):
        self.model, self.known = model, {}

    def ids(self, texts: pa.Array) -> pa.ListArray:
        found, first = stretches(texts)
        coded = found.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new, fresh = [w for w in words if w not in self.known], {}
        for k in range(0, len(new), NEW):
            fresh |= {w: x.ids for w, x in zip(new[k : k + NEW], self.model.encode_batch_fast(new[k : k + NEW], add_special_tokens=False), strict=True)}
        ids = [fresh[w] if w in fresh else self.known[w] for w in words]
        for w, x in fresh.items():
            if len(self.known) >= KNOWN:
                break
            if len(w) <= KNOWN_LENGTH:
                self.known[w] = x
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        of_word = list_array(sizes, np.fromiter(chain.from_iterable(ids), np.int32, sizes.sum()))
        ends = np.append(0, np.cumsum(sizes[codes]))[first]
        return list_array(np.diff(ends), of_word.take(pa.array(codes)).flatten().to_numpy(zero_copy_only=False))


def encode(df: DataFrame, tokenizer: Broadcast, text: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` with _ids, and with _starts and _ends if ``offsets``, in place of ``text``.

    A null text counts as empty, and an empty text has no ids. Texts of special
    tokens are ordinary text. Other columns go through as they are, whatever
    their names, but for those three, which are replaced, and for names with
    dots, which mapInArrow can't take.
    """
    added = ["_ids", *(["_starts", "_ends"] if offsets else [])]
    others = [c for c in df.columns if c != text and c.lower() not in added]
    held = unused("_text", others)
    kept = df.select(*(F.col(f"`{c}`") for c in others), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(held))
    schema = kept.drop(held).schema
    for name in added:
        schema = schema.add(name, T.ArrayType(T.IntegerType()), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(tokenizer.value)
        encoder = Encoder(model)
        for batch in batches:
            for first, end in cuts(pc.binary_length(batch[held]).to_numpy(zero_copy_only=False), SLICE_BYTES):
                part = batch.slice(first, end - first)
                if not offsets:
                    columns = [encoder.ids(part[held])]
                else:
                    found = model.encode_batch(part[held].to_pylist(), add_special_tokens=False)
                    ids = [x.ids for x in found]
                    lengths = list(map(len, ids))
                    columns = [list_array(lengths, np.fromiter(chain.from_iterable(ids), np.int32, sum(lengths)))]
                    spans = np.fromiter((v for x in found for s in x.offsets for v in s), np.int32, 2 * sum(lengths)).reshape(-1, 2)
                    columns += [list_array(lengths, np.ascontiguousarray(spans[:, k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in others), *columns], names=[*others, *added])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: Broadcast, ids: str = "_ids") -> DataFrame:
    """``df`` with _bytes in place of ``ids``: the bytes of a row's tokens, joined.

    Null ids count as none. An id out of the vocabulary, or a null one, raises
    an error. The bytes of ids that cut a character are no valid text; as_text
    shows what they hold.
    """
    others = [c for c in df.columns if c != ids and c.lower() != "_bytes"]
    held = unused("_ids", others)
    kept = df.select(*(F.col(f"`{c}`") for c in others), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias(held))
    schema = kept.drop(held).schema.add("_bytes", "binary", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(tokenizer.value)
        for batch in batches:
            sizes = pc.list_value_length(batch[held]).to_numpy(zero_copy_only=False)
            for first, end in cuts(sizes, SLICE_IDS):
                part = batch.slice(first, end - first)
                rows = part[held]
                values = rows.flatten()
                numbers = values.to_numpy(zero_copy_only=False)
                if values.null_count or len(numbers) and (numbers.min() < 0 or numbers.max() >= len(known)):
                    raise ValueError("an id is not in the vocabulary")
                pieces = known.take(values)
                if pieces.null_count:
                    raise ValueError("an id is not in the vocabulary")
                ends = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64)])
                bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False), dtype=np.int64)])
                joined = pieces.buffers()[2]  # take makes a new array, whose values are the tokens joined
                joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends[bounds].astype(np.int64)), joined]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(part[c] for c in others), joined], names=[*others, "_bytes"])

    return kept.mapInArrow(run, schema)


def as_text(found: DataFrame, column: str = "_bytes") -> DataFrame:
    """``found`` with _text: the decoded bytes, with U+FFFD where tokens at an end hold a part of a character only."""
    return found.withColumn("_text", F.make_valid_utf8(F.col(column).cast("string")))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of ``documents``, encoded and decoded again."""
    import public_tokenizers

    tokenizer = load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)
    written = ids.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "_ids")
    return decode(written, tokenizer).select("doc_id", "n_tokens", "ids_sha256", F.sha2("_bytes", 256).alias("decoded_sha256"))
