"""Byte-level BPE encoding and decoding (operator 10).

Encoding runs the ``tokenizers`` library over Arrow batches.  Its model works on
characters, so each of the 256 bytes is written as one printable character
(:func:`byte_characters`); the merges are derived from the rank file.  Decoding reverses
the byte table, joins the bytes of all tokens and only then reads UTF-8, since a
character's bytes may be split over tokens.

Defined results: null text is empty; empty text gives no ids and decodes to no bytes; rows
are independent, so repeated rows and repeated or null ids give a result each; empty
tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame

from tabprofile.llm.chunked import CHUNK, UNSAFE, byte_characters, worker_encoder
from tabprofile.llm.common import portions, slices, text_offsets, texts


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last merge that makes ``token``: its two parts just before.  None if the ranks
    below its own don't lead to two parts."""
    parts, own = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best, at = own, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], own)
            if r < best:
                best, at = r, i
        if at < 0:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A ``tokenizers`` BPE model with the ids and merges of a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    chars = byte_characters()
    shown = {t: "".join([chars[b] for b in t]) for t in ranks}
    merges = [(shown[m[0]], shown[m[1]]) for t in sorted(ranks, key=ranks.get)
              if len(t) > 1 and (m := merge_of(t, ranks))]
    tok = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok.to_str()


def token_bytes(json_text: str) -> dict[int, bytes]:
    """The bytes of each id, by reversing the byte table."""
    byte = {c: b for b, c in enumerate(byte_characters())}
    return {i: bytes([byte[c] for c in token]) for token, i in json.loads(json_text)["model"]["vocab"].items()}


def decode_bytes(ids: Iterable[int], table: dict[int, bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


def decode_many(encoded: list[bytes], vocabulary) -> list:
    """The bytes of each row of ids (little-endian unsigned 32-bit); ``vocabulary`` is an Arrow
    array of the tokens' bytes by id."""
    import numpy as np
    import pyarrow as pa
    found = vocabulary.take(pa.array(np.frombuffer(b"".join(encoded), "<i4")))
    ends = text_offsets(found)[np.cumsum([0, *[len(e) // 4 for e in encoded]])].tolist()
    held = memoryview(found.buffers()[2] or b"")
    return [held[a:z] for a, z in zip(ends, ends[1:])]


def decode_stream(ids: Iterable[int], table: dict[int, bytes]):
    """Text piece by piece; bytes of a character not yet whole are held back."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if piece := decoder.decode(table[i]):
            yield piece
    if rest := decoder.decode(b"", final=True):
        yield rest


def offsets_of(tokenizer, text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Ids and (start, end) character offsets; tokens that share a split character share
    its offsets."""
    if UNSAFE.search(text):
        e = tokenizer.encode(text, add_special_tokens=False)
        return e.ids, e.offsets
    ids, offsets = [], []
    for m in CHUNK.finditer(text):
        e = tokenizer.encode(m.group(), add_special_tokens=False)
        ids += e.ids
        offsets += [(a + m.start(), b + m.start()) for a, b in e.offsets]
    return ids, offsets


def encode(docs: DataFrame, json_text: str, pattern: str, with_offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int> and, on request, starts and ends (character offsets)."""
    bc = docs.sparkSession.sparkContext.broadcast({"json": json_text, "pattern": pattern})
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches):
        import numpy as np
        import pyarrow as pa
        encoder = worker_encoder(bc.value)
        for batch in batches:
            for b in portions(batch, 1, encoder.portion):
                if with_offsets:
                    both = [offsets_of(encoder.tokenizer, t) for t in b.column(1).to_pylist()]
                    more = [[[o[j] for o in offs] for _, offs in both] for j in (0, 1)]
                    ids = [i for i, _ in both]
                else:
                    ids, more = [np.frombuffer(e, "<i4") for e in encoder.encode(b.column(1))], []
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *[pa.array(x, pa.list_(pa.int32())) for x in [ids, *more]]],
                    ["doc_id", "ids", "starts", "ends"][:2 + len(more)])

    more = ", starts array<int>, ends array<int>" if with_offsets else ""
    return texts(docs).mapInArrow(task, f"doc_id {kind}, ids array<int>{more}")


def decode(encoded: DataFrame, json_text: str) -> DataFrame:
    """doc_id and decoded (binary) of ``encode``'s rows; null ids: no bytes."""
    bc = encoded.sparkSession.sparkContext.broadcast({"json": json_text})
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def task(batches):
        import pyarrow as pa
        state = bc.value
        if "table" not in state:
            state["table"] = token_bytes(state["json"])
        table = state["table"]
        for batch in batches:
            for b in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([decode_bytes(x or (), table) for x in b.column(1).to_pylist()], pa.binary())],
                    ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(task, f"doc_id {kind}, decoded binary")


def round_trip(docs: DataFrame, json_text: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    bc = docs.sparkSession.sparkContext.broadcast({"json": json_text, "pattern": pattern})
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches):
        import pyarrow as pa
        state = bc.value
        encoder = worker_encoder(state)
        if "vocabulary" not in state:
            table = token_bytes(state["json"])
            state["vocabulary"] = pa.array([table.get(i) for i in range(max(table) + 1)], pa.binary())
        for batch in batches:
            for b in portions(batch, 1, encoder.portion):
                ids = encoder.encode(b.column(1))
                back = decode_many(ids, state["vocabulary"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(e) // 4 for e in ids], pa.int64()),
                     pa.array([hashlib.sha256(e).hexdigest() for e in ids]),
                     pa.array([hashlib.sha256(x).hexdigest() for x in back])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(task, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
