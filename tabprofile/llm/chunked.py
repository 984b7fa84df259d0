"""Tokenizer encoding with bounded caches of white-space chunks and pre-tokens.

A text is cut after every run of non-white characters.  No pre-token of the supported
tokenizers goes on from a non-white character into white space, so encoding the chunks
one by one gives the ids of the whole text; repeated chunks are encoded once.  A new chunk
of Latin characters is cut into pre-tokens by the tokenizer file's own pattern, and the
``tokenizers`` BPE model merges each new pre-token.  Chunks with other characters, where
regex engines may differ in their Unicode tables, go through the whole library pipeline.
Characters that only some engines count as white (for example U+00A0) make no safe cut: a
text that holds one is encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

from tabprofile.llm.common import text_offsets

CHUNK = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
UNSAFE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]*")  # Latin without unsafe characters


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for
    themselves, the others get code points from 256 on, in byte order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def byte_level_rules(json_text: str, pattern: str):
    """(lower-cased?, compiled pre-token pattern) of a byte-level tokenizer file, or None if
    the file has steps this module doesn't know.  ``pattern`` is the byte-level default."""
    parts = json.loads(json_text)
    pre, norm = parts.get("pre_tokenizer") or {}, parts.get("normalizer") or {}
    steps = [x["type"] for x in norm.get("normalizers", [norm] if norm else [])]
    if set(steps) - {"NFC", "Replace", "Lowercase"} or parts["model"].get("continuing_subword_prefix"):
        return None
    lower = "Lowercase" in steps
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre["add_prefix_space"]:
        return lower, latin_pattern(pattern)
    cut, *rest = pre.get("pretokenizers", [{}])
    if cut.get("type") == "Split" and [x["type"] for x in rest] == ["ByteLevel"] and not rest[0]["use_regex"] \
            and not rest[0]["add_prefix_space"] and (cut["behavior"], cut["invert"]) in {("Isolated", False), ("Removed", True)}:
        return lower, latin_pattern(cut["pattern"]["Regex"])
    return None


def latin_pattern(pattern: str):
    """``pattern`` for Latin text in the standard ``re`` engine: its letter, number and
    white-space classes written out for the characters below U+0250, where all Unicode
    versions agree."""
    import regex
    latin = [chr(i) for i in range(0x250)]

    def listed(kind):
        return "".join(re.escape(c) for c in latin if regex.match(kind, c))

    classes = {kind: listed(kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out = pattern
    for kind, chars in classes.items():  # inside brackets first
        out = re.sub(r"\[(\^?)([^\]]*)\]", lambda m: f"[{m[1]}{m[2].replace(kind, chars)}]", out)
    for kind, chars in classes.items():
        out = "".join(part if part.startswith("[") else part.replace(kind, f"[{chars}]")
                      for part in re.split(r"(\[(?:[^\]\\]|\\.)*\])", out))
    return re.compile(out.replace(r"\S", f"[^{classes[chr(92) + 's']}]"))


class Recent(dict):
    """A bounded cache of a function's results in two generations: the older one goes when the
    newer is full, and what is asked for again moves to the newer."""

    def __init__(self, function, limit: int):
        self.function, self.half, self.older = function, limit // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


WHOLE = b"?"  # stands for the ids of a chunk whose text must be encoded whole


CACHED = 400_000  # chunks a worker keeps unless its state has another number under ``cached``


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    ``limit`` chunks are kept, about 220 bytes each; texts are best given in Arrow arrays of
    ``portion`` bytes."""

    def __init__(self, tokenizer, rules=None, limit: int = CACHED):
        self.portion = 8 * limit
        self.tokenizer, self.rules = tokenizer, rules
        self.merge, self.characters = tokenizer.model.tokenize, byte_characters()
        #: what stands before the letters of a chunk of a space and a word, if the pattern takes it as one piece
        alone = [rules[1].findall(f" {w}") for w in ("word", "Word")] if rules else []
        self.word = None
        if alone and all(len(x) == 1 for x in alone):
            self.word = self.characters[32] if alone[0][0][0] == " " else ""
        self.chunks, self.pieces = Recent(self._chunk, limit), Recent(self._piece, limit // 4)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _merged(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.merge(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._merged(piece.encode().decode("latin-1").translate(self.characters))

    def _chunk(self, raw: bytes) -> bytes:
        if self.word is not None and raw[:1] == b" " and raw[1:].isalpha():  # ASCII letters stand for themselves
            return self._merged(self.word + (raw.lower() if self.rules[0] else raw)[1:].decode())
        chunk = raw.decode()
        if self.rules and PLAIN.fullmatch(chunk):
            lower, pattern = self.rules
            pieces = pattern.findall(chunk.lower() if lower else chunk)
            # most chunks are one word and its space, which needs no second entry
            return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))
        return WHOLE if UNSAFE.search(chunk) else self._whole(chunk)

    def encode(self, texts) -> list[bytes]:
        """``texts``: a list, or an Arrow array of at most a few MB (see ``common.portions``).

        Chunks are cut, told apart and put together again as Arrow arrays; only the distinct ones
        become Python objects."""
        import numpy as np
        import pyarrow as pa
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        places = text_offsets(column)
        first, size = int(places[0]), int(places[-1] - places[0])
        if not size:
            return [b""] * len(column)
        places -= first
        data = column.buffers()[2].slice(first, size)
        raw = np.frombuffer(data, np.uint8)
        white = (raw == 32) | (raw - np.uint8(9) < 5)  # 9 to 13; smaller bytes wrap around
        begins = np.empty(size, bool)
        begins[0] = True
        np.greater(white[1:], white[:-1], out=begins[1:])
        begins[places[:-1][places[:-1] < places[1:]]] = True
        cuts = np.append(np.flatnonzero(begins), size).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), data]).dictionary_encode()
        known = pa.array(list(map(self.chunks.__getitem__, chunks.dictionary.to_pylist())), pa.binary())
        ids = known.take(chunks.indices)
        own = np.searchsorted(cuts, places)
        ends = text_offsets(ids)[own].tolist()
        held = memoryview(ids.buffers()[2] or b"")
        out = [bytes(held[a:z]) for a, z in zip(ends, ends[1:])]
        odd = np.flatnonzero(np.diff(text_offsets(known)) % 4)
        if len(odd):
            at = np.flatnonzero(np.isin(chunks.indices.to_numpy(), odd))
            for i in set((np.searchsorted(own, at, "right") - 1).tolist()):
                out[i] = self._whole(column[i].as_py())
        return out


def load(json_text: str):
    """A tokenizer from its JSON; strings of special tokens in a text are ordinary text."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(json_text)
    t.encode_special_tokens = True
    return t


def worker_encoder(state: dict) -> ChunkEncoder:
    """The encoder of this Python worker; ``state`` is a broadcast dict with json, pattern
    and perhaps cached.  It lives as long as the worker does, so later tasks find warm caches."""
    if "encoder" not in state:
        state["encoder"] = ChunkEncoder(load(state["json"]), byte_level_rules(state["json"], state["pattern"]),
                                        state.get("cached", CACHED))
    return state["encoder"]
