"""Byte-level BPE encoding and decoding with the `tokenizers` library over Arrow batches.

A rank file gives byte strings in the order in which they were merged. Each byte is
mapped to a printable character, each pair of entries that makes a third becomes a
merge of that entry's rank, and the library's byte-level pre-tokenizer splits a text
by the pattern. Offsets are those of the text in code points. Decoding turns the
characters of each entry back into bytes: a character that was split over several
ids comes out whole, and ids that end inside one give U+FFFD in the decoded text.

Null text counts as empty and gives no ids; every row gives one row; other columns
of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame

from .common import Batches, by_arrow, kept_by_worker, slices


def byte_characters() -> list[str]:
    """The printable character of each byte: itself, or one from 256 on in order."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in kept else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


#: Letters, numbers and white space below U+0250, as the Unicode tables have them.
_LETTER, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_LOW = "\u0250"


def low_pattern(pattern: str) -> str | None:
    """The pattern in classes that `re` knows, right for texts below U+0250; none if
    it uses more of the library's syntax than letters, numbers and white space."""
    plain = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{_BLANK}{_LETTER}{_NUMBER}]")
    plain = plain.replace("\\p{L}", f"[{_LETTER}]").replace("\\p{N}", f"[{_NUMBER}]")
    plain = plain.replace("\\S", f"[^{_BLANK}]").replace("\\s", f"[{_BLANK}]")
    return None if re.search(r"\\[pPwWdDbB]|\(\?[a-zA-Z]", plain) else plain


#: Words kept per worker.
_MOST_KNOWN = 400_000


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        letters = byte_characters()
        name = {word: "".join(letters[b] for b in word) for word in ranks}
        merges = [
            (ranks[word], name[word[:cut]], name[word[cut:]])
            for word in ranks for cut in range(1, len(word))
            if word[:cut] in ranks and word[cut:] in ranks
        ]
        merges.sort(key=lambda m: m[0])
        self._tokenizer = Tokenizer.from_str(json.dumps({
            "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            ]},
            "post_processor": None, "decoder": None,
            "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
                      "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False,
                      "ignore_merges": True, "vocab": {name[w]: i for w, i in ranks.items()},
                      "merges": [[a, b] for _, a, b in merges]},
        }))
        low = low_pattern(pattern)
        self._low = re.compile(low).findall if low else None
        self._model, self._letter = self._tokenizer.model, dict(enumerate(letters))
        self._known: dict[str, tuple[int, ...]] = {}
        byte_of = {letter: b for b, letter in enumerate(letters)}
        size = max(ranks.values(), default=-1) + 1
        self._bytes: list[bytes | None] = [None] * size
        for word, i in ranks.items():
            self._bytes[i] = bytes(byte_of[c] for c in name[word])
        self._digits = [str(i) for i in range(size)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Below U+0250 the words of a text go to the library one by
        one and are kept per worker; other texts go to it whole."""
        if len(self._known) > _MOST_KNOWN:
            self._known.clear()
        found: list[list[int]] = []
        for text in texts:
            if self._low is None or (text and max(text) >= _LOW):
                found.append(self._tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                words, known = self._low(text), self._known
                for word in words:
                    if word not in known:
                        letters = word.encode().decode("latin-1").translate(self._letter)
                        known[word] = tuple(t.id for t in self._model.tokenize(letters))
                found.append(list(chain.from_iterable(map(known.__getitem__, words))))
        return found

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and, of each, the code points of the text it covers (start, end)."""
        return [(e.ids, e.offsets) for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self._digits.__getitem__, ids))


def codec_of(ranks_path: str, pattern: str) -> Codec:
    """The codec of a worker, made once."""
    return kept_by_worker(("codec", (ranks_path, pattern)), lambda: Codec(read_ranks(ranks_path), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, offsets: bool = True) -> DataFrame:
    """doc_id, ids and, if asked for, the start and end of each id in the text."""
    schema = "doc_id bigint, ids array<int>" + ", starts array<int>, ends array<int>" * offsets

    def work(batches: Batches) -> Iterator[dict]:
        codec = codec_of(ranks_path, pattern)
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            if offsets:
                found = codec.encode_with_offsets(texts)
                yield {"doc_id": part.column("doc_id"), "ids": [i for i, _ in found],
                       "starts": [[a for a, _ in o] for _, o in found], "ends": [[b for _, b in o] for _, o in found]}
            else:
                yield {"doc_id": part.column("doc_id"), "ids": codec.encode(texts)}

    return by_arrow(docs.select("doc_id", "text"), work, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, the decoded bytes, and their text (U+FFFD where a character is cut)."""

    def work(batches: Batches) -> Iterator[dict]:
        codec = codec_of(ranks_path, pattern)
        for batch in batches:
            data = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "data": data,
                   "text": [d.decode("utf-8", "replace") for d in data]}

    return by_arrow(encoded.select("doc_id", "ids"), work, "doc_id bigint, data binary, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to."""

    def work(batches: Batches) -> Iterator[dict]:
        codec = codec_of(ranks_path, pattern)
        for part in slices(batches):
            found = codec.encode([t or "" for t in part.column("text").to_pylist()])
            yield {
                "doc_id": part.column("doc_id"),
                "n_tokens": [len(ids) for ids in found],
                "ids_sha256": [hashlib.sha256(codec.joined(ids).encode()).hexdigest() for ids in found],
                "decoded_sha256": [hashlib.sha256(codec.decode(ids)).hexdigest() for ids in found],
            }

    return by_arrow(docs.select("doc_id", "text"), work,
                    "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
