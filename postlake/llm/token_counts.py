"""Token counts by a map-side two-tier lookup.

A text is cut where no piece of the vocabulary can reach across: before a run of
spaces and around a line feed. The count of a text is then the sum over its
pre-tokens. Tier one is a table of frequent pre-tokens and their lengths, packed
into one small broadcast; tier two is a cache in each Python worker, filled by the
library on a miss. No pre-token is shuffled.

The table is drawn from some `sample_rows` rows and holds at most `table_size`
entries: both only steer speed, never a count. If a vocabulary has a piece that
reaches across a cut, or its model normalises texts, whole texts are encoded.

Null text counts as empty; an empty text has no tokens; every row gives one row;
other columns of the input are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, by_arrow, slices

_SPACE = "▁"
_PRE_TOKEN = re.compile(" +[^ \n]*|[^ \n]+|\n")


class Lengths(dict):
    """Tokens of a pre-token. What is missing is encoded and kept, `most` at a time."""

    def __init__(self, model_path: str, known: dict[str, int], most: int = 600_000):
        import sentencepiece

        super().__init__(known)
        self._known, self._most = known, most + len(known)
        self._library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self._line_feed = self._library.piece_to_id("<0x0A>")
        self[" "] = self["\n"] = 1

    def whole(self, text: str) -> int:
        return len(self._library.encode(text))

    def _learn(self, missing: list[str]) -> None:
        """Encode many at once, a line feed before each: no piece holds one, and the
        space that the library puts before a text then stands before all of them."""
        ids = np.array(self._library.encode("\n" + "\n".join(missing) + "\n"))
        self.update(zip(missing, (np.diff(np.flatnonzero(ids == self._line_feed)) - 1).tolist(), strict=True))

    def of(self, texts: list[str]) -> list[int]:
        if len(self) >= self._most:
            self.clear()
            self.update(self._known)
            self[" "] = self["\n"] = 1
        parts = [pre_tokens(text) if text else [] for text in texts]
        missing = [p for p in set().union(*parts) if p not in self]
        if missing:
            self._learn(missing)
        return [sum(map(self.__getitem__, p)) for p in parts]


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text with the space that the library puts before it."""
    return _PRE_TOKEN.findall(" " + text.replace(_SPACE, " "))


def splittable(model_path: str) -> bool:
    """Whether no piece reaches across a cut and the model leaves texts as they are."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as file:
        spec.ParseFromString(file.read())
    plain = (spec.normalizer_spec.name == "identity" and spec.normalizer_spec.add_dummy_prefix
             and not spec.normalizer_spec.remove_extra_whitespaces)
    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [processor.id_to_piece(i) for i in range(processor.vocab_size())]
    return plain and not any(_SPACE in p.lstrip(_SPACE) or "\n" in p or " " in p for p in pieces)


def frequent(docs: DataFrame, model_path: str, sample_rows: int, table_size: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded number of rows, drawn from
    all partitions."""
    share = min(1.0, sample_rows / max(1, docs.count()))

    def count(batches: Batches) -> Iterator[dict]:
        found: Counter[str] = Counter()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                found.update(pre_tokens(text) if text else ())
        found.pop("\n", None)
        top = found.most_common(table_size)
        yield {"part": [p for p, _ in top], "n": [n for _, n in top]}

    counted = by_arrow(docs.select("text").sample(share, seed=11), count, "part string, n bigint")
    top = counted.groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(table_size).collect()
    parts = [row.part for row in top]
    lengths = Lengths(model_path, {})
    if parts:
        lengths._learn(parts)
    return {part: lengths[part] for part in parts}


def token_counts(
    docs: DataFrame, model_path: str, *, limit: int = 4096, sample_rows: int = 4_000, table_size: int = 1 << 15
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `docs`."""
    spark = docs.sparkSession
    cut = splittable(model_path)
    known = frequent(docs, model_path, sample_rows, table_size) if cut else {}
    packed = spark.sparkContext.broadcast(
        zlib.compress("\x00".join(f"{n}\x01{p}" for p, n in known.items() if "\x00" not in p).encode()))

    def count(batches: Batches) -> Iterator[dict]:
        entries = zlib.decompress(packed.value).decode().split("\x00")
        lengths = Lengths(model_path, {p: int(n) for n, p in (e.split("\x01", 1) for e in entries if e)})
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield {
                "doc_id": part.column("doc_id"),
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": lengths.of(texts) if cut else [lengths.whole(t) for t in texts],
            }

    counted = by_arrow(docs.select("doc_id", "text"), count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
