"""Token ids of texts by a public byte-level tokenizer, with forced boundaries."""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator
from functools import partial
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary as ranks; pass another path for another place.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer splits a text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fragments kept with their ids by a worker, and the longest one kept.
KEPT, KEPT_CHARS = 100_000, 64
#: Longer fragments are cut further at forced boundaries.
LONG = 48

_ASCII_SPACE = r"\t-\r "
_OTHER_SPACE = "\x85\xa0  -     　"


class ForcedBoundaryEncoder:
    """Encodes a text in fragments that can't share a token.

    A pair of bytes that occurs inside no token of the vocabulary is a forced boundary: no merge ever joins its two bytes. A text may be
    cut there if the pattern that splits texts beforehand can't look across the cut either, that is

    * between a character that isn't white space and ASCII white space: the pattern always ends a piece there;
    * between two characters of which neither is white space or an apostrophe: inside a run of letters, of digits or of other characters the pattern
      goes on after the cut as if it were the beginning, and between different classes it ends a piece anyway.

    Everything between cuts is encoded for itself, repeated fragments once, and the ids are concatenated: the cost of a text is
    proportional to its length, however long its runs without white space.
    """

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.inside = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self._words = re.compile(self._word_pattern()).findall
        self._odd = re.compile(f"[{_OTHER_SPACE}]").finditer
        self._kept: dict[str, list[int]] = {}

    def _word_pattern(self) -> str:
        """Fragments that end before ASCII white space, unless the boundary there isn't forced."""
        last = {int(x) for s in (9, 10, 11, 12, 13, 32) for x in np.flatnonzero(self.inside[:, s])} - {9, 10, 11, 12, 13, 32}
        joins = _OTHER_SPACE + "".join(re.escape(chr(x)) for x in sorted(last) if x < 128)
        tails = {x & 63 for x in last if x >= 128}
        joins += "".join(f"{chr(c)}" for c in range(128, 0xFFFF) if c & 63 in tails and not 0xD800 <= c < 0xE000)
        joins += "\U00010000-\U0010ffff" * bool(tails)
        space, solid = f"[{_ASCII_SPACE}]", f"[^{_ASCII_SPACE}]"
        return f"{space}*{solid}+(?:(?<=[{joins}]){space}+{solid}*)*|{space}+"

    def _cut(self, fragment: str) -> list[str]:
        """A fragment cut at the forced boundaries that lie between characters that aren't white space."""
        data = fragment.encode()
        if len(data) <= LONG:
            return [fragment]
        b = np.frombuffer(data, np.uint8)
        left, right = b[:-1], b[1:]
        begins = (b & 0xC0) != 0x80
        safe = ~self.inside[left, right] & begins[1:]
        for side in (left, right):
            safe &= (side > 32) & (side != 39)
        odd = [m.start() for m in self._odd(fragment)]
        if odd:
            at = np.append(np.flatnonzero(begins), len(b))
            for edge in (at[odd], at[np.array(odd) + 1]):  # where such a character begins and where it ends
                edge = edge[(edge > 0) & (edge < len(b))]
                safe[edge - 1] = False
        at = np.flatnonzero(safe) + 1
        return [data[i:j].decode() for i, j in zip([0, *at], [*at, len(data)])]

    def encode(self, text: str) -> list[int]:
        kept, out = self._kept, []
        for word in self._words(text):
            ids = kept.get(word)
            if ids is None:
                ids = []
                for part in self._cut(word):
                    ids += self._encode(part)
                if len(word) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[word] = ids
            out += ids
        return out


def _kept_here(name: str) -> dict:
    """What this process keeps for later tasks. Functions travel with the job, and with them copies of this module's globals; a module of its own stays."""
    return sys.modules.setdefault("_millrace_kept", ModuleType("_millrace_kept")).__dict__.setdefault(name, {})


def _encoder(vocabulary: str, pattern: str) -> ForcedBoundaryEncoder:
    ready = _kept_here("encoders")
    if (vocabulary, pattern) not in ready:
        ready[vocabulary, pattern] = ForcedBoundaryEncoder(vocabulary, pattern)
    return ready[vocabulary, pattern]


def _ids(batches: Iterator[pa.RecordBatch], vocabulary: str, pattern: str, names: list[str], count: bool) -> Iterator[pa.RecordBatch]:
    encode = _encoder(vocabulary, pattern).encode
    for batch in batches:
        found = [np.asarray(encode(x.as_py()) if x.is_valid else (), np.int32) for x in batch.column(batch.num_columns - 1)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        if count:
            last = pa.array(sizes)
        else:
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=names)


def encode_texts(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN, count: bool = False) -> DataFrame:
    """``keep`` and the column ``ids``, the token ids of each text without special tokens (or, with ``count``, ``n_tokens``).

    There is no shuffle: a row goes out of the task that read it. The vocabulary file must be at the same path on every executor.

    Defined cases: an empty text and a null text have an empty list (0 tokens); texts of special tokens are ordinary text; texts may be
    of any length; repeated rows and other columns are left as they are.
    """
    name, kind = ("n_tokens", T.LongType()) if count else ("ids", T.ArrayType(T.IntegerType()))
    src = df.select(*[df[k] for k in keep], df[text].cast("string").alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(name, kind)])
    return src.mapInArrow(partial(_ids, vocabulary=vocabulary, pattern=pattern, names=[*keep, name], count=count), schema)


def _texts(batches: Iterator[pa.RecordBatch], vocabulary: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    ready = _kept_here("tokens")
    if vocabulary not in ready:
        with open(vocabulary, "rb") as lines:
            ready[vocabulary] = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    of = ready[vocabulary].__getitem__
    for batch in batches:
        texts = [b"".join(map(of, x)).decode(errors="replace") if x is not None else None for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=names)


def decode_ids(df: DataFrame, ids: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and the column ``text`` of lists of token ids, for round trips. A null list has a null text; bytes that are no character are replaced."""
    src = df.select(*[df[k] for k in keep], df[ids].alias("_ids"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType())])
    return src.mapInArrow(partial(_texts, vocabulary=vocabulary, names=[*keep, "text"]), schema)
