"""Token ids of whole texts with the tokenizers library, each distinct part of text encoded once.

Both vocabularies used here split a text into parts before they look at merges, and a single space between
two other characters always ends a part, as does a line feed between two such characters and the step from a
letter to ASCII punctuation. So texts are cut there by Arrow, a whole batch at a time, and only the distinct
parts become Python strings; what is not remembered from earlier batches goes to the library (a word of plain
Latin letters to its model at once, as normalising and splitting would leave such a word as it is; the rest
through the whole tokenizer), and the ids are strung together by numpy: the same ids as for the whole text
(tests compare them on every document), at a fraction of the time. A text in which white space touches white
space, or that holds rare spaces or combining marks, is cut only at single spaces between other characters.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, give_back, tidy

#: Distinct parts remembered per Python worker, in each of two generations.
REMEMBERED = 200_000
#: Bytes of text that are cut and strung together at once.
AT_ONCE = 3 << 20
END_ID = 2
#: ASCII punctuation that ends a word's part (not the apostrophe, which starts contractions).
_MARKS = "!-&(-/:-@\\[-`{-~"
_RARE = r"\x00\x01\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{300}-\x{36f}\x{1680}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Texts that are not simply words parted by single spaces and line feeds (RE2).
_ODD = rf"[ \n][ \n]|^[ \n]|[ \n]$|[{_RARE}]"
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Words that no normalising or splitting changes, except for their case.
_WORD = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")
#: The characters that byte-level models have for bytes: printable ones stand for themselves, the others are numbered from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}


def spread(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ids that the codes name, strung together, and each one's end. sizes: of the stretches of ids."""
    first, each = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.cumsum(each)
    return ids[np.repeat(first[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)], ends


def ends_of(lists: pa.Array, ends: np.ndarray) -> np.ndarray:
    """The end of each list, from its items' ends, with a zero before them."""
    return np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]


class Encoder:
    """The ids of texts, for one vocabulary file. What it remembers saves time and changes no id."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.spaced, self.folds = one(" a") != one("a"), one("AB") == one("ab")
        self.remembered = remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of each of the distinct parts."""
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        young, rest = self.young, []
        for part in parts:
            if part not in young:
                seen = self.old.get(part)
                if seen is None:
                    if word := _WORD.fullmatch(part):
                        plain = word[2].lower() if self.folds else word[2]
                        if not plain.isascii():
                            plain = plain.encode().decode("latin-1").translate(_BYTES)
                        seen = array("I", [t.id for t in self.model.tokenize("Ġ" + plain if word[1] and self.spaced else plain)]).tobytes()
                    else:
                        rest.append(part)
                young[part] = seen
        if rest:
            for part, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                young[part] = array("I", e.ids).tobytes()
        return [young[p] for p in parts]

    def parts_of(self, pieces: pa.Array) -> pa.Array:
        """Lists of the parts of pieces of plain texts; a zero byte marks a text's first piece, a space goes before others."""
        first = pc.starts_with(pieces, "\0")
        pieces = pc.if_else(first, pc.utf8_slice_codeunits(pieces, 1), pc.binary_join_element_wise(" ", pieces, "") if self.spaced else pieces)
        if self.folds:
            pieces = pc.if_else(pc.string_is_ascii(pieces), pc.ascii_lower(pieces), pieces)
        pieces = pc.replace_substring(pieces, "\n", "\x01\n\x01")
        return pc.split_pattern(pc.replace_substring_regex(pieces, rf"(\pL)([{_MARKS}]+)(\x01|$)", r"\1" + "\x01" + r"\2\3"), "\x01")

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text of a string column; a null is an empty text."""
        if len(texts) > 1 and texts.nbytes > AT_ONCE:
            half = len(texts) // 2
            return self.encode_column(texts[:half]) + self.encode_column(texts[half:])
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.split_pattern(pc.binary_join_element_wise("\0", pc.if_else(odd, "", texts), ""), " ")
        pieces = lists.flatten().dictionary_encode()
        inner = self.parts_of(pieces.dictionary)
        parts = inner.flatten().dictionary_encode()
        got = self.ids_of(parts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        ids, ends = spread(np.frombuffer(b"".join(got), np.uint32), sizes, parts.indices.to_numpy())
        ids, ends = spread(ids, np.diff(ends_of(inner, ends)), pieces.indices.to_numpy())
        cuts = ends_of(lists, ends).tolist()
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            first, *rest = _SAFE.split(texts[i].as_py())
            units = [first, *(" " + p for p in rest)]
            own = list(dict.fromkeys(units))
            known = dict(zip(own, self.ids_of(own), strict=True))
            out[i] = np.frombuffer(b"".join([known[u] for u in units]), np.uint32)
        return out

    def encode(self, text: str) -> np.ndarray:
        """All ids of one text."""
        return self.encode_column(pa.array([text], pa.string()))[0]


@cache
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path, remembered)


def token_table(docs: DataFrame, vocabulary: str, queue: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, queue, part, seq, before, in_order, n, ids: each text's ids (with END_ID) as little-endian binary.

    part and seq number the rows as they come; before is the number of ids earlier in the same part and queue;
    in_order says that doc_id is not null and not below that of the row before. ids has 16 bits an id where the
    vocabulary allows it. Stage the result before use: part and seq hold for one evaluation only."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        e = encoder(vocabulary, remembered)
        kind = np.uint16 if e.size <= 1 << 16 else np.uint32
        part, seq, last, seen = TaskContext.get().partitionId(), 0, None, {}
        give_back()  # of earlier tasks of this worker
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), e.encode_column(batch.column(2)), strict=True):
                ids = np.append(text, np.uint32(END_ID)).astype(kind)
                for column, x in zip(rows, (seq, seen.get(name, 0), doc is not None and (last is None and seq == 0 or last is not None and doc >= last), len(ids), ids.tobytes(), part), strict=True):
                    column.append(x)
                seen[name], last, seq = seen.get(name, 0) + len(ids), doc, seq + 1
            seqs, before, ordered, n, ids, parts = rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(parts, pa.int32()), pa.array(seqs, pa.int64()), pa.array(before, pa.int64()), pa.array(ordered, pa.bool_()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "queue", "part", "seq", "before", "in_order", "n", "ids"])

    name = F.when(F.col(queue).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(queue).cast("string"))) if queue else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("queue"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, queue string, part int, seq long, before long, in_order boolean, n long, ids binary")


def id_type(vocabulary: str):
    return np.uint16 if encoder(vocabulary).size <= 1 << 16 else np.uint32
